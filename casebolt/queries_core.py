"""Queries of the document engine on the test tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebolt import adapters as A
from casebolt.common import Scratch, table
from casebolt.functions import bates, identifiers, text
from casebolt.operators import collection, conversations, entities, families, occurrences, runs, search
from casebolt.plans.fields import Catalog
from casebolt.plans.filters import compile_filter, tuple_filter
from casebolt.plans.scope import Corpus, Scope, default_order, resolve
from casebolt.streaming import landing

Q: dict = {}
DOCS = "SELECT doc_id AS id, control_number, content_type, file_name, source_rel_path AS rel_path, source AS dataset_name, lang, n_chars AS file_size, text FROM documents"
SHOWN = ["id", "control_number", "content_type", "dataset_name", "lang", "file_size"]
COLS = ", ".join(SHOWN)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def _filter(name: str, expression: str, where: str):
    """A filter query: the expression in the filter language, its WHERE in SQL."""

    def run(spark, d):
        docs = A.documents(spark, d)
        return docs.where(compile_filter(expression, Catalog(docs))).select(*SHOWN)

    Q[name] = (run, f"SELECT {COLS} FROM ({DOCS}) WHERE {where}")


_filter("filter_eq", "lang = 'en' AND content_type = 'Memo'", "lang = 'en' AND content_type = 'Memo'")
_filter("filter_compare", "file_size >= 1000 AND file_size < 2000 AND lang <> 'en'", "file_size >= 1000 AND file_size < 2000 AND lang <> 'en'")
_filter("filter_like", "file_name LIKE '%ABX%' OR rel_path LIKE 'mail/%'", "file_name ILIKE '%ABX%' OR rel_path ILIKE 'mail/%'")
_filter("filter_not_like", "file_name NOT LIKE '%.txt'", "file_name NOT ILIKE '%.txt'")
_filter("filter_in", "lang IN ('de', 'fr') AND dataset_name NOT IN ('scan_ocr', 'chat_export')", "lang IN ('de', 'fr') AND dataset_name NOT IN ('scan_ocr', 'chat_export')")
_filter("filter_between", "file_size BETWEEN 500 AND 1500", "file_size BETWEEN 500 AND 1500")
_filter("filter_is_null", "lang IS NULL OR file_name IS NULL", "lang IS NULL OR file_name IS NULL")
_filter("filter_is_not_null", "content_type IS NOT NULL AND dataset_name IS NULL", "content_type IS NOT NULL AND dataset_name IS NULL")
_filter("filter_not_or_parens", "NOT (lang = 'en' OR content_type = 'Note') AND (file_size > 800 OR dataset_name = 'intake_forms')", "NOT (lang = 'en' OR content_type = 'Note') AND (file_size > 800 OR dataset_name = 'intake_forms')")


@query("filter_tuple_ops", f"SELECT {COLS} FROM ({DOCS}) WHERE contains(lower(file_name), 'docx') AND file_size >= 1000 AND lang IS NOT NULL")
def filter_tuple_ops(spark, d):
    docs = A.documents(spark, d)
    c = Catalog(docs)
    return docs.where(tuple_filter("file_name", "contains", "DOCX", c) & tuple_filter("file_size", "gte", 1000, c) & tuple_filter("lang", "not-null", None, c)).select(*SHOWN)


def _corpus(spark, d) -> Corpus:
    return Corpus(A.documents(spark, d), A.membership(spark, d))


@query("filter_dataset_name", f"SELECT {COLS} FROM ({DOCS}) WHERE dataset_name IN ('board_papers') OR lower(lang) = 'de'")
def filter_dataset_name(spark, d):
    return resolve(Scope(filter="dataset = 'board_papers' OR dataset_name = 'lang:de'"), _corpus(spark, d)).select(*SHOWN)


@query("scope_datasets", f"SELECT {COLS} FROM ({DOCS}) WHERE (dataset_name = 'legacy_dms' OR lower(lang) = 'fr') AND file_size > 1500")
def scope_datasets(spark, d):
    return resolve(Scope(filter="file_size > 1500").within_datasets("legacy_dms", "lang:fr"), _corpus(spark, d)).select(*SHOWN)


@query("visible_documents", f"SELECT {COLS} FROM ({DOCS}) WHERE dataset_name IS NOT NULL OR lang IS NOT NULL")
def visible_documents(spark, d):
    return collection.visible(A.documents(spark, d), A.membership(spark, d)).select(*SHOWN)


@query("browse_default_page1", "SELECT mail_id AS id, subject FROM mail_messages ORDER BY ingested_at DESC NULLS LAST, mail_id LIMIT 10")
def browse_default_page1(spark, d):
    return collection.page(A.mails(spark, d), default_order(Scope())).select("id", "subject")


@query("sort_multi_key", f"SELECT {COLS} FROM ({DOCS}) ORDER BY lang ASC NULLS LAST, file_size DESC NULLS LAST, id LIMIT 25")
def sort_multi_key(spark, d):
    return collection.page(A.documents(spark, d), collection.order([("lang", "asc"), ("file_size", "desc")]), 1, 25).select(*SHOWN)


@query("page_third", f"SELECT {COLS} FROM ({DOCS}) ORDER BY file_size DESC NULLS LAST, id LIMIT 40 OFFSET 80")
def page_third(spark, d):
    return collection.page(A.documents(spark, d), collection.order([("file_size", "desc")]), 3, 40).select(*SHOWN)


@query("page_beyond_end", f"SELECT {COLS} FROM ({DOCS}) WHERE false")
def page_beyond_end(spark, d):
    docs = A.documents(spark, d).where("lang = 'xx' or id < 0")
    return collection.page(docs, collection.order([("file_size", "desc")]), 5, 10).select(*SHOWN)


@query("columns_title_fallback", "SELECT mail_id AS id, coalesce(CASE WHEN trim(subject) <> '' THEN subject END, rfc822messageid) AS title FROM mail_messages")
def columns_title_fallback(spark, d):
    m = table(spark, d, "mail_messages").select(F.col("mail_id").alias("id"), F.lit(None).cast("string").alias("title"), "subject", F.col("rfc822messageid").alias("file_name"))
    return m.select("id", collection.title().alias("title"))


@query("blank_dates_last", "SELECT meta_id AS id FROM gmail_metadata ORDER BY CASE WHEN datesent IS NULL OR trim(datesent) = '' THEN 1 ELSE 0 END, datesent, meta_id LIMIT 50 OFFSET 50")
def blank_dates_last(spark, d):
    g = table(spark, d, "gmail_metadata").select(F.col("meta_id").alias("id"), "datesent")
    return collection.page(g, collection.blank_last("datesent"), 2, 50).select("id")


# ---- keyword search
_TOK = """tok AS (SELECT doc, term, pos FROM (SELECT doc_id AS doc, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL))),
ln AS (SELECT doc, count(*) AS len FROM tok GROUP BY doc), st AS (SELECT count(*) AS n, avg(len) AS mean FROM ln)"""


def _bm25_sql(terms: list[str], matched: str) -> str:
    """Score of documents in ``matched`` (SQL of doc) for terms: words, prefixes (w*) and phrases (a b)."""
    ctes, parts = [_TOK], []
    for k, t in enumerate(terms):
        ws = t.split()
        if len(ws) > 1:
            joins = " ".join(f"JOIN tok t{i} ON t{i}.doc = t0.doc AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(ws) if i)
            ctes.append(f"f{k} AS (SELECT t0.doc, count(*) AS f FROM tok t0 {joins} WHERE t0.term = '{ws[0]}' GROUP BY t0.doc)")
        else:
            test = f"starts_with(term, '{t[:-1]}')" if t.endswith("*") else f"term = '{t}'"
            ctes.append(f"f{k} AS (SELECT doc, count(*) AS f FROM tok WHERE {test} GROUP BY doc)")
        idf = f"greatest(ln((st.n - (SELECT count(*) FROM f{k}) + 0.5) / ((SELECT count(*) FROM f{k}) + 0.5)), 1e-6)"
        parts.append(f"coalesce({idf} * f{k}.f * 2.2 / (f{k}.f + 1.2 * (0.25 + 0.75 * ln.len / st.mean)), 0)")
    joins = " ".join(f"LEFT JOIN f{k} ON f{k}.doc = m.doc" for k in range(len(terms)))
    return f"WITH {', '.join(ctes)}, m AS ({matched}) SELECT m.doc AS id, round(-({' + '.join(parts)}), 6) AS score FROM m JOIN ln ON ln.doc = m.doc CROSS JOIN st {joins}"


_BUILT: dict[tuple, search.Index] = {}


def _index(spark, docs, ident, columns) -> search.Index:
    """The index of a collection, written at its first use in a session; later queries on the same files read it."""
    key = (spark.sparkContext.applicationId, docs.semanticHash(), ident, tuple(columns))
    if key not in _BUILT or not all(map(Scratch.there, (_BUILT[key].postings, _BUILT[key].sizes))):
        _BUILT[key] = search.build(docs, ident, columns, Scratch(spark, "index"))
    return _BUILT[key]


def _postings(spark, d):
    return _index(spark, A.documents(spark, d), "id", ["text"])


def _search(name: str, q: str, terms: list[str], matched: str, top: int | None = None):
    def run(spark, d):
        r = search.rank(_postings(spark, d), q).select(F.col("doc").alias("id"), F.round("score", 6).alias("score"))
        return r.orderBy("score", "id").limit(top) if top else r

    Q[name] = (run, _bm25_sql(terms, matched) + (f" ORDER BY score, id LIMIT {top}" if top else ""))


_search("keyword_search_top10", "interview audit", ["interview", "audit"], "SELECT doc FROM f0 INTERSECT SELECT doc FROM f1", 10)
_search("fts_single_term", "affidavit", ["affidavit"], "SELECT doc FROM f0")
_search("fts_frequent_term", "the", ["the"], "SELECT doc FROM f0")
_search("fts_implicit_and", "ledger custodian", ["ledger", "custodian"], "SELECT doc FROM f0 INTERSECT SELECT doc FROM f1")
_search("fts_or", "turbine OR pallet", ["turbine", "pallet"], "SELECT doc FROM f0 UNION SELECT doc FROM f1")
_search("fts_not", "permit NOT inventory", ["permit"], "SELECT doc FROM f0 EXCEPT SELECT doc FROM tok WHERE term = 'inventory'")
_search("fts_phrase", '"over the summer"', ["over the summer"], "SELECT doc FROM f0")
_search("fts_prefix", "manif*", ["manif*"], "SELECT doc FROM f0")
_search("fts_diacritics", "LÁS señales", ["las", "senales"], "SELECT doc FROM f0 INTERSECT SELECT doc FROM f1")
_search("fts_parens", "(turbine OR pallet) AND sealed", ["turbine", "pallet", "sealed"], "(SELECT doc FROM f0 UNION SELECT doc FROM f1) INTERSECT SELECT doc FROM f2")
_search("fts_within_compose", search.within("audit", "ledger OR memo"), ["audit", "ledger", "memo"], "SELECT doc FROM f0 INTERSECT (SELECT doc FROM f1 UNION SELECT doc FROM f2)")


@query("fts_near", f"""WITH {_TOK} SELECT DISTINCT a.doc AS id FROM tok a JOIN tok b ON a.doc = b.doc AND a.term = 'audit' AND b.term = 'shipments'
  WHERE greatest(a.pos, b.pos) - least(a.pos, b.pos) + 1 <= 2 + 5""")
def fts_near(spark, d):
    return search.matches(_postings(spark, d), search.parse_query("NEAR(audit shipments, 5)")).select(F.col("doc").alias("id"))


@query("fts_column", "SELECT doc_id AS id FROM documents WHERE list_contains(regexp_split_to_array(lower(strip_accents(file_name)), '[^\\p{L}\\p{N}]+'), 'docx') AND list_contains(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), 'audit')")
def fts_column(spark, d):
    p = _index(spark, A.documents(spark, d), "id", ["file_name", "text"])
    return search.matches(p, search.parse_query("file_name:docx AND text:audit")).select(F.col("doc").alias("id"))


@query("fts_plus_filter", f"WITH {_TOK} SELECT doc AS id, lang FROM (SELECT DISTINCT doc FROM tok WHERE term = 'audit') JOIN documents ON doc_id = doc WHERE lang = 'en' AND n_chars > 1000 AND source = 'legacy_dms'")
def fts_plus_filter(spark, d):
    c = _corpus(spark, d)
    c.meta_postings = _postings(spark, d)
    return resolve(Scope(keyword="audit", filter="lang = 'en' AND file_size > 1000").within_datasets("legacy_dms"), c).select("id", "lang")


@query("search_chunks_capped")
def search_chunks_capped(spark, d):
    ch = text.chunks(A.documents(spark, d)).withColumn("chunk", F.col("document_id") * 100000 + F.col("chunk_index"))
    hits = search.rank(_index(spark, ch, "chunk", ["text_content"]), "audit OR ledger").withColumnRenamed("doc", "chunk").join(ch.select("chunk", "document_id", "chunk_index", "char_start", "char_end"), "chunk")
    capped = hits.withColumn("r", F.row_number().over(W.partitionBy("document_id").orderBy("score", "chunk_index"))).where("r <= 3").drop("r")
    return capped.orderBy("score", "chunk").limit(12).select("document_id", "chunk_index", "char_start", "char_end", F.round("score", 6).alias("score"))


@query("search_documents_blended")
def search_documents_blended(spark, d):
    docs = A.documents(spark, d)
    ch = text.chunks(docs).withColumn("chunk", F.col("document_id") * 100000 + F.col("chunk_index"))
    r = search.search_documents(_index(spark, docs, "id", ["file_name", "control_number"]), _index(spark, ch, "chunk", ["text_content"]), ch, "audit OR docx")
    return r.select(F.col("doc").alias("id"), F.round("score", 6).alias("score"))


_CHUNKS = r"""t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, t, length(t) AS n, 0 AS a, {end0} AS b FROM t WHERE t <> '' UNION ALL SELECT id, t, n, a2, {end1} FROM (SELECT id, t, n, greatest(b - 250, a + 1) AS a2 FROM w WHERE b < n)),
p AS (SELECT id, a, substring(t, a + 1, b - a) AS s FROM w),
c AS (SELECT id, a + length(s) - length(regexp_replace(s, '^\s+', '')) AS char_start, regexp_replace(s, '^\s+|\s+$', '', 'g') AS piece FROM p),
chunk AS (SELECT id AS document_id, (row_number() OVER (PARTITION BY id ORDER BY char_start))::INTEGER - 1 AS chunk_index, char_start::INTEGER AS char_start, (char_start + length(piece))::INTEGER AS char_end, piece FROM c WHERE piece <> '')"""


def _end_sql(a: str, n: str) -> str:
    """The end of the window that begins at a: a line end in its last 500 characters, else a blank in its last 250, else 3,200 on."""
    last = lambda mark, zone: f"CASE WHEN contains(substring(t, greatest({a} + 400, {a} + 3200 - {zone}) + 1, {a} + 3200 - greatest({a} + 400, {a} + 3200 - {zone})), {mark}) THEN {a} + 3200 - instr(reverse(substring(t, greatest({a} + 400, {a} + 3200 - {zone}) + 1, {a} + 3200 - greatest({a} + 400, {a} + 3200 - {zone}))), {mark}) END"
    return f"CASE WHEN {a} + 3200 >= {n} THEN {n} ELSE coalesce({last('chr(10)', 500)}, {last('chr(32)', 250)}, {a} + 3200) END"


CHUNKS = _CHUNKS.replace("{end0}", _end_sql("0", "length(t)")).replace("{end1}", _end_sql("a2", "n"))


@query("chunk_layout", f"WITH RECURSIVE {CHUNKS} SELECT document_id, chunk_index, char_start, char_end, greatest(1, length(piece) // 4) AS token_estimate, sha256(piece) AS sha FROM chunk")
def chunk_layout(spark, d):
    return text.chunks(A.documents(spark, d)).select("document_id", "chunk_index", "char_start", "char_end", "token_estimate", F.sha2("text_content", 256).alias("sha"))


@query("snippets", "WITH t AS (SELECT doc_id AS id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents WHERE contains(lower(text), 'audit')) SELECT id, substring(t, greatest(instr(lower(t), 'audit') - 40, 1), 80) AS snippet FROM t")
def snippets(spark, d):
    return A.documents(spark, d).where(F.contains(F.lower("text"), F.lit("audit"))).select("id", search.snippet("text", "audit").alias("snippet"))


# ---- aggregation
@query("agg_count_by_dataset", "SELECT source AS dataset_name, count(*) AS n FROM documents GROUP BY source")
def agg_count_by_dataset(spark, d):
    return collection.aggregate(A.documents(spark, d), [("dataset_name", F.col("dataset_name"))], name="n")


@query("agg_multi_valued_dataset", "SELECT ds AS dataset_name, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, source AS ds FROM documents UNION ALL SELECT doc_id, 'lang:' || lower(lang) FROM documents) WHERE ds IS NOT NULL GROUP BY ds ORDER BY n DESC, dataset_name LIMIT 20")
def agg_multi_valued_dataset(spark, d):
    m = A.membership(spark, d).join(A.documents(spark, d).select("id"), F.col("document_id") == F.col("id"), "left_semi")
    return collection.aggregate(m, [("dataset_name", F.col("dataset_name"))], "distinct", "document_id", 20, "n")


@query("agg_distinct", "SELECT lang, count(DISTINCT content_type) AS kinds FROM documents GROUP BY lang")
def agg_distinct(spark, d):
    return collection.aggregate(A.documents(spark, d), [("lang", F.col("lang"))], "distinct", "content_type", name="kinds")


_BUCKET = {"year": "strftime(o_orderdate, '%Y')", "quarter": "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)", "month": "strftime(o_orderdate, '%Y-%m')", "week": "strftime(o_orderdate, '%G-W%V')"}


def _dates(size: str):
    Q[f"agg_{size}"] = (
        lambda spark, d: collection.aggregate(table(spark, d, "orders"), [("bucket", collection.bucket("o_orderdate", size))], "sum", "o_totalprice", name="total").select("bucket", F.round("total", 0).alias("total")),
        f"SELECT {_BUCKET[size]} AS bucket, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY 1",
    )


for _size in collection.BUCKETS:
    _dates(_size)


@query("dataset_summary", """WITH m AS (SELECT DISTINCT custodian AS dataset_name, id FROM (SELECT meta_id AS id, account AS custodian FROM gmail_metadata WHERE account IS NOT NULL)),
j AS (SELECT m.dataset_name, g.* FROM m JOIN gmail_metadata g ON g.meta_id = m.id),
k AS (SELECT dataset_name, kind, count(*) AS n FROM (SELECT dataset_name, coalesce(nullif(lower(regexp_extract(filename, '\\.([A-Za-z0-9]{1,8})$', 1)), ''), '(none)') AS kind FROM j) GROUP BY ALL)
SELECT j.dataset_name, count(*) AS documents, sum(coalesce(length(subject), 0)) AS total_size, (SELECT string_agg(kind || ': ' || n, ', ' ORDER BY n DESC, kind) FROM k WHERE k.dataset_name = j.dataset_name) AS content_types FROM j GROUP BY j.dataset_name""")
def dataset_summary(spark, d):
    g = table(spark, d, "gmail_metadata").where("account is not null")
    docs = g.select(F.col("meta_id").alias("id"), F.length("subject").cast("long").alias("file_size"), F.nullif(text.extension(F.coalesce("filename", F.lit(""))), F.lit("")).alias("content_type"), F.col("account").alias("custodian"), F.col("loaded_at").alias("date_created"), F.col("loaded_at").alias("date_modified"))
    m = g.select(F.col("account").alias("dataset_name"), F.col("meta_id").alias("document_id"))
    return collection.dataset_summary(docs, m).select("dataset_name", "documents", "total_size", "content_types")


_FAM = """fam AS MATERIALIZED (SELECT o_orderkey * 1000 AS id, NULL::BIGINT AS parent_id, NULL AS child_kind, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'active' END AS lifecycle_status FROM orders
UNION ALL SELECT l_orderkey * 1000 + l_linenumber, l_orderkey * 1000, CASE WHEN min(l_returnflag) = 'R' THEN 'reply_thread' WHEN min(l_returnflag) = 'A' THEN 'attachment' END, CASE WHEN min(l_linestatus) = 'F' THEN 'deleted' ELSE 'active' END FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query("inventory_counts", f"""WITH {_FAM} SELECT count(*) FILTER (lifecycle_status <> 'deleted' AND parent_id IS NULL) AS parents, count(*) FILTER (lifecycle_status = 'missing' AND parent_id IS NULL) AS missing_parents,
  count(*) FILTER (lifecycle_status <> 'deleted' AND parent_id IS NOT NULL AND coalesce(child_kind, 'attachment') = 'attachment') AS attachments, count(*) FILTER (lifecycle_status <> 'deleted') AS documents FROM fam""")
def inventory_counts(spark, d):
    return collection.inventory(A.families(spark, d))


# ---- Bates, families
def _production(spark, d):
    """The produced documents as a stored table: their Bates numbers are columns there, not expressions in every predicate."""
    return Scratch(spark, "production").put(A.production(spark, d))


@query("bates_point", "SELECT o_orderkey * 1000 AS id FROM orders WHERE 123456 BETWEEN o_orderkey * 100 AND o_orderkey * 100 + 99 UNION ALL SELECT DISTINCT l_orderkey * 1000 + l_linenumber FROM lineitem WHERE l_orderkey * 100 + l_linenumber = 123456")
def bates_point(spark, d):
    p = _production(spark, d).withColumn("last", F.coalesce("end_attachment", "end_bates"))
    return p.where(bates.contains("begin_bates", F.col("last"), F.lit("ord000000123456"))).select("id")


@query("bates_range_overlap", "SELECT DISTINCT l_orderkey * 1000 + l_linenumber AS id FROM lineitem WHERE l_orderkey * 100 + l_linenumber BETWEEN 100003 AND 110502 UNION SELECT o_orderkey * 1000 FROM orders WHERE o_orderkey * 100 BETWEEN 100003 AND 110502")
def bates_range_overlap(spark, d):
    a, b = bates.parse_query("ORD000000100003 - ORD000000110502")
    return _production(spark, d).where(bates.overlaps("begin_bates", F.col("end_bates"), F.lit(a), F.lit(b))).select("id")


@query("bates_sort", "SELECT * FROM (SELECT o_orderkey * 1000 AS id, o_orderkey * 100 AS n FROM orders UNION ALL SELECT DISTINCT l_orderkey * 1000 + l_linenumber, l_orderkey * 100 + l_linenumber FROM lineitem) ORDER BY n, id LIMIT 100")
def bates_sort(spark, d):
    p = _production(spark, d)
    return collection.page(p, bates.order("begin_bates"), 1, 100).select("id", bates.number("begin_bates").cast("long").alias("n"))


@query("production_family_link", "SELECT DISTINCT l_orderkey * 1000 + l_linenumber AS child, l_orderkey * 1000 AS parent FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def production_family_link(spark, d):
    return families.link_production_families(_production(spark, d))


@query("page_image_link", "SELECT o_orderkey * 1000 AS id, count(*) AS page_count, string_agg('IMG' || l_linenumber, ',' ORDER BY l_linenumber) AS pages FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def page_image_link(spark, d):
    p = _production(spark, d)
    pages = p.where("begin_attachment is null").select(F.col("begin_bates").alias("page_bates"), F.concat(F.lit("IMG"), (F.col("id") % 1000).cast("string")).alias("image_path"))
    docs = p.where("begin_attachment is not null").select("id", F.col("begin_attachment").alias("begin_bates"), F.col("end_attachment").alias("end_bates"))
    return families.link_pages(docs, pages)


@query("is_attachment", f"WITH {_FAM} SELECT id FROM fam WHERE parent_id IS NOT NULL AND coalesce(child_kind, 'attachment') = 'attachment'")
def is_attachment(spark, d):
    return A.families(spark, d).where(families.is_attachment()).select("id")


@query("has_attachments", f"WITH {_FAM} SELECT DISTINCT p.id FROM fam c JOIN fam p ON p.id = c.parent_id WHERE coalesce(c.child_kind, 'attachment') = 'attachment' AND c.lifecycle_status <> 'deleted'")
def has_attachments(spark, d):
    return families.has_attachments(A.families(spark, d)).select("id")


@query("family_expand", f"""WITH {_FAM}, s AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS ordinal FROM fam WHERE child_kind = 'reply_thread'),
x AS (SELECT s.ordinal, s.id AS seed, coalesce(f.parent_id, f.id) AS root FROM s JOIN fam f USING (id))
SELECT m.id, min(x.ordinal) AS first, CASE WHEN m.parent_id IS NULL THEN 0 ELSE 1 END AS child, count(DISTINCT x.seed) AS seeds FROM x JOIN fam m ON coalesce(m.parent_id, m.id) = x.root GROUP BY m.id, m.parent_id""")
def family_expand(spark, d):
    f = A.families(spark, d)
    seeds = families.numbered(f.where("child_kind = 'reply_thread'").select("id"), F.desc("id")).select("id", "ordinal")
    return families.expand_family(seeds, f).select("id", "first", "child", F.size("seed_ids").alias("seeds"))


@query("control_number_order", "SELECT doc_id AS id, regexp_extract(control_number, '^DOC(\\d+)\\.(\\d+)', 2)::BIGINT AS family_no FROM documents ORDER BY family_no NULLS LAST, id LIMIT 100")
def control_number_order(spark, d):
    docs = A.documents(spark, d).select("id", *families.control_parts("control_number"))
    return collection.page(docs, [F.col("batch_no").asc_nulls_last(), F.col("family_no").asc_nulls_last(), F.coalesce("attachment_no", F.lit(0)), F.col("id")], 1, 100).select("id", "family_no")


# ---- copies and duplicates
@query("exact_duplicate_groups", "SELECT sha256(text) AS file_hash, min(doc_id) AS survivor, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    return occurrences.exact_duplicates(A.documents(spark, d), "file_hash")


@query("content_hash_check", "SELECT CASE WHEN content_hash IS NULL THEN 'missing' WHEN text IS NULL THEN 'no text' WHEN lower(content_hash) = sha256(text) THEN 'equal' ELSE 'different' END AS state, count(*) AS n FROM documents GROUP BY 1")
def content_hash_check(spark, d):
    docs = A.documents(spark, d)
    st = F.when(F.col("content_hash").isNull(), "missing").when(F.col("text").isNull(), "no text").when(F.col("content_hash") == F.col("file_hash"), "equal").otherwise("different")
    return docs.groupBy(st.alias("state")).agg(F.count("*").alias("n"))


@query("dedupe_key_backfill", """SELECT 'content_hash' AS basis, h AS key_value, max(doc_id) AS document_id FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL)
WHERE h NOT IN (SELECT lower(trim(key_value)) FROM document_dedupe_keys WHERE basis = 'content_hash' AND key_value IS NOT NULL) GROUP BY h""")
def dedupe_key_backfill(spark, d):
    return occurrences.backfill_keys(A.documents(spark, d), table(spark, d, "document_dedupe_keys"), "content_hash")


_OCC = "occ AS (SELECT meta_id AS id, lower(rfc822messageid) AS document_id, account AS custodian, subject, from_addr AS author, to_addr AS recipients, filename AS file_name, loaded_at FROM gmail_metadata WHERE rfc822messageid IS NOT NULL)"
_FILLED = " + ".join(f"CASE WHEN trim({c}) <> '' THEN 1 ELSE 0 END" for c in ("subject", "author", "recipients", "file_name"))
_RANKED = f"{_OCC}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY -({_FILLED}), loaded_at NULLS LAST, id) AS r FROM occ)"
FIELDS = ["subject", "author", "recipients", "file_name"]


@query("preferred_occurrence", f"WITH {_RANKED} SELECT document_id, id FROM r WHERE r = 1")
def preferred_occurrence(spark, d):
    return occurrences.preferred(A.copies(spark, d), FIELDS).select("document_id", "id")


def _first(c: str) -> str:
    return f"arg_min({c}, CASE WHEN r = 1 THEN 0 ELSE 1 + rank END) FILTER (trim({c}) <> '') AS {c}"


@query("canonical_document", f"WITH {_RANKED}, z AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY loaded_at NULLS LAST, id) AS rank FROM r) SELECT document_id, {', '.join(map(_first, FIELDS))}, count(*) AS copies FROM z GROUP BY document_id")
def canonical_document(spark, d):
    return occurrences.canonical(A.copies(spark, d), FIELDS).select("document_id", *FIELDS, "copies")


@query("custodian_list", f"WITH {_RANKED}, c AS (SELECT document_id, trim(custodian) AS c, min(r) AS r FROM r WHERE trim(custodian) <> '' GROUP BY ALL) SELECT document_id, string_agg(c, '; ' ORDER BY r) AS custodians FROM c GROUP BY document_id")
def custodian_list(spark, d):
    return occurrences.canonical(A.copies(spark, d), FIELDS).where("size(custodians) > 0").select("document_id", F.array_join("custodians", "; ").alias("custodians"))


_BOTH = """occ AS (SELECT meta_id AS id, lower(rfc822messageid) AS document_id, subject, from_addr AS author FROM gmail_metadata WHERE rfc822messageid IS NOT NULL
UNION ALL SELECT 100000000 + mail_id, lower(rfc822messageid), subject, from_addr FROM mail_messages WHERE rfc822messageid IS NOT NULL)"""


@query("metadata_conflicts", f"""WITH {_BOTH}, l AS (SELECT document_id, id, 'subject' AS field_name, trim(subject) AS value FROM occ UNION ALL SELECT document_id, id, 'author', trim(author) FROM occ),
v AS (SELECT document_id, field_name, value, max(id) AS occurrence_id FROM l WHERE value <> '' GROUP BY ALL) SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY document_id, field_name) > 1""")
def metadata_conflicts(spark, d):
    shape = lambda name, ident, add: table(spark, d, name).where("rfc822messageid is not null").select((F.col(ident) + add).alias("id"), F.lower("rfc822messageid").alias("document_id"), "subject", F.col("from_addr").alias("author"), F.lit("active").alias("lifecycle_status"))
    return occurrences.conflicts(shape("gmail_metadata", "meta_id", 0).unionByName(shape("mail_messages", "mail_id", 100000000)), ["subject", "author"])


@query("sidecar_gap_fill", """WITH s AS (SELECT lower(rfc822messageid) AS message_id, arg_min(trim(subject), meta_id) FILTER (trim(subject) <> '') AS s, arg_min(trim(from_addr), meta_id) FILTER (trim(from_addr) <> '') AS f FROM gmail_metadata WHERE rfc822messageid IS NOT NULL GROUP BY 1)
SELECT mail_id AS id, coalesce(CASE WHEN trim(subject) <> '' THEN subject END, s) AS subject, coalesce(CASE WHEN trim(from_addr) <> '' THEN from_addr END, f) AS author FROM mail_messages LEFT JOIN s ON lower(rfc822messageid) = message_id""")
def sidecar_gap_fill(spark, d):
    g = table(spark, d, "gmail_metadata").select(F.lower("rfc822messageid").alias("message_id"), "subject", F.col("from_addr").alias("author"), F.col("meta_id").alias("side_order"))
    return occurrences.gap_fill(A.mails(spark, d).select("id", "message_id", "subject", "author"), g, "message_id", ["subject", "author"]).select("id", "subject", "author")


_SEEN = """g AS (SELECT lower(rfc822messageid) AS path, arg_min(subject, meta_id) AS subject, arg_min(from_addr, meta_id) AS author FROM gmail_metadata WHERE rfc822messageid IS NOT NULL GROUP BY 1),
m AS (SELECT lower(rfc822messageid) AS path, arg_min(subject, mail_id) AS subject, arg_min(from_addr, mail_id) AS author FROM mail_messages WHERE rfc822messageid IS NOT NULL GROUP BY 1)"""


def _seen(spark, d, name: str, ident: str):
    """The first record of each message id: what a store knows (sidecars) and what a scan finds (mails)."""
    first = lambda c: F.min_by(c, ident).alias(c)
    return table(spark, d, name).where("rfc822messageid is not null").groupBy(F.lower("rfc822messageid").alias("path")).agg(first("subject"), first("from_addr"))


@query("rescan_states", f"""WITH {_SEEN}, a AS (SELECT path, CASE WHEN subject IS NOT NULL THEN sha256(subject) END AS hash FROM g), b AS (SELECT path, CASE WHEN subject IS NOT NULL THEN sha256(subject) END AS hash FROM m),
j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'new' WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'unchanged' ELSE 'changed' END AS state, coalesce(b.hash, a.hash) AS hash FROM a FULL JOIN b ON a.path = b.path),
n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM j WHERE state = 'new' AND hash IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM j WHERE state = 'missing' AND hash IS NOT NULL),
mv AS (SELECT n.path, o.path AS from_path FROM n JOIN o USING (hash, k))
SELECT j.path, CASE WHEN mv.from_path IS NOT NULL THEN 'renamed' ELSE j.state END AS state, mv.from_path FROM j LEFT JOIN mv ON mv.path = j.path WHERE j.path NOT IN (SELECT from_path FROM mv)""")
def rescan_states(spark, d):
    shape = lambda df: df.select("path", F.sha2("subject", 256).alias("hash"), F.lit(1).alias("size"))
    return occurrences.rescan(shape(_seen(spark, d, "gmail_metadata", "meta_id")), shape(_seen(spark, d, "mail_messages", "mail_id")))


@query("membership_cache", "SELECT document_id, CASE WHEN count(DISTINCT ds) = 1 THEN min(ds) END AS dataset_name FROM (SELECT doc_id AS document_id, source AS ds FROM documents UNION ALL SELECT doc_id, 'lang:' || lower(lang) FROM documents) WHERE ds IS NOT NULL GROUP BY 1")
def membership_cache(spark, d):
    return collection.membership_cache(A.membership(spark, d))


@query("dataset_add_remove", """WITH ids AS (SELECT DISTINCT document_id AS id FROM document_dedupe_keys WHERE document_id IS NOT NULL)
SELECT id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN d.source = 'legacy_dms' THEN 'already' ELSE 'added' END AS result FROM ids LEFT JOIN documents d ON d.doc_id = id""")
def dataset_add_remove(spark, d):
    ids = table(spark, d, "document_dedupe_keys").where("document_id is not null").select(F.col("document_id").alias("id"))
    return collection.add_members(A.membership(spark, d), A.documents(spark, d), "legacy_dms", ids)


@query("longest_prefix_dataset", """WITH l AS (SELECT DISTINCT regexp_extract(source_rel_path, '^([^/]+)', 1) AS locator FROM documents WHERE source_rel_path IS NOT NULL UNION SELECT DISTINCT source_rel_path FROM documents WHERE source_rel_path LIKE '%.mbox'),
p AS (SELECT DISTINCT source_rel_path || '/m1' AS path FROM documents WHERE source_rel_path IS NOT NULL)
SELECT path, arg_max(locator, length(locator)) AS locator FROM p JOIN l ON path = locator OR starts_with(path, locator || '/') GROUP BY path""")
def longest_prefix_dataset(spark, d):
    t = table(spark, d, "documents").where("source_rel_path is not null").select("source_rel_path").distinct()
    loc = t.select(F.regexp_extract("source_rel_path", "^([^/]+)", 1).alias("locator")).unionByName(t.where("source_rel_path like '%.mbox'").select(F.col("source_rel_path").alias("locator"))).distinct()
    return occurrences.longest_prefix(t.select(F.concat("source_rel_path", F.lit("/m1")).alias("path")), loc)


@query("candidate_narrowing", """WITH c AS (SELECT meta_id AS candidate_id, lower(rfc822messageid) AS message_id, account, subject FROM gmail_metadata), i AS (SELECT mail_id AS item_id, lower(rfc822messageid) AS message_id, account, subject FROM mail_messages),
a AS (SELECT item_id, min(candidate_id) AS candidate_id FROM i JOIN c USING (message_id) GROUP BY item_id HAVING count(*) = 1),
b AS (SELECT item_id, min(candidate_id) AS candidate_id FROM i JOIN c USING (message_id, account, subject) WHERE item_id NOT IN (SELECT item_id FROM a) GROUP BY item_id HAVING count(*) = 1),
e AS (SELECT item_id, min(candidate_id) AS candidate_id FROM i JOIN c USING (account, subject) WHERE item_id NOT IN (SELECT item_id FROM a UNION SELECT item_id FROM b) GROUP BY item_id HAVING count(*) = 1)
SELECT *, 1 AS level FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM e""")
def candidate_narrowing(spark, d):
    c = table(spark, d, "gmail_metadata").select(F.col("meta_id").alias("candidate_id"), F.lower("rfc822messageid").alias("message_id"), "account", "subject")
    i = table(spark, d, "mail_messages").select(F.col("mail_id").alias("item_id"), F.lower("rfc822messageid").alias("message_id"), "account", "subject")
    return occurrences.narrow(i, c, [["message_id"], ["message_id", "account", "subject"], ["account", "subject"]])


@query("attachment_match", """WITH o AS (SELECT meta_id AS id, lower(rfc822messageid) AS parent_id, lower(from_addr) AS name, sha256(account) AS hash FROM gmail_metadata WHERE rfc822messageid IS NOT NULL AND account IS NOT NULL), n AS (SELECT mail_id AS id, lower(rfc822messageid) AS parent_id, lower(from_addr) AS name, sha256(account) AS hash FROM mail_messages WHERE rfc822messageid IS NOT NULL AND account IS NOT NULL),
o1 AS (SELECT *, row_number() OVER (PARTITION BY parent_id, name, hash ORDER BY id) AS k FROM o WHERE name IS NOT NULL), n1 AS (SELECT *, row_number() OVER (PARTITION BY parent_id, name, hash ORDER BY id) AS k FROM n WHERE name IS NOT NULL),
p1 AS (SELECT o1.id AS old_id, n1.id AS new_id FROM o1 JOIN n1 USING (parent_id, name, hash, k)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY parent_id, hash ORDER BY id) AS k FROM o WHERE id NOT IN (SELECT old_id FROM p1)), n2 AS (SELECT *, row_number() OVER (PARTITION BY parent_id, hash ORDER BY id) AS k FROM n WHERE id NOT IN (SELECT new_id FROM p1))
SELECT * FROM p1 UNION ALL SELECT o2.id, n2.id FROM o2 JOIN n2 USING (parent_id, hash, k)""")
def attachment_match(spark, d):
    shape = lambda name, ident: table(spark, d, name).where("rfc822messageid is not null and account is not null").select(F.col(ident).alias("id"), F.lower("rfc822messageid").alias("parent_id"), F.lower("from_addr").alias("name"), F.sha2("account", 256).alias("hash"))
    return occurrences.match_by_hash(shape("gmail_metadata", "meta_id"), shape("mail_messages", "mail_id"))


# ---- conversations
@query("subject_normalise", "SELECT mail_id AS id, lower(trim(regexp_replace(regexp_replace(subject, '\\s+', ' ', 'g'), '(?i)^\\s*((re|fwd?)\\s*(\\[\\d+\\])?\\s*:\\s*)+', ''))) AS subject FROM mail_messages")
def subject_normalise(spark, d):
    return A.mails(spark, d).select("id", identifiers.subject("subject").alias("subject"))


@query("conversation_summary", """WITH m AS (SELECT lower(trim(regexp_replace(regexp_replace(subject, '\\s+', ' ', 'g'), '(?i)^\\s*((re|fwd?)\\s*(\\[\\d+\\])?\\s*:\\s*)+', ''))) AS conversation_id, from_addr, ingested_at, text_body FROM mail_messages)
SELECT conversation_id, count(*) AS documents, epoch_us(min(ingested_at)) AS first_activity, epoch_us(max(ingested_at)) AS last_activity, count(DISTINCT from_addr) AS people, count(*) FILTER (contains(lower(text_body), 'audit')) AS matching FROM m WHERE conversation_id IS NOT NULL GROUP BY 1""")
def conversation_summary(spark, d):
    m = A.mails(spark, d).withColumns({"conversation_id": identifiers.subject("subject"), "participant": F.col("author"), "hit": F.coalesce(F.contains(F.lower("text_body"), F.lit("audit")), F.lit(False))})
    s = conversations.summary(m, "conversation_id", "hit")
    return s.select("conversation_id", "documents", F.unix_micros("first_activity").alias("first_activity"), F.unix_micros("last_activity").alias("last_activity"), F.when(F.col("participants") == "", 0).otherwise(F.size(F.split("participants", "(?<=>|example), "))).alias("people"), "matching")


@query("child_inherit", f"WITH {_FAM} SELECT c.id, CASE WHEN c.parent_id IS NULL THEN 'conv' || c.id ELSE 'conv' || p.id END AS conversation_id FROM fam c LEFT JOIN fam p ON p.id = c.parent_id")
def child_inherit(spark, d):
    f = A.families(spark, d).withColumns({"conversation_id": F.when(F.col("parent_id").isNull(), F.concat(F.lit("conv"), "id")), "assignment_mode": F.lit("auto")})
    return conversations.inherit(f).select("id", "conversation_id")


_LABELS = "agenda|answer|bcc|cc|date|description|from|message|note|notes|owner|priority|question|sent|status|subject|summary|task|thread|title|to|topic"


@query("chat_transcripts", rf"""WITH l AS (SELECT doc_id AS id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents WHERE content_type = 'Chat')),
x AS (SELECT id, regexp_extract(line, '^\[([^\]]{{4,80}})\]\s*([^:\n]{{2,80}}?):\s+(\S.*)$', ['at', 'speaker', 'message']) AS a, regexp_extract(line, '^([^:\n]{{2,80}}?):\s+(\S.*)$', ['speaker', 'message']) AS b FROM l WHERE length(line) BETWEEN 1 AND 240),
y AS (SELECT id, a."at" AS tm, regexp_replace(regexp_replace(CASE WHEN a.speaker <> '' THEN a.speaker ELSE b.speaker END, '\s+', ' ', 'g'), '^[\[\]() ]+|[\[\]() ]+$', '', 'g') AS speaker FROM x)
SELECT id, count(*) AS messages, count(DISTINCT speaker) AS speakers, min(tm) AS first_at FROM y WHERE speaker <> '' AND NOT regexp_full_match(lower(speaker), '{_LABELS}') AND len(string_split(speaker, ' ')) <= 8 AND NOT starts_with(speaker, '"') GROUP BY id""")
def chat_transcripts(spark, d):
    t = A.documents(spark, d).where("content_type = 'Chat'").select("id", F.explode(conversations.chat_lines("text")).alias("x"))
    return t.groupBy("id").agg(F.count("*").alias("messages"), F.countDistinct("x.speaker").alias("speakers"), F.min("x.at").alias("first_at"))


@query("event_transcript", "SELECT user_id, string_agg(event_type || ': ' || event_id, chr(10) ORDER BY ts, event_id) AS transcript FROM events GROUP BY user_id")
def event_transcript(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "event_type", F.col("event_id").cast("string").alias("t"))
    return conversations.transcript(e, "user_id", "o", "event_type", "t")


@query("mail_threads")
def mail_threads(spark, d):
    return conversations.thread_mail(A.threaded(spark, d)).select("id", "cluster", "how", "conversation_key", "display_name")


# ---- entities
_EMAIL_OK = "regexp_full_match({0}, '[a-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-z0-9]([a-z0-9.-]*[a-z0-9])?') AND contains(string_split({0}, '@')[-1], '.')"


def _email_sql(c: str) -> str:
    v = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim({c}), '^[<>;,]+|[<>;,]+$', '', 'g')), '^mailto:', ''), '^[<>;,]+', ''), '[<>;,]+$', '')"
    return f"CASE WHEN {_EMAIL_OK.format(v)} THEN {v} END"


@query("email_normalise", f"SELECT identifier_id, {_email_sql('display_value')} AS email FROM entity_identifiers WHERE lower(trim(identifier_type)) = 'email'")
def email_normalise(spark, d):
    return table(spark, d, "entity_identifiers").where(F.lower(F.trim("identifier_type")) == "email").select("identifier_id", identifiers.email("display_value").alias("email"))


@query("phone_normalise", r"""WITH p AS (SELECT identifier_id, trim(display_value) AS v, regexp_extract(trim(display_value), '(?i)(?:ext\.?|extension|x)\s*([0-9]{1,10})\b', 1) AS e FROM entity_identifiers WHERE lower(trim(identifier_type)) = 'phone'),
m AS (SELECT *, trim(CASE WHEN e <> '' THEN regexp_replace(v, '(?i)(?:ext\.?|extension|x)\s*([0-9]{1,10})\b', '') ELSE v END) AS m FROM p), q AS (SELECT *, regexp_replace(m, '\D', '', 'g') AS dg FROM m)
SELECT identifier_id, CASE WHEN length(dg) BETWEEN 7 AND 15 AND (regexp_matches(m, '[()+\-\s.]') OR length(dg) >= 10) THEN
  (CASE WHEN starts_with(m, '+') THEN '+' || dg WHEN length(dg) = 10 THEN '+1' || dg WHEN length(dg) = 11 AND starts_with(dg, '1') THEN '+' || dg ELSE dg END) || (CASE WHEN e <> '' THEN 'x' || e ELSE '' END) END AS phone FROM q""")
def phone_normalise(spark, d):
    return table(spark, d, "entity_identifiers").where(F.lower(F.trim("identifier_type")) == "phone").select("identifier_id", identifiers.phone("display_value").alias("phone"))


@query("entity_labels", """SELECT entity_id, coalesce(CASE WHEN n IS NOT NULL AND m IS NOT NULL AND lower(n) <> lower(m) THEN n || ' <' || m || '>' END, n, m, p, 'Unknown Entity ' || entity_id) AS label
FROM (SELECT entity_id, nullif(trim(display_name), '') AS n, nullif(trim(primary_email), '') AS m, nullif(trim(primary_phone), '') AS p FROM entities)""")
def entity_labels(spark, d):
    return table(spark, d, "entities").select("entity_id", identifiers.label("display_name", "primary_email", "primary_phone", "entity_id").alias("label"))


@query("entity_inventory", "SELECT entity_type, entity_origin, canonical_status, count(*) AS n FROM entities GROUP BY ALL")
def entity_inventory(spark, d):
    return collection.aggregate(table(spark, d, "entities"), [(c, F.col(c)) for c in ("entity_type", "entity_origin", "canonical_status")], name="n")


NAME_WORDS = r"""list_filter(regexp_split_to_array(regexp_replace({}, '["''()<>]', ' ', 'g'), '[\s.]+'), lambda w: regexp_matches(w, '[A-Za-z]') AND NOT regexp_full_match(lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), 'mr|mrs|ms|miss|dr|prof|jr|sr|ii|iii|iv|esq'))"""


@query("entity_types", f"""WITH e AS (SELECT entity_id, {_email_sql('primary_email')} AS a, trim(regexp_replace(regexp_replace(lower(coalesce(display_name, '')), '[^\\p{{L}}\\p{{N}}_@.+#/-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n,
  len({NAME_WORDS.format("coalesce(display_name, '')")}) >= 2 AND NOT contains(coalesce(display_name, ''), '@') AS f FROM entities),
b AS (SELECT *, regexp_replace(string_split(a, '@')[1], '[^a-z0-9]+', '', 'g') AS x FROM e)
SELECT entity_id, CASE WHEN x IN ('automated', 'daemon', 'donotreply', 'mailerdaemon', 'notification', 'notifications', 'noreply', 'postmaster') OR contains(x, 'donotreply') OR contains(x, 'noreply') THEN 'system_mailbox'
  WHEN x IN ('admin', 'allcompany', 'billing', 'contact', 'events', 'help', 'hello', 'info', 'legal', 'legalevents', 'marketing', 'news', 'press', 'sales', 'support', 'team') OR (a IS NOT NULL AND regexp_matches(n, '\\b(all company|help desk|legalweek|support|team)\\b')) THEN 'shared_mailbox'
  WHEN regexp_matches(n, '\\b(inc|llc|llp|ltd|corp|corporation|company|co|plc|gmbh|sarl|partners|holdings)\\b') THEN 'organization' WHEN a IS NOT NULL OR f THEN 'person' ELSE 'unknown' END AS type_by_rule FROM b""")
def entity_types(spark, d):
    return table(spark, d, "entities").select("entity_id", entities.entity_type("display_name", "primary_email").alias("type_by_rule"))


@query("auto_merge_identifiers", "SELECT identifier_id FROM entity_identifiers WHERE lower(trim(identifier_type)) IN ('email', 'handle') AND (lower(trim(identifier_type)) <> 'handle' OR (trim(provider) <> '' AND trim(provider_scope) <> '')) AND trim(normalized_value) <> ''")
def auto_merge_identifiers(spark, d):
    return entities.auto_merge(table(spark, d, "entity_identifiers")).select("identifier_id")


@query("entity_role_inventory", "SELECT source_kind AS role, entity_id, count(DISTINCT provider_scope) AS documents FROM entity_identifiers JOIN entities USING (entity_id) WHERE provider_scope IS NOT NULL AND canonical_status = 'active' GROUP BY ALL")
def entity_role_inventory(spark, d):
    i = table(spark, d, "entity_identifiers").where("provider_scope is not null").select(F.col("source_kind").alias("role"), "entity_id", F.col("provider_scope").alias("document_id"))
    return entities.role_inventory(i.join(table(spark, d, "entities").where("canonical_status = 'active'").select("entity_id"), "entity_id", "left_semi"))


@query("entity_caches", """WITH k AS (SELECT *, lower(trim(identifier_type)) AS k FROM entity_identifiers WHERE trim(display_value) <> ''), f AS (SELECT entity_id, k, display_value, row_number() OVER (PARTITION BY entity_id, k ORDER BY CASE WHEN k = 'name' AND NOT contains(trim(display_value), ' ') THEN 1 ELSE 0 END, 1 - coalesce(is_primary, 0), identifier_id) AS r FROM k)
SELECT e.entity_id, max(display_value) FILTER (k = 'email') AS primary_email, max(display_value) FILTER (k = 'phone') AS primary_phone, max(display_value) FILTER (k = 'name') AS display_name FROM entities e LEFT JOIN f ON f.entity_id = e.entity_id AND r = 1 GROUP BY e.entity_id""")
def entity_caches(spark, d):
    return entities.caches(table(spark, d, "entities"), table(spark, d, "entity_identifiers"))


@query("entity_resolution")
def entity_resolution(spark, d):
    i = entities.auto_merge(table(spark, d, "entity_identifiers")).select("entity_id", F.concat(F.lower(F.trim("identifier_type")), F.lit(":"), F.lower(F.trim("normalized_value"))).alias("k"))
    c = i.groupBy(F.col("entity_id").alias("candidate_id")).agg(F.sort_array(F.collect_set("k")).alias("keys")).join(table(spark, d, "entities").select(F.col("entity_id").alias("candidate_id"), "entity_type"), "candidate_id")
    return entities.resolve(c)


@query("canonical_entities", """WITH RECURSIVE p AS (SELECT entity_id AS id, (SELECT min(right_entity_id) FROM entity_merge_blocks b WHERE b.left_entity_id = e.entity_id AND b.right_entity_id < b.left_entity_id) AS t FROM entities e),
c AS (SELECT id, coalesce(t, id) AS cur FROM p UNION SELECT c.id, p.t FROM c JOIN p ON p.id = c.cur WHERE p.t IS NOT NULL) SELECT id, min(cur) AS canonical_id FROM c GROUP BY id""")
def canonical_entities(spark, d):
    to = table(spark, d, "entity_merge_blocks").where("right_entity_id < left_entity_id").groupBy(F.col("left_entity_id").alias("id")).agg(F.min("right_entity_id").alias("merged_into"))
    return entities.canonical(table(spark, d, "entities").select(F.col("entity_id").alias("id")).join(to, "id", "left"))


# ---- runs
@query("run_snapshot", "SELECT doc_id AS id, (row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id))::INTEGER AS ordinal FROM documents WHERE lang = 'en'")
def run_snapshot(spark, d):
    sel = resolve(Scope(filter="lang = 'en'"), _corpus(spark, d))
    return runs.snapshot(sel, A.documents(spark, d), [F.col("file_size").desc_nulls_last(), F.col("id")])


@query("run_snapshot_family", f"""WITH {_FAM}, s AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS ordinal FROM fam WHERE child_kind = 'reply_thread'),
m AS (SELECT m.id, min(s.ordinal) AS first, CASE WHEN m.parent_id IS NULL THEN 0 ELSE 1 END AS child FROM s JOIN fam f USING (id) JOIN fam m ON coalesce(m.parent_id, m.id) = coalesce(f.parent_id, f.id) GROUP BY m.id, m.parent_id)
SELECT id, (row_number() OVER (ORDER BY first, child, id))::INTEGER AS ordinal FROM m""")
def run_snapshot_family(spark, d):
    f = A.families(spark, d)
    return runs.snapshot(f.where("child_kind = 'reply_thread'"), f, [F.desc("id")], family=True)


@query("input_identity", "SELECT doc_id AS id, sha256(coalesce('=' || doc_id, '-') || '||' || coalesce('=' || lower(content_hash), '-') || '||' || coalesce('=' || lang, '-')) AS input_id FROM documents")
def input_identity(spark, d):
    return A.documents(spark, d).select("id", runs.pinned("id", "content_hash", "lang").alias("input_id"))


@query("result_reuse", "SELECT doc_id AS id, max(dedupe_key_id) AS result_id, CASE WHEN max(dedupe_key_id) IS NULL THEN 'pending' ELSE 'reused' END AS state FROM documents LEFT JOIN document_dedupe_keys ON document_id = doc_id AND basis = 'file_hash' GROUP BY doc_id")
def result_reuse(spark, d):
    items = A.documents(spark, d).select(F.col("id").alias("document_id"), F.lit(1).alias("job_version_id"), F.lit("file_hash").alias("input_id"))
    res = table(spark, d, "document_dedupe_keys").select("document_id", F.lit(1).alias("job_version_id"), F.col("basis").alias("input_id"), F.col("dedupe_key_id").alias("result_id"), F.lit(None).cast("timestamp").alias("retracted_at"))
    return runs.reuse(items, res).select(F.col("document_id").alias("id"), "result_id", "state")


@query("run_progress", """SELECT o_custkey AS run_id, count(*) AS n, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS ended, count(*) FILTER (o_orderstatus = 'P') AS failed,
CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'canceled' WHEN count(*) FILTER (o_orderstatus IN ('F', 'P')) = count(*) THEN CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'failed' ELSE 'completed' END WHEN count(*) FILTER (o_orderstatus IN ('F', 'P')) > 0 THEN 'running' ELSE 'planned' END AS state FROM orders GROUP BY o_custkey""")
def run_progress(spark, d):
    st = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return runs.progress(table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), st.alias("state"), (F.col("o_orderpriority") == "1-URGENT").alias("canceled")))


@query("publish_outputs", "SELECT d.doc_id AS id, v.v AS pages FROM documents d LEFT JOIN (SELECT document_id, try_cast(regexp_replace(arg_max(key_value, dedupe_key_id), '[^0-9]', '', 'g')[1:6] AS BIGINT) AS v FROM document_dedupe_keys WHERE document_id IS NOT NULL AND key_value IS NOT NULL GROUP BY 1) v ON v.document_id = d.doc_id")
def publish_outputs(spark, d):
    res = table(spark, d, "document_dedupe_keys").where("document_id is not null and key_value is not null").select("document_id", F.substring(F.regexp_replace("key_value", "[^0-9]", ""), 1, 6).alias("output"), F.col("dedupe_key_id").alias("result_id"))
    return runs.publish(res, A.documents(spark, d).select("id"), "pages", "integer")


@query("execute_template", "SELECT doc_id AS document_id, 'completed' AS state, coalesce(control_number, '') || ' in ' || coalesce(lang, '') AS output FROM documents")
def execute_template(spark, d):
    docs = A.documents(spark, d).select(F.col("id").alias("document_id"), "control_number", "lang")
    return runs.execute(docs, "static_template", "{control_number} in {lang}", ["control_number", "lang"]).select("document_id", "state", "output")


@query("assemble_pages", "SELECT l_orderkey AS document_id, string_agg('p' || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber) AS text FROM (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS s FROM lineitem GROUP BY ALL) GROUP BY 1 HAVING count(*) FILTER (s <> 'O') = 0")
def assemble_pages(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("s"))
    return runs.assemble_pages(l.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.concat(F.lit("p"), F.col("l_linenumber")).alias("text"), F.when(F.col("s") == "O", "completed").otherwise("pending").alias("state")))


@query("from_run_scope", "SELECT doc_id AS id, ordinal FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id DESC) AS ordinal FROM documents WHERE n_chars > 2000 AND (source IS NOT NULL OR lang IS NOT NULL)) WHERE lang = 'en'")
def from_run_scope(spark, d):
    c = _corpus(spark, d)
    sel = collection.visible(c.docs, c.membership).where("file_size > 2000")
    c.snapshots = families.numbered(sel.select("id"), F.desc("id")).withColumn("run_id", F.lit(7)).select("run_id", "id", "ordinal")
    return resolve(Scope(filter="lang = 'en'", from_run=7), c).select("id", "ordinal")


# ---- texts, streams, vectors
@query("whitespace_normal_forms", "SELECT doc_id AS id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS inline, greatest(1, length(text) // 4) AS tokens FROM documents WHERE text IS NOT NULL")
def whitespace_normal_forms(spark, d):
    t = A.documents(spark, d).where("text is not null")
    return t.select("id", text.normalize_inline("text").alias("inline"), text.token_estimate("text").alias("tokens"))


@query("content_types_by_extension", """SELECT e AS extension, CASE e WHEN 'eml' THEN 'Email' WHEN 'docx' THEN 'E-Doc' WHEN 'txt' THEN 'E-Doc' WHEN 'pdf' THEN 'E-Doc' WHEN 'htm' THEN 'Web' WHEN 'sql' THEN 'Database' WHEN 'json' THEN 'Database' WHEN 'xml' THEN 'Web'
  WHEN 'py' THEN 'Source Code' WHEN 'png' THEN 'Image' WHEN 'mp3' THEN 'Audio' WHEN 'mp4' THEN 'Video' WHEN 'zip' THEN 'Container' WHEN 'ics' THEN 'Calendar' WHEN 'csv' THEN 'Spreadsheet / Table' WHEN 'pptx' THEN 'Presentation' WHEN 'dwg' THEN 'CAD' WHEN 'rsmf' THEN 'Message' END AS content_class, count(*) AS n
FROM (SELECT lower(regexp_extract(file_name, '\\.([A-Za-z0-9]{1,8})$', 1)) AS e FROM documents WHERE file_name IS NOT NULL UNION ALL SELECT unnest(['sql', 'json', 'xml', 'py', 'png', 'mp3', 'mp4', 'zip', 'ics', 'csv', 'pptx', 'dwg', 'rsmf', 'qqq'])) GROUP BY e""")
def content_types_by_extension(spark, d):
    more = spark.createDataFrame([(f"x.{e}",) for e in "sql json xml py png mp3 mp4 zip ics csv pptx dwg rsmf qqq".split()], "file_name string")
    names = A.documents(spark, d).where("file_name is not null").select("file_name").unionByName(more)
    return names.groupBy(text.extension("file_name").alias("extension"), text.content_type("file_name").alias("content_class")).agg(F.count("*").alias("n"))


@query("html_text")
def html_text(spark, d):
    return table(spark, d, "mail_messages").where("html_body is not null").select("mail_id", text.strip_html("html_body").alias("text"))


@query("activity_by_hour", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def activity_by_hour(spark, d):
    a = landing.activity(table(spark, d, "events"))
    return a.select(F.date_format("bucket_start", "yyyy-MM-dd HH").alias("bucket"), "event_type", "n", F.round("total", 2).alias("total"))


@query("event_properties", "SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def event_properties(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("nearest_vectors", "SELECT vec_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), 5) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 10")
def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.orderBy("vec_id").limit(1).first()["embedding"]]  # one query vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.array(*[F.lit(x) for x in q])
    c = dot(F.col("embedding"), v) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * F.lit(sum(x * x for x in q)))
    return e.select("vec_id", F.round(c, 5).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)
