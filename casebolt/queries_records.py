"""Queries of document views, reconciliation, jobs, entity decisions, filters on virtual fields and mail structure, with their DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from casebolt import adapters as A
from casebolt.common import table
from casebolt.functions import headers, identifiers, people
from casebolt.operators import collection, entities, jobs, occurrences, reconcile, records, search, upkeep
from casebolt.plans.scope import Corpus, Scope, resolve
from casebolt.queries_core import NAME_WORDS, _index, query

# ---- filters on virtual fields
_MAIL = "m AS (SELECT mail_id AS id, subject, account, from_addr, job_version_id AS jv FROM mail_messages WHERE account IS NOT NULL)"
_WHO = """who AS (SELECT id AS document_id, 'author' AS role, from_addr AS raw_value, NULL::BIGINT AS entity_id, NULL AS label FROM m
UNION ALL SELECT id, 'participant', from_addr, NULL, from_addr FROM m UNION ALL SELECT id, 'participant', account, NULL, account FROM m
UNION ALL SELECT id, 'custodian', account, NULL, account FROM m
UNION ALL SELECT m.id, 'recipient', 'to ' || jv, jv, coalesce(display_name, primary_email) FROM m JOIN entities ON entity_id = jv)"""


def _mail_corpus(spark, d) -> Corpus:
    """Mails as documents, their accounts as datasets, senders and accounts as people, the entity of the version's number as recipient; a third are
    attachments of another one, and every seventh belongs to a production."""
    m = A.mails(spark, d).where("custodian is not null").join(table(spark, d, "mail_messages").select(F.col("mail_id").alias("id"), F.col("job_version_id").alias("jv")), "id")
    docs = m.select("id", "subject", F.when(F.col("id") % 7 == 0, F.col("id") % 3).alias("production_id"), F.when(F.col("id") % 3 == 1, F.col("id") - 1).alias("parent_id"), F.when(F.col("id") % 2 == 0, "reply_thread").alias("child_kind"), F.lit("active").alias("lifecycle_status"))
    row = lambda role, raw, entity, label: F.struct(F.lit(role).alias("role"), raw.alias("raw_value"), entity.cast("long").alias("entity_id"), label.alias("label"))
    none, a, c = F.lit(None).cast("string"), F.col("author"), F.col("custodian")
    who = m.select(F.col("id").alias("document_id"), F.explode(F.array(row("author", a, none, none), row("participant", a, none, a), row("participant", c, none, c), row("custodian", c, none, c))).alias("x")).select("document_id", "x.*")
    e = table(spark, d, "entities").select(F.col("entity_id").alias("jv"), F.coalesce("display_name", "primary_email").alias("label"))
    to = m.join(e, "jv").select(F.col("id").alias("document_id"), F.lit("recipient").alias("role"), F.concat(F.lit("to "), "jv").alias("raw_value"), F.col("jv").alias("entity_id"), "label")
    names = spark.createDataFrame([(0, "Alpha"), (1, "Beta"), (2, "Gamma")], "production_id long, production_name string")
    member = m.select("custodian", F.col("id").alias("document_id")).withColumnRenamed("custodian", "dataset_name")
    return Corpus(docs, member, people=who.unionByName(to), productions=names)


def _virtual(name: str, expression: str, where: str):
    def run(spark, d):
        return resolve(Scope(filter=expression), _mail_corpus(spark, d)).select("id", "subject")

    query(f"filter_{name}", f"WITH {_MAIL}, {_WHO} SELECT id, subject FROM m WHERE {where}")(run)


_has = "EXISTS (SELECT 1 FROM who WHERE document_id = id AND role = '{}' AND {})".format
_virtual("production_name", "production_name = 'Beta' OR production_name LIKE 'gam%'", "id % 7 = 0 AND id % 3 IN (1, 2)")
_virtual("is_attachment", "is_attachment = true AND subject IS NOT NULL", "id % 3 = 1 AND id % 2 <> 0 AND subject IS NOT NULL")
_virtual("has_attachments", "has_attachments = true AND NOT is_attachment = true", "(id + 1) % 3 = 1 AND (id + 1) % 2 <> 0 AND (id + 1) IN (SELECT id FROM m) AND NOT (id % 3 = 1 AND id % 2 <> 0)")
_virtual("participant", "participant LIKE '%.example>' AND participant LIKE 'records%'", f"{_has('participant', 'label ILIKE $$%.example>$$')} AND {_has('participant', 'label ILIKE $$records%$$')}")
_virtual("recipient", "recipient LIKE 'P%' OR recipient IS NULL", f"{_has('recipient', 'label ILIKE $$P%$$')} OR NOT {_has('recipient', 'label IS NOT NULL')}")
_virtual("custodian", "custodian LIKE 'ursula%' OR NOT custodian LIKE '%a%r%'", f"{_has('custodian', 'label ILIKE $$ursula%$$')} OR NOT {_has('custodian', 'label ILIKE $$%a%r%$$')}")
_virtual("entity_ids", "recipient_entity_id BETWEEN 3 AND 9 AND recipients_entity_id != 5", f"{_has('recipient', 'entity_id BETWEEN 3 AND 9')} AND NOT {_has('recipient', 'entity_id = 5')}")
_virtual("raw_people", "raw_author LIKE '%<%' AND raw_recipients = 'to 7'", f"{_has('author', 'raw_value ILIKE $$%<%$$')} AND {_has('recipient', 'raw_value = $$to 7$$')}")


# ---- views
@query("document_view", """SELECT d.mail_id AS id, p.rfc822messageid AS parent_control_number, sha256(d.text_body) AS content_hash, length(d.text_body) AS char_count
FROM mail_messages d LEFT JOIN mail_messages p ON d.mail_id % 3 = 1 AND p.mail_id = d.mail_id - 1""")
def document_view(spark, d):
    m = table(spark, d, "mail_messages")
    docs = m.select(F.col("mail_id").alias("id"), F.when(F.col("mail_id") % 3 == 1, F.col("mail_id") - 1).alias("parent_id"), F.col("rfc822messageid").alias("control_number"))
    rev = m.where("text_body is not null").select((F.col("mail_id") * 10).alias("revision_id"), F.sha2("text_body", 256).alias("content_hash"), F.length("text_body").cast("long").alias("char_count"))
    act = m.where("text_body is not null").select(F.col("mail_id").alias("document_id"), (F.col("mail_id") * 10).alias("revision_id"))
    return records.with_parent_and_text(docs, rev, act).select("id", "parent_control_number", "content_hash", "char_count")


@query("threading_view", "SELECT doc_id AS id, message_id, thread_id FROM documents LEFT JOIN (SELECT mail_id, lower(rfc822messageid) AS message_id FROM mail_messages) ON mail_id = doc_id LEFT JOIN (SELECT DISTINCT document_id, 't' || (document_id % 9) AS thread_id FROM document_dedupe_keys WHERE basis = 'message_id' AND document_id IS NOT NULL) ON document_id = doc_id")
def threading_view(spark, d):
    mail = table(spark, d, "mail_messages").select(F.col("mail_id").alias("document_id"), F.lower("rfc822messageid").alias("message_id"))
    chat = table(spark, d, "document_dedupe_keys").where("basis = 'message_id' and document_id is not null").select("document_id", F.concat(F.lit("t"), F.col("document_id") % 9).alias("thread_id")).distinct()
    return records.with_threading(A.documents(spark, d).select("id"), mail, chat)


@query("keys_to_mend", """WITH w AS (SELECT sha256(text) AS key_value, max(doc_id) AS document_id FROM documents WHERE text IS NOT NULL GROUP BY 1), s AS (SELECT sha256(text) AS key_value, min(doc_id) AS has FROM documents WHERE text IS NOT NULL AND lang = 'en' GROUP BY 1)
SELECT document_id, key_value FROM w LEFT JOIN s USING (key_value) WHERE has IS NULL OR has <> document_id""")
def keys_to_mend(spark, d):
    t = A.documents(spark, d).where("text is not null")
    wanted = t.groupBy(F.col("file_hash").alias("key_value")).agg(F.max("id").alias("document_id"))
    return records.keys_to_mend(wanted, t.where("lang = 'en'").groupBy(F.col("file_hash").alias("key_value")).agg(F.min("id").alias("document_id")))


@query("bound_outputs", """SELECT DISTINCT document_id, o.field, dedupe_key_id AS output_id, key_value AS value FROM document_dedupe_keys k JOIN (VALUES ('file_hash', 'hash'), ('content_hash', 'text_hash'), ('message_id', NULL)) o(output_name, field) ON output_name = basis
WHERE document_id IS NOT NULL AND field IS NOT NULL""")
def bound_outputs(spark, d):
    k = table(spark, d, "document_dedupe_keys").where("document_id is not null")
    items = k.select("document_id", F.col("dedupe_key_id").alias("result_id"))
    out = k.select(F.col("dedupe_key_id").alias("result_id"), F.col("dedupe_key_id").alias("output_id"), F.col("basis").alias("output_name"), F.col("key_value").alias("value"))
    defs = spark.createDataFrame([("file_hash", "hash"), ("content_hash", "text_hash"), ("message_id", None)], "output_name string, field string")
    return records.bound_outputs(items.unionByName(items), out, defs)


@query("document_records", "SELECT doc_id AS id, control_number, left(text, 1200) AS summary, length(text) AS chars FROM documents")
def document_records(spark, d):
    return records.record(A.documents(spark, d).select("id", "control_number", "text"))


@query("search_parents_only", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 1 AND list_contains(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), 'audit')")
def search_parents_only(spark, d):
    docs = A.documents(spark, d).withColumn("parent_id", F.when(F.col("id") % 3 == 1, F.col("id") - 1))
    hits = search.rank(_index(spark, docs, "id", ["text"]), "audit")
    return records.parents_only(hits, docs).select(F.col("doc").alias("id"))


# ---- reconciliation
_GROUPED = """g AS (SELECT lower(rfc822messageid) AS k, meta_id AS id, subject, from_addr, filename FROM gmail_metadata WHERE rfc822messageid IS NOT NULL),
r AS (SELECT k, CASE WHEN min(id) % 5 <> 0 THEN 'ready' ELSE 'open' END AS status, count(*) AS n FROM g GROUP BY k),
f AS (SELECT g.*, CASE WHEN trim(subject) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(from_addr) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(filename) <> '' THEN 1 ELSE 0 END AS filled FROM g JOIN r USING (k) WHERE status = 'ready' AND n > 1),
s AS (SELECT k, arg_min(id, (-filled)::BIGINT * 1000000000 + id) AS survivor FROM f GROUP BY k)"""


def _reconciled(spark, d):
    g = table(spark, d, "gmail_metadata").where("rfc822messageid is not null").select(F.col("meta_id").alias("id"), F.lower("rfc822messageid").alias("k"), "subject", "from_addr", "filename")
    status = g.groupBy("k").agg(F.when(F.min("id") % 5 != 0, "ready").otherwise("open").alias("status"))
    groups = g.join(status, "k").select(F.col("k").alias("group_id"), F.col("id").alias("document_id"), "status")
    return reconcile.reconcile(g.drop("k"), groups, ["subject", "from_addr", "filename"])


@query("reconcile_duplicates", f"WITH {_GROUPED} SELECT meta_id AS id, CASE WHEN survivor IS NULL THEN 'active' ELSE 'merged' END AS canonical_status, survivor AS merged_into FROM gmail_metadata LEFT JOIN (SELECT f.id, survivor FROM f JOIN s USING (k) WHERE f.id <> survivor) x ON x.id = meta_id WHERE rfc822messageid IS NOT NULL")
def reconcile_duplicates(spark, d):
    return _reconciled(spark, d)[0].select("id", "canonical_status", "merged_into")


_LOG_COPIES = """c AS (SELECT 'k' || doc_id % 40 AS k, doc_id AS id, lang, source FROM documents),
f AS (SELECT *, CASE WHEN trim(lang) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(source) <> '' THEN 1 ELSE 0 END AS filled FROM c), s AS (SELECT k, arg_min(id, (-filled)::BIGINT * 1000000000 + id) AS survivor FROM f GROUP BY k HAVING count(*) > 1),
l AS (SELECT k, id, 'lang' AS field_name, lang AS v FROM c UNION ALL SELECT k, id, 'source', source FROM c)"""


@query("reconcile_conflicts", f"WITH {_LOG_COPIES} SELECT o.k AS group_id, o.id AS document_id, o.field_name, x.v AS kept, o.v AS other FROM l o JOIN s USING (k) JOIN l x ON x.k = o.k AND x.id = survivor AND x.field_name = o.field_name WHERE o.id <> survivor AND trim(o.v) <> '' AND o.v IS DISTINCT FROM x.v")
def reconcile_conflicts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    groups = docs.select(F.concat(F.lit("k"), F.col("id") % 40).alias("group_id"), F.col("id").alias("document_id"), F.lit("ready").alias("status"))
    return reconcile.reconcile(docs, groups, ["lang", "source"])[1]


_SCAN = """g AS (SELECT meta_id AS id, account, loaded_at FROM gmail_metadata WHERE coalesce(filename, '') <> ''),
c AS (SELECT g.id, p.id AS pid, g.account, g.loaded_at FROM g LEFT JOIN g p ON g.id % 4 = 1 AND p.id = g.id - 1 AND p.account = g.account),
r AS (SELECT id FROM c WHERE pid IS NULL AND account = 'records.desk@nasstrom.example' AND loaded_at <> TIMESTAMPTZ '2024-01-01 00:00:00+00')"""


@query("retire_unseen", f"WITH {_SCAN} SELECT id, CASE WHEN coalesce(pid, id) IN (SELECT id FROM r) THEN 'deleted' ELSE 'active' END AS lifecycle_status FROM c")
def retire_unseen(spark, d):
    g = table(spark, d, "gmail_metadata").where("coalesce(filename, '') <> ''")
    copies = g.select(F.col("meta_id").alias("id"), F.when(F.col("meta_id") % 4 == 1, F.col("meta_id") - 1).alias("before"), F.col("account").alias("source"), F.col("loaded_at").alias("last_seen_at"), F.lit("active").alias("lifecycle_status"))
    parents = copies.where("before is null").select(F.col("id").alias("before"), F.col("id").alias("parent_id"), "source")
    copies = copies.join(parents, ["before", "source"], "left").drop("before")
    return reconcile.retire_unseen(copies, "records.desk@nasstrom.example", F.lit(datetime(2024, 1, 1)).cast("timestamp")).select("id", "lifecycle_status")


_SUP = """c AS (SELECT meta_id AS id, lower(rfc822messageid) AS document_id, 'p' || meta_id AS path, sha256(coalesce(subject, '')) AS h FROM gmail_metadata WHERE rfc822messageid IS NOT NULL),
s AS (SELECT 'p' || meta_id AS path, CASE WHEN meta_id % 6 = 0 THEN 'x' ELSE sha256(coalesce(subject, '')) END AS h FROM gmail_metadata WHERE meta_id % 10 <> 0)"""


@query("supersede_copies", f"WITH {_SUP} SELECT c.id, CASE WHEN s.path IS NULL THEN 'unseen' WHEN s.h = c.h THEN 'kept' WHEN count(*) OVER (PARTITION BY document_id) > 1 THEN 'superseded' ELSE 'updated' END AS action FROM c LEFT JOIN s USING (path)")
def supersede_copies(spark, d):
    g = table(spark, d, "gmail_metadata")
    h, path = F.sha2(F.coalesce("subject", F.lit("")), 256), F.concat(F.lit("p"), "meta_id").alias("path")
    copies = g.where("rfc822messageid is not null").select(F.col("meta_id").alias("id"), F.lower("rfc822messageid").alias("document_id"), path, h.alias("file_hash"))
    return reconcile.supersede(copies, g.where("meta_id % 10 <> 0").select(path, F.when(F.col("meta_id") % 6 == 0, "x").otherwise(h).alias("file_hash"))).select("id", "action")


@query("mark_missing", "SELECT doc_id AS id, CASE WHEN coalesce(p, doc_id) % 11 = 0 THEN 'missing' ELSE 'active' END AS lifecycle_status FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND doc_id > 1 THEN doc_id - 1 END AS p FROM documents)")
def mark_missing(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") > 1), F.col("doc_id") - 1).alias("parent_id"), F.concat(F.lit("p/"), "doc_id").alias("rel_path"), F.lit("active").alias("lifecycle_status"))
    return reconcile.mark_missing(t, t.where("id % 11 <> 0").select("rel_path")).select("id", "lifecycle_status")


@query("dataset_delete", "SELECT DISTINCT doc_id AS document_id FROM documents WHERE source = 'scan_ocr' AND lang IS NULL")
def dataset_delete(spark, d):
    t = table(spark, d, "documents")
    member = t.select(F.explode(F.array_compact(F.array("source", F.concat(F.lit("lang:"), "lang")))).alias("dataset_id"), F.col("doc_id").alias("document_id"))
    return reconcile.delete_dataset(member.select("dataset_id").distinct(), member, "scan_ocr")[2]


@query("locked_fields", """WITH f AS (SELECT lower(rfc822messageid) AS document_id, min(subject) AS subject, min(from_addr) AS author FROM gmail_metadata WHERE rfc822messageid IS NOT NULL GROUP BY 1),
s AS (SELECT lower(rfc822messageid) AS document_id, min(subject) AS subject FROM mail_messages WHERE rfc822messageid IS NOT NULL GROUP BY 1)
SELECT f.document_id, CASE WHEN s.document_id IS NOT NULL THEN s.subject ELSE f.subject END AS subject, f.author FROM f LEFT JOIN s USING (document_id)""")
def locked_fields(spark, d):
    shape = lambda n: table(spark, d, n).where("rfc822messageid is not null").groupBy(F.lower("rfc822messageid").alias("document_id")).agg(F.min("subject").alias("subject"), F.min("from_addr").alias("author"))
    return occurrences.keep_locked(shape("gmail_metadata"), shape("mail_messages").withColumn("locked", F.array(F.lit("subject"))), ["subject", "author"])


@query("attachment_manifests", "SELECT l_orderkey AS message_id, string_agg(sha256(l_returnflag) || '|' || l_linestatus || '|' || l_linenumber, chr(10) ORDER BY sha256(l_returnflag), l_linestatus, l_linenumber) AS manifest FROM lineitem GROUP BY 1")
def attachment_manifests(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linestatus").alias("name"), F.col("l_linenumber").alias("size"), F.sha2("l_returnflag", 256).alias("file_hash"))
    return upkeep.attachment_manifests(l)


@query("dataset_sources", "SELECT source AS dataset_name, count(DISTINCT doc_id) FILTER (doc_id % 3 = 0) AS manual_documents, count(DISTINCT doc_id) FILTER (doc_id % 3 <> 0) AS source_documents FROM documents WHERE source IS NOT NULL GROUP BY 1")
def dataset_sources(spark, d):
    docs = A.documents(spark, d).withColumns({"custodian": F.col("lang"), "date_created": F.lit(None).cast("timestamp"), "date_modified": F.lit(None).cast("timestamp")})
    m = docs.where("dataset_name is not null").select("dataset_name", F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 0, "manual").otherwise("filesystem").alias("source"))
    return collection.dataset_summary(docs.drop("dataset_name"), m).select("dataset_name", "manual_documents", "source_documents")


# ---- jobs
@query("next_job_versions", "SELECT n.id AS ident, n.job_id, (coalesce(m, 0) + row_number() OVER (PARTITION BY n.job_id ORDER BY n.id))::INTEGER AS version FROM (SELECT doc_id AS id, doc_id % 20 AS job_id FROM documents WHERE lang = 'es') n LEFT JOIN (SELECT job_id, max(version) AS m FROM job_versions GROUP BY 1) v ON v.job_id = n.job_id")
def next_job_versions(spark, d):
    new = table(spark, d, "documents").where("lang = 'es'").select(F.col("doc_id").alias("ident"), (F.col("doc_id") % 20).alias("job_id"))
    return jobs.next_versions(table(spark, d, "job_versions"), new).select("ident", "job_id", "version")


@query("latest_job_versions", "SELECT job_id, arg_max(job_version_id, version * 1000000 + job_version_id) AS job_version_id, max(version) AS version FROM job_versions GROUP BY job_id")
def latest_job_versions(spark, d):
    return jobs.latest_versions(table(spark, d, "job_versions"))


@query("selection_reasons", "SELECT doc_id AS id, 'filter: lang = ''de''; dataset: legacy_dms, scan_ocr' AS reasons FROM documents WHERE lang = 'de' AND source IN ('legacy_dms', 'scan_ocr')")
def selection_reasons(spark, d):
    s = Scope(filter=" lang  = 'de' ").within_datasets("legacy_dms", "scan_ocr")
    got = jobs.with_reasons(resolve(s, Corpus(A.documents(spark, d), A.membership(spark, d))), s)
    return got.select("id", F.array_join(F.transform("reasons", lambda r: F.concat(r["type"], F.lit(": "), r["detail"])), "; ").alias("reasons"))


_REV = "store AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND lang = 'en'), new AS (SELECT DISTINCT doc_id, sha256(coalesce(text, '')) AS h, length(coalesce(text, '')) AS n FROM documents WHERE lang IN ('en', 'fr'))"


@query("text_revisions_added", f"WITH {_REV} SELECT doc_id AS document_id, h AS content_hash, n AS char_count FROM new WHERE (doc_id, h) NOT IN (SELECT doc_id, h FROM store)")
def text_revisions_added(spark, d):
    t = table(spark, d, "documents")
    row = lambda df: df.select(F.col("doc_id").alias("document_id"), F.lit("source").alias("revision_kind"), F.lit(None).cast("long").alias("parent_revision_id"), "text")
    store = jobs.add_revisions(spark.createDataFrame([], jobs.REVISIONS), row(t.where("text is not null and lang = 'en'")))
    new = row(t.where("lang in ('en', 'fr')"))
    after = jobs.add_revisions(store, new.unionByName(new))
    return after.join(store.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti").select("document_id", "content_hash", "char_count")


@query("activated_chunks", "SELECT doc_id AS document_id, length(trim(text)) > 0 AS has_text FROM documents WHERE doc_id % 4 = 0 AND length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) > 0")
def activated_chunks(spark, d):
    t = table(spark, d, "documents")
    rev = t.select((F.col("doc_id") * 10).alias("revision_id"), F.col("doc_id").alias("document_id"), "text")
    docs = t.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") * 10).alias("active_revision_id"))
    want = rev.select("document_id", "revision_id", F.lit(1).alias("activated_at"), F.lit(False).alias("by_job"))
    return jobs.activate(docs, rev, want)[1].groupBy("document_id").agg(F.lit(True).alias("has_text"))


# ---- entities
@query("entity_hints", """WITH h AS (SELECT DISTINCT entity_id AS document_id, lower(display_value) AS k FROM entity_identifiers WHERE lower(trim(identifier_type)) = 'name' AND is_primary = 1 AND display_value IS NOT NULL),
t AS (SELECT DISTINCT entity_id AS document_id, lower(display_value) AS k FROM entity_identifiers WHERE lower(trim(identifier_type)) IN ('name', 'email') AND display_value IS NOT NULL)
SELECT document_id, k AS candidate_key, 'hint' AS source FROM h UNION ALL SELECT document_id, k, 'text' FROM t WHERE (document_id, k) NOT IN (SELECT document_id, k FROM h)""")
def entity_hints(spark, d):
    i = table(spark, d, "entity_identifiers").where("display_value is not null").withColumn("kind", F.lower(F.trim("identifier_type")))
    k = F.lower("display_value")
    rows = i.select(F.col("entity_id").alias("document_id"), F.lit("author").alias("role"), F.col("identifier_id").alias("position"), k.alias("candidate_key"), F.array(k).alias("match_keys"), "kind", "is_primary")
    cut = lambda df: df.drop("kind", "is_primary")
    return entities.with_hints(cut(rows.where("kind = 'name' and is_primary = 1")), cut(rows.where("kind in ('name', 'email')"))).select("document_id", "candidate_key", "source")


@query("entity_merge", """WITH b AS (SELECT DISTINCT least(left_entity_id, right_entity_id) AS lo, greatest(left_entity_id, right_entity_id) AS hi FROM entity_merge_blocks WHERE block_id % 2 = 0),
p AS (SELECT left_entity_id AS s, right_entity_id AS t FROM entity_merge_blocks WHERE left_entity_id <> right_entity_id),
o AS (SELECT s, min(t) AS t FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE lo = least(s, t) AND hi = greatest(s, t)) GROUP BY s)
SELECT entity_id, CASE WHEN t IS NOT NULL THEN 'merged' ELSE canonical_status END AS canonical_status, t AS merged_into FROM entities LEFT JOIN o ON s = entity_id""")
def entity_merge(spark, d):
    b = table(spark, d, "entity_merge_blocks").where("left_entity_id is not null and right_entity_id is not null")
    e = table(spark, d, "entities").withColumn("merged_into", F.lit(None).cast("long"))
    return entities.merge(e, b.select(F.col("left_entity_id").alias("source_id"), F.col("right_entity_id").alias("target_id")), b.where("block_id % 2 = 0")).select("entity_id", "canonical_status", "merged_into")


@query("entity_listing", """SELECT entity_id, coalesce(CASE WHEN n IS NOT NULL AND m IS NOT NULL AND lower(n) <> lower(m) THEN n || ' <' || m || '>' END, n, m, p, 'Unknown Entity ' || entity_id) AS label, entity_type, (SELECT count(DISTINCT provider_scope) FROM entity_identifiers i WHERE i.entity_id = e.entity_id) AS documents
FROM (SELECT *, nullif(trim(display_name), '') AS n, nullif(trim(primary_email), '') AS m, nullif(trim(primary_phone), '') AS p FROM entities WHERE canonical_status = 'active') e""")
def entity_listing(spark, d):
    links = table(spark, d, "entity_identifiers").where("provider_scope is not null").select("entity_id", F.col("provider_scope").alias("document_id"))
    return entities.listing(table(spark, d, "entities"), links)


@query("entity_ignored_edited", "SELECT entity_id, CASE WHEN entity_id % 9 = 0 THEN 'ignored' ELSE canonical_status END AS canonical_status, CASE WHEN entity_id % 5 = 0 THEN 'Named ' || entity_id ELSE display_name END AS display_name FROM entities")
def entity_ignored_edited(spark, d):
    e = table(spark, d, "entities")
    changes = e.where("entity_id % 5 = 0").select("entity_id", F.concat(F.lit("Named "), "entity_id").alias("display_name"))
    return entities.edit(entities.ignore(e, e.where("entity_id % 9 = 0")), changes, ["display_name"]).select("entity_id", "canonical_status", "display_name")


@query("entity_assignments", """WITH l AS (SELECT DISTINCT provider_scope AS document_id, entity_id FROM entity_identifiers WHERE provider_scope IS NOT NULL)
SELECT document_id, entity_id FROM l WHERE entity_id % 4 <> 0 UNION SELECT 'case-x', entity_id FROM l WHERE entity_id % 6 = 0""")
def entity_assignments(spark, d):
    i = table(spark, d, "entity_identifiers").where("provider_scope is not null")
    links = i.select(F.col("provider_scope").alias("document_id"), F.lit("author").alias("role"), "entity_id")
    off = links.where("entity_id % 4 = 0").select("*", F.lit("unassign").alias("action"), F.lit(2).alias("at"))
    on = links.where("entity_id % 6 = 0").select(F.lit("case-x").alias("document_id"), "role", "entity_id", F.lit("assign").alias("action"), F.lit(1).alias("at"))
    return entities.assign(links, off.unionByName(on)).select("document_id", "entity_id")


# ---- mails printed as texts
@query("own_mail_headers", """WITH t AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE regexp_matches(text, '^From: [^\\r\\n]*[\\r\\n]+To: [^\\r\\n]*[\\r\\n]+Subject: '))
SELECT doc_id AS id, trim(regexp_replace(regexp_extract(t, '^From: ([^\\n]*)', 1), '\\s+', ' ', 'g')) AS sender, trim(regexp_replace(regexp_extract(t, '^From: [^\\n]*\\n+To: ([^\\n]*)', 1), '\\s+', ' ', 'g')) AS recipients FROM t""")
def own_mail_headers(spark, d):
    h = A.documents(spark, d).select("id", headers.own_headers("text").alias("h"), F.col("text").rlike("^From: [^\\r\\n]*[\\r\\n]+To: [^\\r\\n]*[\\r\\n]+Subject: ").alias("asked"))
    return h.where("asked and h.from is not null").select("id", F.col("h.from").alias("sender"), F.col("h.to").alias("recipients"))


@query("header_chain_people", None)
def header_chain_people(spark, d):
    m = table(spark, d, "mail_messages").where("text_body is not null").select("mail_id", headers.blocks("text_body").alias("b"))
    return m.where("size(b) > 0").select("mail_id", F.size("b").alias("blocks"), F.array_join(headers.chain_people(F.col("b")), "; ").alias("people"))


@query("full_names", "SELECT identifier_id, NOT contains(display_value, '@') AND len(" + NAME_WORDS.format("display_value") + ") >= 2 AS is_full FROM entity_identifiers WHERE lower(trim(identifier_type)) = 'name' AND display_value IS NOT NULL")
def full_names(spark, d):
    i = table(spark, d, "entity_identifiers").where("lower(trim(identifier_type)) = 'name' and display_value is not null")
    return i.select("identifier_id", people.is_full_name("display_value").alias("is_full"))


@query("handle_normalise", "SELECT identifier_id, CASE WHEN regexp_full_match(v, '[a-z0-9._-]{2,128}') THEN v END AS handle FROM (SELECT identifier_id, lower(regexp_replace(regexp_replace(trim(display_value), '^@', ''), '\\s+', '', 'g')) AS v FROM entity_identifiers WHERE lower(trim(identifier_type)) = 'handle')")
def handle_normalise(spark, d):
    return table(spark, d, "entity_identifiers").where(F.lower(F.trim("identifier_type")) == "handle").select("identifier_id", identifiers.handle("display_value").alias("handle"))
