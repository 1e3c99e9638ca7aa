"""More queries of the document engine: upkeep, names, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebolt import adapters as A
from casebolt.common import table
from casebolt.functions import people, text
from casebolt.operators import collection, conversations, families, runs, upkeep
from casebolt.queries_core import CHUNKS, NAME_WORDS, _FAM, _SEEN, _seen, query  # the same registry


@query("membership_refresh", f"WITH {_FAM} SELECT f.id AS document_id, o_orderpriority AS dataset_name FROM fam f JOIN orders ON o_orderkey * 1000 = coalesce(f.parent_id, f.id)")
def membership_refresh(spark, d):
    m = table(spark, d, "orders").select((F.col("o_orderkey") * 1000).alias("document_id"), F.col("o_orderpriority").alias("dataset_name"))
    return upkeep.refresh_membership(A.families(spark, d), m)


@query("message_content_hash", "SELECT mail_id AS id, sha256(coalesce('+' || subject, '-') || chr(31) || coalesce('+' || from_addr, '-') || chr(31) || coalesce('+' || text_body, '-')) AS hash FROM mail_messages")
def message_content_hash(spark, d):
    return table(spark, d, "mail_messages").select(F.col("mail_id").alias("id"), upkeep.content_hash("subject", "from_addr", "text_body").alias("hash"))


@query("load_file_states", f"""WITH {_SEEN} SELECT coalesce(g.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'retired' WHEN g.path IS NULL THEN 'new' WHEN g.subject IS NOT DISTINCT FROM m.subject AND g.author IS NOT DISTINCT FROM m.author THEN 'unchanged' ELSE 'changed' END AS state FROM g FULL JOIN m ON g.path = m.path""")
def load_file_states(spark, d):
    return upkeep.load_state(_seen(spark, d, "gmail_metadata", "meta_id"), _seen(spark, d, "mail_messages", "mail_id"), "path", ["subject", "from_addr"])


@query("delete_documents", f"WITH {_FAM}, s AS (SELECT o_orderkey * 1000 AS id FROM orders WHERE o_totalprice > 200000) SELECT id, CASE WHEN coalesce(parent_id, id) IN (SELECT id FROM s) THEN 'deleted' ELSE lifecycle_status END AS lifecycle_status FROM fam")
def delete_documents(spark, d):
    sel = table(spark, d, "orders").where("o_totalprice > 200000").select((F.col("o_orderkey") * 1000).alias("id"))
    return upkeep.delete(A.families(spark, d), sel).select("id", "lifecycle_status")


@query("containers_to_repair", "SELECT DISTINCT account AS container FROM gmail_metadata WHERE account IS NOT NULL AND lower(rfc822messageid) NOT IN (SELECT lower(rfc822messageid) FROM mail_messages WHERE rfc822messageid IS NOT NULL)")
def containers_to_repair(spark, d):
    g = table(spark, d, "gmail_metadata").where("account is not null and rfc822messageid is not null").select(F.col("account").alias("container"), F.lower("rfc822messageid").alias("item_id"))
    have = table(spark, d, "mail_messages").where("rfc822messageid is not null").select(F.lower("rfc822messageid").alias("item_id"))
    return upkeep.repair_needed(g.select("container").distinct(), g, have)


@query("link_enrichment", """WITH l AS (SELECT DISTINCT mail_id AS id, unnest(regexp_extract_all(text_body, '[A-Z]{3}-\\d{4,8}')) AS ref FROM mail_messages), r AS (SELECT DISTINCT upper(regexp_extract(file_name, '([a-z]{3}-\\d{4,8})\\.', 1)) AS ref, file_name AS title FROM documents WHERE file_name IS NOT NULL)
SELECT m.mail_id AS id, string_agg(DISTINCT title, '; ' ORDER BY title) AS titles FROM mail_messages m LEFT JOIN l ON l.id = m.mail_id LEFT JOIN r ON r.ref = l.ref GROUP BY m.mail_id""")
def link_enrichment(spark, d):
    m = table(spark, d, "mail_messages").select(F.col("mail_id").alias("id"), "text_body")
    links = m.select("id", F.explode(F.regexp_extract_all("text_body", F.lit("([A-Z]{3}-\\d{4,8})"), F.lit(1))).alias("ref"))
    right = table(spark, d, "documents").where("file_name is not null").select(F.upper(F.regexp_extract("file_name", "([a-z]{3}-\\d{4,8})\\.", 1)).alias("ref"), F.col("file_name").alias("title"))
    return upkeep.enrich(m, links, right)


@query("family_page", f"""WITH {_FAM}, p AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS ordinal FROM (SELECT id FROM fam WHERE parent_id IS NULL ORDER BY id DESC LIMIT 20))
SELECT id, ordinal, 0 AS depth, NULL::BIGINT AS parent_id FROM p UNION ALL SELECT f.id, p.ordinal, 1, p.id FROM p JOIN fam f ON f.parent_id = p.id AND coalesce(f.child_kind, 'attachment') = 'attachment'""")
def family_page(spark, d):
    f = A.families(spark, d)
    page = collection.page(f.where("parent_id is null"), [F.desc("id")], 1, 20)
    return upkeep.family_rows(families.numbered(page.select("id"), F.desc("id")), f)


@query("chunk_listing", f"WITH RECURSIVE {CHUNKS} SELECT document_id, chunk_index, char_start, char_end FROM chunk WHERE document_id = (SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY length(text) DESC, doc_id LIMIT 1) ORDER BY chunk_index LIMIT 50")
def chunk_listing(spark, d):
    docs = A.documents(spark, d)
    longest = docs.where("text is not null").orderBy(F.desc(F.length("text")), "id").limit(1).first()  # one document
    return upkeep.chunk_page(text.chunks(docs.where(F.col("id") == longest["id"])), longest["id"]).select("document_id", "chunk_index", "char_start", "char_end")


@query("run_page_items", "SELECT doc_id AS id, unnest(generate_series(1, greatest(coalesce(n_chars, 0) // 1000, 1))) AS page FROM documents WHERE lang = 'de'")
def run_page_items(spark, d):
    docs = A.documents(spark, d).where("lang = 'de'")
    snap = runs.snapshot(docs, docs, [F.col("id")])
    return upkeep.page_items(snap, docs.select("id", F.floor(F.col("file_size") / 1000).cast("int").alias("page_count"))).select("id", "page")


@query("attempt_numbers", "SELECT dedupe_key_id AS id, row_number() OVER (PARTITION BY document_id ORDER BY created_at, dedupe_key_id) AS attempt FROM document_dedupe_keys WHERE document_id IS NOT NULL")
def attempt_numbers(spark, d):
    log = table(spark, d, "document_dedupe_keys").where("document_id is not null").select(F.col("dedupe_key_id").alias("id"), F.col("document_id").alias("item_id"), F.col("created_at").alias("at"))
    return upkeep.attempts(log).select("id", "attempt")


@query("best_sidecar_record", "SELECT lower(rfc822messageid) AS message_id, meta_id FROM gmail_metadata WHERE rfc822messageid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(rfc822messageid) ORDER BY (filename IS NULL), (labels IS NULL), -coalesce(length(subject), 0), meta_id) = 1")
def best_sidecar_record(spark, d):
    g = table(spark, d, "gmail_metadata").where("rfc822messageid is not null").withColumn("message_id", F.lower("rfc822messageid"))
    return upkeep.best_record(g, "message_id", [F.col("filename").isNull(), F.col("labels").isNull(), -F.coalesce(F.length("subject"), F.lit(0)), F.col("meta_id")]).select("message_id", "meta_id")


@query("selection_intersection", "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND n_chars > 1000 AND source = 'legacy_dms'")
def selection_intersection(spark, d):
    docs = A.documents(spark, d).select("id", "lang", "file_size", "dataset_name", F.col("id").alias("ordinal"))
    return runs.intersect([docs.where("lang = 'en'"), docs.where("file_size > 1000"), docs.where("dataset_name = 'legacy_dms'")]).select("id")


@query("unsupported_conversations", "SELECT doc_id AS id, CASE WHEN content_type IN ('Email', 'Chat') THEN 'c' || doc_id END AS conversation_id FROM documents")
def unsupported_conversations(spark, d):
    docs = A.documents(spark, d).select("id", "content_type", F.lit(None).cast("long").alias("parent_id"), F.concat(F.lit("c"), "id").alias("conversation_id"), F.lit("manual").alias("assignment_mode"))
    return conversations.clear_unsupported(docs).select("id", "conversation_id")


@query("manual_overlay", "SELECT d.doc_id AS id, CASE WHEN k.document_id IS NOT NULL THEN k.v ELSE 'auto' END AS conversation_id FROM documents d LEFT JOIN (SELECT document_id, arg_max(coalesce(basis, '-'), dedupe_key_id) AS v FROM document_dedupe_keys WHERE document_id IS NOT NULL GROUP BY 1) k ON k.document_id = d.doc_id")
def manual_overlay(spark, d):
    docs = A.documents(spark, d).select("id", F.lit("auto").alias("conversation_id"), F.lit("auto").alias("assignment_mode"))
    man = table(spark, d, "document_dedupe_keys").where("document_id is not null").select(F.col("document_id").alias("id"), F.coalesce("basis", F.lit("-")).alias("conversation_id"), F.col("dedupe_key_id").alias("assigned_at"))
    return conversations.overlay(docs, man).select("id", "conversation_id")


@query("timeline_segments", "SELECT user_id AS conversation_id, strftime(ts, '%Y-%m') AS segment, count(*) AS n FROM events GROUP BY ALL")
def timeline_segments(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("date_created"), F.lit(None).cast("timestamp").alias("date_modified"), F.lit("").alias("path"), F.lit("Chat").alias("content_type"), F.col("event_type").alias("text"))
    return conversations.timeline(e).groupBy("conversation_id", "segment").agg(F.count("*").alias("n"))


_FORM = r"trim(regexp_replace(regexp_replace(lower(array_to_string({}, ' ')), '[^\p{{L}}\p{{N}}_@.+#/-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMES = ("WITH i AS (SELECT identifier_id, trim(regexp_replace(display_value, '\\s+', ' ', 'g')) AS t FROM entity_identifiers WHERE lower(trim(identifier_type)) = 'name'), "
  "h AS (SELECT identifier_id, t, CASE WHEN contains(t, ',') THEN " + NAME_WORDS.format("split_part(t, ',', 1)") + " ELSE [] END AS f, CASE WHEN contains(t, ',') THEN " + NAME_WORDS.format("regexp_replace(t, '^[^,]*,', '')") + " ELSE [] END AS g, " + NAME_WORDS.format("t") + " AS w FROM i), "
  "x AS (SELECT identifier_id, NOT contains(t, '@') AND len(w) > 0 AS ok, CASE WHEN len(f) > 0 AND len(g) > 0 THEN g WHEN len(w) > 1 THEN w[:-2] ELSE w END AS given, CASE WHEN len(f) > 0 AND len(g) > 0 THEN f WHEN len(w) > 1 THEN w[-1:] ELSE [] END AS family FROM h) "
  "SELECT identifier_id, CASE WHEN ok THEN given[1] END AS given, CASE WHEN ok THEN nullif(array_to_string(given[2:], ' '), '') END AS middle, CASE WHEN ok THEN nullif(array_to_string(family, ' '), '') END AS family, "
  "CASE WHEN ok THEN " + _FORM.format("list_concat(given, family)") + " END AS full_name, CASE WHEN ok THEN " + _FORM.format("list_concat(family, given)") + " END AS sort_name, CASE WHEN ok THEN len(family) > 0 END AS is_full FROM x")  # fmt: skip


@query("name_parts", _NAMES)
def name_parts(spark, d):
    i = table(spark, d, "entity_identifiers").where(F.lower(F.trim("identifier_type")) == "name")
    return i.select("identifier_id", people.name_parts("display_value").alias("p")).select("identifier_id", "p.*")


@query("value_lists")
def value_lists(spark, d):
    return table(spark, d, "gmail_metadata").select("meta_id", F.explode(people.value_list("to_addr")).alias("value"))


@query("artefact_names", "SELECT identifier_id FROM entity_identifiers WHERE starts_with(display_value, '-') OR (NOT regexp_matches(lower(display_value), '[aeiouyäöüáéíóúèàâêîôûñ]') AND regexp_matches(display_value, '[A-Za-z]')) OR (regexp_full_match(display_value, '[A-Za-z0-9_-]{4,8}') AND regexp_matches(display_value, '[a-z]') AND regexp_matches(display_value, '[A-Z]') AND regexp_matches(display_value, '[0-9_-]'))")
def artefact_names(spark, d):
    return table(spark, d, "entity_identifiers").where(people.artefact("display_value")).select("identifier_id")


@query("candidate_keys", """SELECT entity_id, array_to_string(list_sort(list_filter([CASE WHEN trim(primary_email) <> '' THEN 'email:' || lower(trim(primary_email)) END, CASE WHEN trim(display_name) <> '' THEN 'name:' || lower(trim(display_name)) END, CASE WHEN trim(primary_phone) <> '' THEN 'phone:' || lower(trim(primary_phone)) END], lambda x: x IS NOT NULL)), '|') AS keys FROM entities""")
def candidate_keys(spark, d):
    e = table(spark, d, "entities")
    return e.select("entity_id", F.array_join(people.candidate_keys(F.col("display_name"), F.col("primary_email"), F.col("primary_phone"), F.lit(None).cast("string")), "|").alias("keys"))
