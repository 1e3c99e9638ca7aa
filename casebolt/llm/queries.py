"""Registry of the subpackage's queries: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebolt.common import table
from casebolt.llm import groups, mixing, pieces, tokens

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_P2 = r"""
WITH n AS (SELECT job_version_id, lower(segment_profile) AS s, regexp_extract_all(lower(segment_profile), '\d[\d.,_]*\s*k?\s*%?') AS xs FROM job_versions),
v AS (SELECT job_version_id, list_transform(list_filter(xs, lambda x: NOT contains(x, '%')), lambda x: CAST(regexp_replace(x, '[^\d.]', '', 'g') AS DOUBLE) * CASE WHEN contains(x, 'k') THEN 1000 ELSE 1 END) AS plain,
  list_transform(list_filter(xs, lambda x: contains(x, '%')), lambda x: CAST(regexp_replace(x, '[^\d.]', '', 'g') AS DOUBLE)) AS part FROM n WHERE trim(s) <> ''),
l AS (SELECT job_version_id, CAST(list_max(plain) AS INTEGER) AS max_chars, CAST(CASE WHEN len(part) > 0 THEN round(list_max(plain) * part[1] / 100) WHEN len(plain) > 1 THEN list_min(plain) ELSE 250 END AS INTEGER) AS overlap_chars FROM v)
SELECT mail_id, coalesce(max_chars, 3200) AS max_chars, coalesce(overlap_chars, 250) AS overlap_chars FROM mail_messages LEFT JOIN l USING (job_version_id) WHERE length(text_body) > coalesce(max_chars, 3200)
"""


@query("p2_found", _P2)
def p2_found(spark, d):
    return pieces.found(table(spark, d, "mail_messages"), table(spark, d, "job_versions"))


@query("p2_pieces")
def p2_pieces(spark, d):
    return pieces.split_mails(table(spark, d, "mail_messages"), table(spark, d, "job_versions"))


_P4 = """
WITH RECURSIVE k AS (
  SELECT basis, lower(regexp_replace(key_value, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS k, document_id * 2 AS v
  FROM document_dedupe_keys WHERE document_id IS NOT NULL AND basis IS NOT NULL),
kk AS (SELECT * FROM k WHERE k <> ''),
star AS (SELECT v AS a, min(v) OVER (PARTITION BY basis, k) AS b FROM kk),
ent AS (SELECT left_entity_id * 2 + 1 AS a, right_entity_id * 2 + 1 AS b FROM entity_merge_blocks
        WHERE left_entity_id IS NOT NULL AND right_entity_id IS NOT NULL),
edge AS (SELECT a, b FROM star UNION SELECT b, a FROM star UNION SELECT a, b FROM ent UNION SELECT b, a FROM ent),
vert AS (SELECT a AS v FROM edge UNION SELECT b FROM edge),
reach AS (SELECT v, v AS r FROM vert UNION SELECT e.b, r.r FROM reach r JOIN edge e ON e.a = r.v)
SELECT CASE WHEN v % 2 = 0 THEN 'document' ELSE 'entity' END AS record_kind, v // 2 AS record_id, min(r) // 2 AS group_id
FROM reach GROUP BY v
"""


@query("p4_found", _P4)
def p4_found(spark, d):
    return groups.consolidate(table(spark, d, "document_dedupe_keys"), table(spark, d, "entity_merge_blocks"))


@query("p4_group_sizes", f"SELECT record_kind, members, count(*) AS n_groups FROM (SELECT record_kind, group_id, count(*) AS members FROM ({_P4}) GROUP BY ALL) GROUP BY ALL")
def p4_group_sizes(spark, d):
    g = groups.consolidate(table(spark, d, "document_dedupe_keys"), table(spark, d, "entity_merge_blocks"))
    return g.groupBy("record_kind", "group_id").agg(F.count("*").alias("members")).groupBy("record_kind", "members").agg(F.count("*").alias("n_groups"))


@query("p8_ids")
def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


@query("p9_selected")
def p9_selected(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark, d):
    t = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), t), t)


# every pair of records with a common word sequence, and what is linked over any number of them
_P1 = r"""
WITH RECURSIVE src AS (SELECT 'document' AS k, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'mail', mail_id, text_body FROM mail_messages),
w AS (SELECT k, id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS ws FROM src WHERE t IS NOT NULL),
s AS (SELECT k, id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 20),
u AS (SELECT k, id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.k, a.id AS a, b.id AS b FROM u a JOIN u b ON a.k = b.k AND a.x = b.x AND a.id < b.id GROUP BY a.k, a.id, b.id, a.n, b.n HAVING count(*) >= 0.55 * (a.n + b.n - count(*)) - 1e-9),
e AS (SELECT k, a, b FROM p UNION ALL SELECT k, b, a FROM p),
reach AS (SELECT k, a AS v, a AS r FROM e UNION SELECT e.k, e.b, reach.r FROM reach JOIN e ON e.k = reach.k AND e.a = reach.v),
g AS (SELECT k, v, min(r) AS group_id FROM reach GROUP BY k, v)
"""


@query("p1_found", _P1 + "SELECT x.k AS record_kind, x.v AS left_id, y.v AS right_id FROM g x JOIN g y ON x.k = y.k AND x.group_id = y.group_id AND x.v < y.v")
def p1_found(spark, d):
    from casebolt.llm import neardup

    return neardup.found(table(spark, d, "documents"), table(spark, d, "mail_messages"))


@query("p1_membership", _P1 + "SELECT g.k AS record_kind, g.v AS record_id, g.group_id, count(*) AS links FROM g JOIN e ON e.k = g.k AND e.a = g.v GROUP BY ALL")
def p1_membership(spark, d):
    from casebolt.llm import neardup

    return neardup.membership(table(spark, d, "documents"), table(spark, d, "mail_messages"))


@query("p3_found")
def p3_found(spark, d):
    from casebolt.llm import names

    return names.found(table(spark, d, "entity_identifiers"))


@query("p3_entities")
def p3_entities(spark, d):
    from casebolt.llm import names

    return names.entities(table(spark, d, "entity_identifiers"))


@query("p6_found")
def p6_found(spark, d):
    from casebolt.llm import authored

    return authored.found(table(spark, d, "mail_messages"))


@query("p6_authored")
def p6_authored(spark, d):
    from casebolt.llm import authored

    return authored.authored(table(spark, d, "mail_messages")).withColumn("removed", F.array_join("removed", ","))


@query("p10_found")
def p10_found(spark, d):
    from casebolt.llm import truncation

    return truncation.found(table(spark, d, "documents"))


@query("p10_rates")
def p10_rates(spark, d):
    from casebolt.llm import truncation

    return truncation.rates(table(spark, d, "documents"))
