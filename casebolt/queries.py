"""Registry of the core queries: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebolt.common import table
from casebolt.operators import instants, packed

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@query("p5_found")
def p5_found(spark, d):
    return packed.found(table(spark, d, "gmail_metadata"))


@query("p5_dialects")
def p5_dialects(spark, d):
    got = packed.split_packed(table(spark, d, "gmail_metadata").select("meta_id", "labels", "cc", "bcc"), "meta_id", {"labels": "labels", "cc": "addresses", "bcc": "addresses"})
    return got.groupBy("field_name", "dialect").agg(F.countDistinct("meta_id").alias("n_rows"), F.count("*").alias("n_values"))


# p7_found in SQL: one named pattern a notation; groups y m d h i s f (fraction) p (am, pm) z (zone), for a and b see _P7_ORDER
_P7_TIME = r"(?P<h>\d{1,2}):(?P<i>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_P7_ZONE = r"\s*(?P<z>Z|z|[A-Za-z]{2,5}|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_P7_HALF = r"(?:\s*(?P<p>[AaPp])\.?[Mm]\.?)?(?:\s*(?P<z>Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
_P7_FORMS = {
    "iso": rf"^(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})[T ]\s*{_P7_TIME}{_P7_ZONE}(?:\s*\[[^\]]*\]|\s*\([^)]*\))?$",
    "basic": rf"^(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[T ]?(?P<h>\d{{2}})(?P<i>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?{_P7_ZONE}$",
    "pdf": r"^D:(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<h>\d{2})(?P<i>\d{2})(?P<s>\d{2})?(?P<z>(?:Z|[+-]\d{2})?'?(?:\d{2})?)'?$",
    "dotted": rf"^(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}|\d{{2}}),?\s+{_P7_TIME}{_P7_ZONE}$",
    "slash": rf"^(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}),?\s+{_P7_TIME}{_P7_HALF}$",
    "mail": rf"^(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})[ -](?P<m>[A-Za-z]{{3,9}})[ -](?P<y>\d{{4}}|\d{{2}}),?\s+{_P7_TIME}{_P7_ZONE}(?:\s*\([^)]*\))?$",
    "long": rf"^(?:[A-Za-z]{{3,9}},\s+)?(?P<m>[A-Za-z]{{3,9}})\.? (?P<d>\d{{1,2}}),? (?P<y>\d{{4}}),?(?: at)?\s+(?P<h>\d{{1,2}}):(?P<i>\d{{2}})(?::(?P<s>\d{{2}}))?{_P7_HALF}$",
}


_P7_ROWS = """r AS (SELECT 'gmail_metadata' AS table_name, meta_id AS record_id, account, 'datesent' AS field_name, datesent AS raw FROM gmail_metadata
UNION ALL SELECT 'gmail_metadata', meta_id, account, 'datereceived', datereceived FROM gmail_metadata UNION ALL SELECT 'mail_messages', mail_id, account, 'date_created', date_created FROM mail_messages),
q AS (SELECT r.*, home_zone, coalesce(lower(day_order) = 'mdy', false) AS mdy FROM r LEFT JOIN account_zones USING (account))"""
_DATE_ROWS = "q AS (SELECT meta_id AS record_id, datesent AS raw, 'UTC' AS home_zone, true AS mdy FROM gmail_metadata)"


def _p7_sql(rows: str) -> str:
    """Common tables up to u: the rows of q with t (trimmed), local, off and utc."""
    group = lambda k, g: f"regexp_extract(t, '{_P7_FORMS[k].replace(chr(39), chr(39) * 2)}', [{', '.join(repr(x) for x in re.findall(r'[?]P<(.)>', _P7_FORMS[k]))}]).{g}" if f"?P<{g}>" in _P7_FORMS[k] else "''"
    first = lambda g: "CASE k " + " ".join(f"WHEN '{k}' THEN {group(k, g)}" for k in _P7_FORMS) + " END"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(t, '{f.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, f in _P7_FORMS.items()) + " END"
    known = " ".join(f"WHEN '{z}' THEN {m}" for z, m in instants.ABBREVIATIONS.items())
    months = ", ".join(f"'{m}'" for m in instants.MONTHS)
    return rf"""
WITH {rows},
t AS (SELECT *, regexp_replace(raw, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') AS t FROM q WHERE raw IS NOT NULL),
k AS (SELECT *, {kind} AS k FROM t),
g AS (SELECT *, {', '.join(f'{first(x)} AS g{x}' for x in 'ymdabhisfpz')} FROM k),
n AS (SELECT *, CASE WHEN k = 'slash' THEN CASE WHEN mdy THEN ga ELSE gb END WHEN regexp_matches(gm, '^[A-Za-z]') THEN list_position([{months}], lower(gm[1:3]))::VARCHAR ELSE gm END AS mo, CASE WHEN k = 'slash' THEN CASE WHEN mdy THEN gb ELSE ga END ELSE gd END AS da,
  CASE WHEN length(gy) = 2 THEN CASE WHEN gy::INTEGER < 70 THEN 2000 ELSE 1900 END + gy::INTEGER ELSE TRY_CAST(gy AS INTEGER) END AS ye,
  CASE WHEN gp = '' THEN TRY_CAST(gh AS INTEGER) WHEN gh::INTEGER BETWEEN 1 AND 12 THEN gh::INTEGER % 12 + CASE WHEN lower(gp) = 'p' THEN 12 ELSE 0 END END AS ho, upper(regexp_replace(gz, '''', '', 'g')) AS z FROM g),
o AS (SELECT *, CASE WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::INTEGER * 60 + coalesce(TRY_CAST(right(regexp_replace(z[4:], ':', ''), 2) AS INTEGER), 0)) ELSE CASE z {known} END END AS off,
  CASE WHEN regexp_matches(t, '^(\d{{10}}|\d{{13}}|\d{{16}})$') THEN make_timestamp((t || repeat('0', 16 - length(t)))::BIGINT)
  ELSE TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d.', ye, TRY_CAST(mo AS INTEGER), TRY_CAST(da AS INTEGER), ho, TRY_CAST(gi AS INTEGER), CASE WHEN gs = '' THEN 0 ELSE TRY_CAST(gs AS INTEGER) END) || rpad(gf[1:6], 6, '0') AS TIMESTAMP) END AS local FROM n),
u AS (SELECT *, CASE WHEN k IS NULL THEN local WHEN off IS NOT NULL THEN local - to_minutes(off) WHEN z = '' AND home_zone IS NOT NULL THEN
  timezone('UTC', CASE WHEN timezone(home_zone, timezone(home_zone, local) - INTERVAL 1 HOUR) = local THEN timezone(home_zone, local) - INTERVAL 1 HOUR ELSE timezone(home_zone, local) END) END AS utc FROM o)"""


@query("p7_found", _p7_sql(_P7_ROWS) + " SELECT table_name, record_id, field_name, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc_text FROM u WHERE utc IS NOT NULL")
def p7_found(spark, d):
    return instants.found(table(spark, d, "gmail_metadata"), table(spark, d, "mail_messages"), table(spark, d, "account_zones"))


@query("dates_normalised", _p7_sql(_DATE_ROWS) + " SELECT record_id, coalesce(strftime(utc, '%Y-%m-%dT%H:%M:%SZ'), CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') AND TRY_CAST(t AS DATE) IS NOT NULL THEN t || 'T00:00:00Z' END, nullif(t, '')) AS date FROM u")
def dates_normalised(spark, d):
    g = table(spark, d, "gmail_metadata").where("datesent is not null").select(F.col("meta_id").alias("record_id"), "datesent")
    return instants.normal_dates(g, "datesent", "date").select("record_id", "date")


@query("p7_normalised")
def p7_normalised(spark, d):
    return instants.normalise_instants(table(spark, d, "gmail_metadata"), table(spark, d, "mail_messages"), table(spark, d, "account_zones"))


@query("p7_zone_estimates")
def p7_zone_estimates(spark, d):
    zones = table(spark, d, "account_zones").where("account is not null")
    got = instants.zone_estimates(table(spark, d, "gmail_metadata"), table(spark, d, "mail_messages"), zones)
    return got.join(zones.select("account", "home_zone"), "account")


def _add_core() -> None:
    from casebolt import queries_core, queries_records, queries_upkeep  # noqa: F401  (the others add to the first's registry)

    Q.update(queries_core.Q)


_add_core()
