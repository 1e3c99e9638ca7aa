"""Physical copies and the documents they make: preferred copies, merged values, conflicts, exact duplicates, rescans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Priorities of source kinds and text states, the better first.
SOURCE_KINDS = ["production", "pst", "mbox", "slack", "filesystem"]
TEXT_STATES = ["ok", "partial", "empty", "failed"]


def rank_of(c: str, order: list[str]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c)), F.lit(0)), F.lit(len(order) + 1))


def filled(*cols: str) -> Column:
    """How many of the columns hold something that is not blank."""
    return reduce(lambda a, b: a + b, [F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0) for c in cols])


def preference(fields: list[str]) -> list[Column]:
    """Seven keys: active, source kind, text state, more fields, has a preview, ingested first (unknown last), id."""
    return [
        F.when(F.col("lifecycle_status") == "active", 0).otherwise(1), rank_of("source_kind", SOURCE_KINDS), rank_of("text_status", TEXT_STATES), -filled(*fields),
        F.when(F.col("has_preview"), 0).otherwise(1), F.col("ingested_at").asc_nulls_last(), F.col("id"),
    ]


def preferred(occ: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """The preferred copy of each document (planned with a group limit: each task keeps one row a key before the shuffle)."""
    return occ.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*preference(fields)))).where("_r = 1").drop("_r")


def canonical(occ: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """One document of all its copies: for each field the preferred copy's value, else the earliest other that is not blank;
    earliest creation, latest modification, best text state, the first non-blank control number, custodians in preferred order."""
    r = occ.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*preference(fields))))
    first = F.col("_r") == 1
    at = F.struct((~first).alias("a"), F.col("ingested_at").isNull().alias("b"), "ingested_at", "id")
    value = lambda f: F.min_by(f, F.when(F.trim(F.col(f).cast("string")) != "", at)).alias(f)
    people = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.trim("custodian") != "", F.struct("_r", F.trim("custodian").alias("c"))))), lambda x: x["c"]))
    return r.groupBy(key).agg(
        *[value(f) for f in fields], F.min("date_created").alias("date_created"), F.max("date_modified").alias("date_modified"),
        F.min_by("text_status", rank_of("text_status", TEXT_STATES)).alias("text_status"), people.alias("custodians"), F.count("*").alias("copies"),
        F.when(F.count_if(F.col("lifecycle_status") == "active") > 0, "active").otherwise("derelict").alias("canonical_status"),
    )


def keep_locked(fresh: DataFrame, stored: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """Documents rebuilt from their copies with the stored values of the fields that a user locked (stored: key, fields, locked array of field
    names); a locked null stays null. Documents not stored yet have no locks."""
    old = stored.select(key, F.col("locked").alias("_locked"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = fresh.join(old, key, "left")
    held = lambda f: F.coalesce(F.array_contains("_locked", f), F.lit(False))
    return j.withColumns({f: F.when(held(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop("_locked", *[f"_{f}" for f in fields])


def conflicts(occ: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """(key, field_name, value, occurrence_id): where active copies hold different non-blank values, each value once with its last copy."""
    live = occ.where("lifecycle_status = 'active'")
    long = live.select(key, "id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])).alias("x")).select(key, "id", "x.*").where("value <> ''")
    values = long.groupBy(key, "field_name", "value").agg(F.max("id").alias("occurrence_id"))
    return values.withColumn("n", F.count("*").over(W.partitionBy(key, "field_name"))).where("n > 1").drop("n")


def exact_duplicates(docs: DataFrame, hash_col: str, ident: str = "id") -> DataFrame:
    """(hash, survivor, copies) of contents held more than once; the least id survives. A null hash is no duplicate."""
    return docs.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(ident).alias("survivor"), F.count("*").alias("copies")).where("copies > 1")


def backfill_keys(docs: DataFrame, keys: DataFrame, basis: str = "file_hash") -> DataFrame:
    """Keys to add for documents that have a hash and no key of the basis: the largest id of each hash."""
    have = keys.where(F.col("basis") == basis).select(F.lower(F.trim("key_value")).alias("key_value"))
    new = docs.where("file_hash is not null").groupBy(F.lower("file_hash").alias("key_value")).agg(F.max("id").alias("document_id"))
    return new.join(have, "key_value", "left_anti").select(F.lit(basis).alias("basis"), "key_value", "document_id")


def compatible(a: str, b: str) -> Column:
    """Kinds agree if they are equal or one is unknown."""
    known = lambda c: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit("unknown"))
    return (known(a) == known(b)) | (known(a) == "unknown") | (known(b) == "unknown")


def rescan(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """State of every path after a scan: unchanged (same size and hash), changed, new, missing, renamed (the content of a missing
    path under a new one; each missing path serves once)."""
    j = stored.select("path", "hash", "size").withColumn("s", F.lit(1)).join(scanned.select("path", F.col("hash").alias("new_hash"), F.col("size").alias("new_size")).withColumn("n", F.lit(1)), "path", "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("s").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("new_hash")) & F.col("size").eqNullSafe(F.col("new_size")), "unchanged").otherwise("changed")
    st = j.select("path", F.coalesce("new_hash", "hash").alias("hash"), state.alias("state"))
    number = lambda s: st.where(F.col("state") == s).where("hash is not null").withColumn("k", F.row_number().over(W.partitionBy("hash").orderBy("path")))
    moved = number("new").alias("a").join(number("missing").alias("b"), ["hash", "k"]).select(F.col("a.path").alias("path"), F.col("b.path").alias("from_path"))
    gone = moved.select(F.col("from_path").alias("path")).withColumn("g", F.lit(True))
    out = st.join(moved, "path", "left").join(gone, "path", "left").where("g is null")
    return out.select("path", F.when(F.col("from_path").isNotNull(), "renamed").otherwise(F.col("state")).alias("state"), "from_path")


def match_by_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id -> new_id of attachments of one parent: by name and hash, then by hash; every row serves once, in id order."""
    def pass_(o, n, keys):
        w = W.partitionBy(*keys).orderBy("id")
        a = o.withColumn("k", F.row_number().over(w)).select(*keys, "k", F.col("id").alias("old_id"))
        b = n.withColumn("k", F.row_number().over(w)).select(*keys, "k", F.col("id").alias("new_id"))
        return a.join(b, [*keys, "k"]).select("old_id", "new_id")

    first = pass_(old.where("hash is not null and name is not null"), new.where("hash is not null and name is not null"), ["parent_id", "name", "hash"])
    left_old = old.where("hash is not null").join(first.select(F.col("old_id").alias("id")), "id", "left_anti")
    left_new = new.where("hash is not null").join(first.select(F.col("new_id").alias("id")), "id", "left_anti")
    return first.unionByName(pass_(left_old, left_new, ["parent_id", "hash"]))


def latest(df: DataFrame, key: list[str], ident: str = "id") -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(ident)))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` where a key is in both; a repeated key of ``new`` keeps its last row by all columns."""
    cols = old.columns
    n = new.select(*cols).withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in cols if c not in key] or [F.lit(1)]))).where("_r = 1").drop("_r")
    return n.unionByName(old.join(n.select(*key), key, "left_anti"))


def longest_prefix(paths: DataFrame, locators: DataFrame) -> DataFrame:
    """path -> the longest locator that is it or one of its folders. Folders are exploded, so the join is on equality."""
    p = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("locator"))
    return p.join(locators.select("locator"), "locator").groupBy("path").agg(F.max_by("locator", F.length("locator")).alias("locator"))


def gap_fill(own: DataFrame, side: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Blank fields of the own rows filled from the first non-blank value among the side rows of the key, by their order column."""
    value = lambda f: F.min_by(F.trim(f), F.when(F.trim(f) != "", F.col("side_order"))).alias("s_" + f)
    s = side.where(F.col(key).isNotNull()).groupBy(key).agg(*[value(f) for f in fields])
    j = own.join(s, key, "left")
    return j.withColumns({f: F.coalesce(F.when(F.trim(f) != "", F.col(f)), F.col("s_" + f)) for f in fields}).drop(*["s_" + f for f in fields])


def narrow(items: DataFrame, candidates: DataFrame, levels: list[list[str]]) -> DataFrame:
    """item -> candidate by the first level of keys that leaves exactly one; each level looks at the candidates of all its keys."""
    chosen, rest = None, items
    for k, keys in enumerate(levels):
        full = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in keys])
        j = rest.where(full).join(candidates.where(full).select(*keys, F.col("candidate_id")), keys).groupBy("item_id").agg(F.count("*").alias("n"), F.min("candidate_id").alias("candidate_id")).where("n = 1")
        got = j.select("item_id", "candidate_id", F.lit(k + 1).alias("level"))
        chosen = got if chosen is None else chosen.unionByName(got)
        rest = rest.join(got.select("item_id"), "item_id", "left_anti")
    return chosen
