"""Datasets, visibility, aggregation, paging: operators over documents and their dataset memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Pages and aggregates.
PAGE, PAGE_MOST, ROWS, ROWS_MOST = 10, 100, 20, 200
BUCKETS = ("year", "quarter", "month", "week")


def visible(docs: DataFrame, membership: DataFrame) -> DataFrame:
    """Documents that are neither missing nor deleted and belong to at least one dataset."""
    live = docs if "lifecycle_status" not in docs.columns else docs.where("coalesce(lifecycle_status, 'active') not in ('missing', 'deleted')")
    return live.join(membership.select(F.col("document_id").alias("id")), "id", "left_semi")


def in_datasets(docs: DataFrame, membership: DataFrame, names: list[str]) -> DataFrame:
    return docs.join(membership.where(F.col("dataset_name").isin(*names)).select(F.col("document_id").alias("id")), "id", "left_semi")


def order(keys: list[tuple[str, str]], tie: str = "id") -> list[Column]:
    """Sort columns of (field, asc|desc) pairs, nulls last, ties by id."""
    return [F.col(k).desc_nulls_last() if d == "desc" else F.col(k).asc_nulls_last() for k, d in keys] + [F.col(tie).asc()]


def blank_last(date: str, tie: str = "id") -> list[Column]:
    """Null or blank dates after all others."""
    c = F.col(date)
    return [F.when(c.isNull() | (F.trim(c.cast("string")) == ""), 1).otherwise(0), c, F.col(tie)]


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = PAGE) -> DataFrame:
    """One page, from 1; a page beyond the end is empty. First pages plan as TakeOrderedAndProject."""
    size = max(1, min(size, PAGE_MOST))
    got = df.orderBy(*keys)
    return got.limit(size) if number <= 1 else got.offset((number - 1) * size).limit(size)


def title(c: str = "title") -> Column:
    """Title, else subject, else file name; blanks count as missing."""
    full = lambda x: F.when(F.trim(F.col(x)) != "", F.col(x))
    return F.coalesce(full("title"), full("subject"), full("file_name"))


def bucket(date, size: str) -> Column:
    """Calendar bucket of a date: 2024, 2024-Q1, 2024-03, 2024-W09 (ISO week)."""
    d = F.col(date) if isinstance(date, str) else date
    if size == "year":
        return F.date_format(d, "yyyy")
    if size == "quarter":
        return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d))
    if size == "month":
        return F.date_format(d, "yyyy-MM")
    if size == "week":
        # the ISO year is the year of the week's Thursday
        thursday = F.date_add(F.date_trunc("week", d).cast("date"), 3)
        return F.concat(F.year(thursday), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    raise ValueError(size)


METRICS = {"count": lambda f: F.count("*"), "sum": F.sum, "distinct": F.countDistinct, "min": F.min, "max": F.max}


def aggregate(df: DataFrame, by: list[tuple[str, Column]], metric: str = "count", field: str | None = None, limit: int | None = None, name: str = "value") -> DataFrame:
    """Groups and a metric, the largest first (ties by group); a null group stays a group. ``limit`` is the report's length."""
    out = df.groupBy(*[c.alias(n) for n, c in by]).agg(METRICS[metric](field).alias(name))
    return out if limit is None else out.orderBy(F.desc(name), *[F.col(n).asc_nulls_last() for n, _ in by]).limit(min(limit, ROWS_MOST))


def dataset_summary(docs: DataFrame, membership: DataFrame) -> DataFrame:
    """Per dataset: documents, their size (negative sizes count nothing), content types with counts, custodians, first and last date."""
    m = membership.select("dataset_name", F.col("document_id").alias("id")).distinct().join(docs, "id")
    g = m.groupBy("dataset_name").agg(
        F.count("*").alias("documents"), F.sum(F.when(F.col("file_size") >= 0, F.col("file_size")).otherwise(0)).alias("total_size"),
        F.array_join(F.sort_array(F.collect_set("custodian")), ", ").alias("custodians"),
        F.min(F.coalesce("date_created", "date_modified")).alias("first_date"), F.max(F.coalesce("date_modified", "date_created")).alias("last_date"),
    )
    kinds = m.groupBy("dataset_name", "content_type").agg(F.count("*").alias("n")).groupBy("dataset_name").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "content_type"))).alias("k"))
    text = F.array_join(F.transform("k", lambda x: F.concat(F.coalesce(x["content_type"], F.lit("(none)")), F.lit(": "), -x["neg"])), ", ")
    if "source" in membership.columns:  # how each document came into the dataset: by hand, or from a source; by both counts for both
        how = membership.select("dataset_name", "document_id", F.when(F.col("source") == "manual", "manual").otherwise("source").alias("how")).distinct().join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        g = g.join(how.groupBy("dataset_name").agg(F.count_if(F.col("how") == "manual").alias("manual_documents"), F.count_if(F.col("how") == "source").alias("source_documents")), "dataset_name")
    return g.join(kinds.select("dataset_name", text.alias("content_types")), "dataset_name")


def inventory(docs: DataFrame) -> DataFrame:
    """Counts of parents, missing parents, attachments and all documents that are not deleted."""
    live, child = F.col("lifecycle_status") != "deleted", F.col("parent_id").isNotNull()
    attached = child & (F.coalesce("child_kind", F.lit("attachment")) == "attachment")
    return docs.agg(
        F.count_if(live & ~child).alias("parents"), F.count_if((F.col("lifecycle_status") == "missing") & ~child).alias("missing_parents"),
        F.count_if(live & attached).alias("attachments"), F.count_if(live).alias("documents"),
    )


def membership_cache(membership: DataFrame) -> DataFrame:
    """The dataset of a document that is in exactly one, else null."""
    return membership.groupBy("document_id").agg(F.when(F.countDistinct("dataset_name") == 1, F.min("dataset_name")).alias("dataset_name"))


def add_members(membership: DataFrame, docs: DataFrame, dataset: str, ids: DataFrame) -> DataFrame:
    """What adding does to each id: added, already, unknown."""
    known = docs.select("id").withColumn("k", F.lit(True))
    there = membership.where(F.col("dataset_name") == dataset).select(F.col("document_id").alias("id")).distinct().withColumn("m", F.lit(True))
    j = ids.select("id").distinct().join(known, "id", "left").join(there, "id", "left")
    return j.select("id", F.when(F.col("k").isNull(), "unknown").when(F.col("m"), "already").otherwise("added").alias("result"))


def remove_members(membership: DataFrame, dataset: str, ids: DataFrame) -> DataFrame:
    """What removing does to each id: removed, orphaned (removed from its last dataset), absent."""
    per = membership.select("document_id", "dataset_name").distinct().groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("dataset_name") == dataset).alias("here"))
    j = ids.select("id").distinct().join(per, "id", "left")
    return j.select("id", F.when(F.coalesce("here", F.lit(False)), F.when(F.col("n") == 1, "orphaned").otherwise("removed")).otherwise("absent").alias("result"))


def merge_identities(datasets: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets of one normalised name become the one with the least id; memberships move and repeat once."""
    key = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    to = datasets.withColumn("to_id", F.min("dataset_id").over(W.partitionBy(key)))
    kept = to.where("dataset_id = to_id").drop("to_id")
    moved = membership.join(to.select("dataset_id", "to_id"), "dataset_id").select(F.col("to_id").alias("dataset_id"), "document_id").distinct()
    return kept, moved


def suffix_collisions(names: DataFrame, name: str = "name", ident: str = "id") -> DataFrame:
    """Names made unique: the first keeps its name, further ones get _2, _3 … ; numbers whose names are taken are skipped."""
    key = F.lower(F.trim(name))
    n = names.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(ident)))
    taken = names.select(key.alias("taken")).distinct()
    # a group of m repeats needs at most m + (taken names of its form) numbers
    want = n.where("k > 1").select(ident, name, "k", key.alias("base"))
    forms = taken.select(F.regexp_extract("taken", r"^(.*)_(\d+)$", 1).alias("base"), F.regexp_extract("taken", r"^(.*)_(\d+)$", 2).try_cast("int").alias("no")).where("base <> '' and no >= 2")
    used = forms.groupBy("base").agg(F.sort_array(F.collect_set("no")).alias("used"))
    j = want.join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(2), F.col("k") + F.size("used") + 1), lambda x: ~F.array_contains(F.col("used"), x))
    renamed = j.select(ident, F.concat(F.trim(name), F.lit("_"), F.element_at(free, F.col("k") - 1)).alias("unique_name"))
    return n.where("k = 1").select(ident, F.trim(name).alias("unique_name")).unionByName(renamed)
