"""Families, productions and control numbers: parents and attachments, Bates spans, page images, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebolt.common import Scratch
from casebolt.functions import bates

# Fixed value: pattern of a control number with batch, family and attachment.
CONTROL = r"^DOC(\d+)\.(\d+)(?:\.(\d+))?$"


def control_number(batch, family, attachment=None) -> Column:
    c = F.concat(F.lit("DOC"), F.lpad(batch.cast("string"), 3, "0"), F.lit("."), F.lpad(family.cast("string"), 8, "0"))
    return c if attachment is None else F.concat(c, F.when(attachment.isNotNull(), F.concat(F.lit("."), F.lpad(attachment.cast("string"), 3, "0"))).otherwise(""))


def control_parts(c) -> list[Column]:
    part = lambda i: F.regexp_extract(c, CONTROL, i).try_cast("long")
    return [part(1).alias("batch_no"), part(2).alias("family_no"), part(3).alias("attachment_no")]


def is_attachment(parent: str = "parent_id", kind: str = "child_kind") -> Column:
    """A child of kind attachment; a child without a kind is one, a reply thread is not."""
    return F.col(parent).isNotNull() & (F.coalesce(kind, F.lit("attachment")) == "attachment")


def has_attachments(docs: DataFrame) -> DataFrame:
    """Documents with at least one attachment that is not deleted."""
    children = docs.where(is_attachment() & (F.coalesce("lifecycle_status", F.lit("active")) != "deleted")).select(F.col("parent_id").alias("id"))
    return docs.join(children, "id", "left_semi")


def expand_family(seeds: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, ordinal, seed_ids): for each seed, in order, its root and the root's children by id; each document once, at its first place."""
    root = F.coalesce("parent_id", "id")
    s = seeds.join(docs.select("id", root.alias("root")), "id").select("ordinal", F.col("id").alias("seed_id"), "root")
    members = docs.select(root.alias("root"), "id", F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("child"))
    j = s.join(members, "root").groupBy("id", "child").agg(F.min("ordinal").alias("first"), F.sort_array(F.collect_set("seed_id")).alias("seed_ids"))
    # dense places without one ordered partition for all: places are (first, child, id); row numbers are given on request
    return j.select("id", "first", "child", "seed_ids")


def numbered(df: DataFrame, *keys) -> DataFrame:
    """Adds ordinal from 1 in the order of the keys, by a range partitioning and partition offsets, so no task sees all rows. The numbered
    ranges are written once: their sizes and their rows are the same ones."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), *keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    ranged = Scratch(spark, "numbered").put(ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*keys))))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
    return ranged.join(sizes.select("_p", "_before"), "_p").withColumn("ordinal", F.coalesce("_before", F.lit(0)) + F.col("_r")).drop("_p", "_r", "_before")


#: Levels of spans whose numbers are wider than 64 bits begin here.
WIDE = 100


def points_in_spans(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(point, span) of points(point, series, n) inside spans(span, series, lo, hi), without comparing all of a series.

    A span of length l lies in one or two buckets of size 2^k >= l, k its level; a point looks into its bucket of every level that
    occurs (at most 190, collected). Numbers beyond 18 digits have levels of their own, with buckets of exact decimals by their hash."""
    s = spans.where("lo <= hi").withColumns({"_lo": F.col("lo").try_cast("long"), "_hi": F.col("hi").try_cast("long")})
    # one level more where a double cannot hold the length exactly
    level = F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int")
    wide = WIDE + F.least(level + 1, F.lit(126))
    s = s.withColumn("level", F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull() & (level < 50), level).otherwise(wide))
    at = lambda n: F.expr(f"cast(floor({n} / power(2, level)) as bigint)")
    power = F.element_at(F.array(*[F.lit(str(2**k)).cast("decimal(38,0)") for k in range(127)]), F.greatest(F.col("level") - WIDE, F.lit(0)) + 1)
    at_wide = lambda n: F.xxhash64((F.col(n) - F.col(n) % power).cast("decimal(38,0)"))
    both = F.when(F.col("level") < WIDE, F.array(at("_lo"), at("_hi"))).otherwise(F.array(at_wide("lo"), at_wide("hi")))
    s = s.withColumn("bucket", F.explode(F.array_distinct(both)))
    levels = sorted(r["level"] for r in s.select("level").distinct().collect())
    if not levels:
        return s.select(F.lit(None).cast("long").alias("point"), "span").limit(0)
    p = points.withColumn("_n", F.col("n").try_cast("long")).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    p = p.withColumn("bucket", F.when(F.col("level") < WIDE, at("_n")).otherwise(at_wide("n")))
    return p.join(s.select("series", "level", "bucket", "span", "lo", "hi"), ["series", "level", "bucket"]).where("n between lo and hi").select("point", "span").distinct()


def link_production_families(rows: DataFrame) -> DataFrame:
    """child -> parent by Bates spans: a document that meets another's attachment span, the first parent in the text order of
    (begin_bates, control_number, id), never itself. Two spans meet where one holds the other's beginning."""
    p = rows.where("begin_attachment is not null").select(
        F.col("id").alias("parent"), F.col("begin_bates").alias("p_begin"), F.col("control_number").alias("p_control"), bates.series("begin_attachment").alias("series"),
        bates.series(F.coalesce("end_attachment", "begin_attachment")).alias("s2"), bates.number("begin_attachment").alias("lo"), bates.number(F.coalesce("end_attachment", "begin_attachment")).alias("hi"),
    ).where("series = s2")
    c = rows.select(F.col("id").alias("child"), bates.series("begin_bates").alias("series"), bates.number("begin_bates").alias("b"), bates.number(F.coalesce("end_bates", "begin_bates")).alias("e"))
    a = points_in_spans(c.select(F.col("child").alias("point"), "series", F.col("b").alias("n")), p.select(F.col("parent").alias("span"), "series", "lo", "hi")).select(F.col("point").alias("child"), F.col("span").alias("parent"))
    b = points_in_spans(p.select(F.col("parent").alias("point"), "series", F.col("lo").alias("n")), c.where("e > b").select(F.col("child").alias("span"), "series", F.col("b").alias("lo"), F.col("e").alias("hi"))).select(F.col("span").alias("child"), F.col("point").alias("parent"))
    j = a.unionByName(b).where("child <> parent").join(p.select("parent", "p_begin", "p_control"), "parent")
    return j.groupBy("child").agg(F.min(F.struct("p_begin", "p_control", "parent")).alias("m")).select("child", F.col("m.parent").alias("parent"))


def link_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page_count, pages): page images whose number lies in the document's span, in order."""
    d = docs.select(F.col("id").alias("span"), bates.series("begin_bates").alias("series"), bates.number("begin_bates").alias("lo"), bates.number(F.coalesce("end_bates", "begin_bates")).alias("hi"))
    g = pages.select(F.struct("image_path", bates.number("page_bates").alias("n")).alias("point"), bates.series("page_bates").alias("series"), bates.number("page_bates").alias("n"))
    j = points_in_spans(g, d)
    return j.groupBy(F.col("span").alias("id")).agg(F.count("*").alias("page_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point.n", "point.image_path"))), lambda x: x["image_path"]), ",").alias("pages"))


def next_attachment_numbers(docs: DataFrame) -> DataFrame:
    """Numbers for attachments without one: after the largest used in the family, in id order; numbers are never reused."""
    a = docs.where(is_attachment()).select("id", "parent_id", F.regexp_extract("control_number", CONTROL, 3).try_cast("int").alias("no"))
    used = a.groupBy("parent_id").agg(F.max("no").alias("used"))
    new = a.where("no is null").join(used, "parent_id")
    return new.select("id", "parent_id", (F.coalesce("used", F.lit(0)) + F.row_number().over(W.partitionBy("parent_id").orderBy("id"))).alias("attachment_no"))
