"""Bringing stored documents and their copies in line: duplicates merged with a log of conflicts, copies that changed, messages no longer
there, datasets renamed and deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(docs: DataFrame, groups: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents with canonical_status and merged_into, conflict log) of candidate groups (group_id, document_id, status).

    Only groups with status ready are merged. The survivor of a group is its document with the most filled fields, then the least id; the
    others are merged into it. The log has a row (group_id, document_id, field_name, kept, other) for every filled value that differs from
    the survivor's own. A document in several groups goes to the one with the least id."""
    filled = sum((F.when(F.trim(F.col(f).cast("string")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    mine = groups.where("status = 'ready'").groupBy("document_id").agg(F.min("group_id").alias("group_id")).withColumnRenamed("document_id", "id")
    m = docs.join(mine, "id").withColumn("_filled", filled)
    best = m.groupBy("group_id").agg(F.min(F.struct((-F.col("_filled")).alias("f"), F.col("id"))).alias("x"), F.count("*").alias("n")).where("n > 1").select("group_id", F.col("x.id").alias("survivor"))
    to = m.join(best, "group_id").where("id <> survivor").select("id", F.col("survivor").alias("merged_into"))
    merged = docs.join(to, "id", "left").withColumn("canonical_status", F.when(F.col("merged_into").isNotNull(), "merged").otherwise("active"))
    long = lambda df, v: df.select("group_id", F.col("id").alias("document_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias(v)) for f in fields])).alias("x")).select("group_id", "document_id", "x.*")
    kept = long(m.join(best, "group_id").where("id = survivor"), "kept").drop("document_id")
    other = long(m.join(best, "group_id").where("id <> survivor"), "other").where("trim(other) <> ''")
    return merged, other.join(kept, ["group_id", "field_name"]).where("not (other <=> kept)").select("group_id", "document_id", "field_name", "kept", "other")


def retire_unseen(copies: DataFrame, source: str, scan_started_at) -> DataFrame:
    """Copies of a container after a scan: those of its messages that the scan did not see, and their children, are deleted."""
    stale = F.col("last_seen_at").isNull() | (F.col("last_seen_at") != scan_started_at)
    roots = copies.where((F.col("source") == source) & F.col("parent_id").isNull() & (F.col("lifecycle_status") != "deleted") & stale).select(F.col("id").alias("root"), F.lit(True).alias("gone"))
    j = copies.withColumn("root", F.coalesce("parent_id", "id")).join(roots, "root", "left")
    return j.withColumn("lifecycle_status", F.when(F.col("gone"), "deleted").otherwise(F.col("lifecycle_status"))).drop("root", "gone")


def supersede(copies: DataFrame, scanned: DataFrame) -> DataFrame:
    """Active copies (id, document_id, path, file_hash) against a scan (path, file_hash): (id, document_id, path, action). A changed copy of a
    document with several active copies is superseded and its path becomes a new document; a changed only copy is updated; others are kept."""
    n = copies.groupBy("document_id").agg(F.count("*").alias("_copies"))
    s = scanned.select("path", F.col("file_hash").alias("_now"), F.lit(True).alias("_seen"))
    changed = F.col("_seen") & ~F.col("file_hash").eqNullSafe(F.col("_now"))
    action = F.when(F.col("_seen").isNull(), "unseen").when(~changed, "kept").when(F.col("_copies") > 1, "superseded").otherwise("updated")
    return copies.join(n, "document_id").join(s, "path", "left").select("id", "document_id", "path", action.alias("action"))


def mark_missing(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents by path after a scan: a root that is not there is missing, and so are its children; one that is there again is active."""
    there = seen.select("rel_path").distinct().withColumn("_here", F.lit(True))
    roots = docs.where("parent_id is null and lifecycle_status <> 'deleted'").join(there, "rel_path", "left").select(F.col("id").alias("_root"), F.when(F.col("_here"), "active").otherwise("missing").alias("_state"))
    j = docs.withColumn("_root", F.coalesce("parent_id", "id")).join(roots, "_root", "left")
    return j.withColumn("lifecycle_status", F.when(F.col("lifecycle_status") == "deleted", "deleted").otherwise(F.coalesce("_state", "lifecycle_status"))).drop("_root", "_state")


def rename_dataset(datasets: DataFrame, dataset_id: int, name: str) -> DataFrame:
    """Datasets with one renamed; a blank name, or one that another has (without case), is refused."""
    clean = " ".join(name.split())
    if not clean or not datasets.where((F.lower("name") == clean.lower()) & (F.col("dataset_id") != dataset_id)).isEmpty():
        raise ValueError(f"no name, or one in use: {name!r}")
    return datasets.withColumn("name", F.when(F.col("dataset_id") == dataset_id, clean).otherwise(F.col("name")))


def delete_dataset(datasets: DataFrame, membership: DataFrame, dataset_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(datasets, memberships, orphans): without the dataset; orphans are the documents that were in no other."""
    left = membership.where(F.col("dataset_id") != dataset_id)
    gone = membership.where(F.col("dataset_id") == dataset_id).select("document_id").distinct()
    return datasets.where(F.col("dataset_id") != dataset_id), left, gone.join(left, "document_id", "left_anti")
