"""Keeping a collection current: memberships of children, retired and unchanged records, deletions, repairs, enrichment by links,
pages of families and chunks, run items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def refresh_membership(docs: DataFrame, source_membership: DataFrame) -> DataFrame:
    """(document_id, dataset_name): roots by their own sources, children by their root's."""
    root = docs.select("id", F.coalesce("parent_id", "id").alias("root"))
    return root.join(source_membership.select(F.col("document_id").alias("root"), "dataset_name"), "root").select(F.col("id").alias("document_id"), "dataset_name").distinct()


def content_hash(*parts) -> Column:
    """Digest of a message's parts in a fixed order, nulls apart from empty texts, lists in their own order."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("+"), F.col(p).cast("string")), F.lit("-")) for p in parts]), 256)


def attachment_manifests(attachments: DataFrame) -> DataFrame:
    """(message_id, manifest) of attachments (message_id, name, size, file_hash): one text a message, its attachments in the order of hash, name
    and size, so that their order in the mail says nothing. It is a part of the message's content hash."""
    a = F.struct(F.coalesce("file_hash", F.lit("-")).alias("h"), F.coalesce("name", F.lit("-")).alias("n"), F.coalesce("size", F.lit(-1)).cast("long").alias("s"))
    line = F.transform(F.sort_array(F.collect_list(a)), lambda x: F.concat_ws("|", x["h"], x["n"], x["s"].cast("string")))
    return attachments.groupBy("message_id").agg(F.array_join(line, "\n").alias("manifest"))


def load_state(stored: DataFrame, loaded: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """State of each record against a new load file: unchanged (all fields equal, nulls too), changed, new, retired."""
    a = stored.select(key, F.struct(*fields).alias("old"), F.lit(True).alias("s"))
    b = loaded.select(key, F.struct(*fields).alias("now"), F.lit(True).alias("n"))
    st = F.when(F.col("n").isNull(), "retired").when(F.col("s").isNull(), "new").when(F.col("old").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, st.alias("state"))


def delete(docs: DataFrame, selection: DataFrame) -> DataFrame:
    """Documents with the selected ones, and their children, marked deleted."""
    hit = selection.select(F.col("id").alias("root")).distinct().withColumn("hit", F.lit(True))
    j = docs.withColumn("root", F.coalesce("parent_id", "id"))
    own = selection.select("id").distinct().withColumn("own", F.lit(True))
    j = j.join(hit, "root", "left").join(own, "id", "left")
    return j.withColumn("lifecycle_status", F.when(F.coalesce("hit", "own").isNotNull(), "deleted").otherwise(F.col("lifecycle_status"))).drop("root", "hit", "own")


def repair_needed(containers: DataFrame, items: DataFrame, required: DataFrame) -> DataFrame:
    """Containers to read again although unchanged: some item of theirs lacks what is required (threading, a text revision)."""
    lacking = items.join(required.select("item_id"), "item_id", "left_anti").select("container").distinct()
    return containers.join(lacking, "container", "left_semi")


def enrich(left: DataFrame, links: DataFrame, right: DataFrame) -> DataFrame:
    """(id, titles): distinct titles of everything linked, in order; links is (id, ref), right (ref, title)."""
    j = links.select("id", "ref").distinct().join(right.select("ref", "title").where("title is not null").distinct(), "ref")
    t = j.groupBy("id").agg(F.concat_ws("; ", F.sort_array(F.collect_set("title"))).alias("titles"))
    return left.select("id").join(t, "id", "left")


def family_rows(page: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a page with their attachments below them: id, ordinal, depth, parent_id."""
    p = page.select("id", "ordinal")
    kids = docs.where("parent_id is not null and coalesce(child_kind, 'attachment') = 'attachment'").select(F.col("id").alias("child"), F.col("parent_id").alias("id"))
    below = kids.join(p, "id").select(F.col("child").alias("id"), "ordinal", F.lit(1).alias("depth"), F.col("id").alias("parent_id"))
    return p.select("id", "ordinal", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_id")).unionByName(below)


def chunk_page(chunks: DataFrame, document_id: int, number: int = 1, size: int = 50) -> DataFrame:
    """One page of a document's chunks in order (the listing's page size, at most 200)."""
    size = max(1, min(size, 200))
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index").offset((max(1, number) - 1) * size).limit(size)


def page_items(snapshot: DataFrame, pages: DataFrame) -> DataFrame:
    """Run items: one for each page of a snapshot's documents, one for a document without pages."""
    j = snapshot.select("id", "ordinal").join(pages.select("id", "page_count"), "id", "left")
    n = F.greatest(F.coalesce("page_count", F.lit(0)), F.lit(1))
    return j.select("id", "ordinal", F.explode(F.sequence(F.lit(1), n)).alias("page"))


def attempts(log: DataFrame) -> DataFrame:
    """Attempts of each item numbered from 1 in time order."""
    return log.withColumn("attempt", F.row_number().over(W.partitionBy("item_id").orderBy("at", "id")))


def best_record(records: DataFrame, key: str, preference: list[Column]) -> DataFrame:
    """The record of each key that is first in a multi-part preference."""
    return records.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*preference))).where("_r = 1").drop("_r")
