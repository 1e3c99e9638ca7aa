"""Jobs and what they leave: versions and runs, the reasons of a selection, text revisions and their activation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebolt.functions import text
from casebolt.plans.scope import Scope

REVISIONS = "revision_id long, document_id long, revision_kind string, parent_revision_id long, content_hash string, char_count long, token_estimate long, text string"


def identifier(name: str, prefix: str = "job") -> str:
    """A usable name of a job, output or run."""
    s = re.sub(r"[^A-Za-z0-9_]+", "_", name.strip()).strip("_").lower()
    if not s:
        raise ValueError(f"nothing left of the name {name!r}")
    return f"{prefix}_{s}" if s[0].isdigit() else s


def next_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New versions (job_id, ident) numbered after the greatest one of their job, in the order of ident; a job without any begins at 1."""
    most = versions.groupBy("job_id").agg(F.max("version").alias("_most"))
    k = F.row_number().over(W.partitionBy("job_id").orderBy("ident"))
    return new.join(most, "job_id", "left").withColumn("version", (F.coalesce("_most", F.lit(0)) + k).cast("int")).drop("_most")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The version of each job that runs: the greatest number, then the greatest id."""
    return versions.groupBy("job_id").agg(F.max(F.struct("version", "job_version_id")).alias("x")).select("job_id", "x.job_version_id", "x.version")


def reasons(scope: Scope) -> list[dict]:
    """Why documents are in a selection: one entry for each slot of the scope that is set, in the order keyword, Bates, filter, datasets, run."""
    s = lambda x: " ".join((x or "").split())
    out = []
    if s(scope.keyword):
        out.append({"type": "keyword", "query": s(scope.keyword)})
    if scope.bates and all(map(s, scope.bates)):
        out.append({"type": "bates", "begin": s(scope.bates[0]), "end": s(scope.bates[1])})
    if s(scope.filter):
        out.append({"type": "filter", "expression": s(scope.filter)})
    if scope.datasets:
        out.append({"type": "dataset", "dataset_names": list(scope.datasets)})
    if scope.from_run is not None:
        out.append({"type": "from_run", "run_id": scope.from_run})
    return out


def with_reasons(selection: DataFrame, scope: Scope) -> DataFrame:
    """The selection with its reasons as an array of (type, detail)."""
    parts = [F.struct(F.lit(r["type"]).alias("type"), F.lit("; ".join(", ".join(v) if isinstance(v, list) else str(v) for k, v in r.items() if k != "type")).alias("detail")) for r in reasons(scope)]
    return selection.withColumn("reasons", F.array(*parts) if parts else F.array().cast("array<struct<type:string,detail:string>>"))


def add_revisions(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store of text revisions with new ones (document_id, revision_kind, parent_revision_id, text): a text that its document has under the
    same kind and parent adds none. Ids go on after the greatest one."""
    n = new.select("document_id", "revision_kind", "parent_revision_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.coalesce("text", F.lit("")).alias("text"))
    n = n.groupBy("document_id", "revision_kind", "parent_revision_id", "content_hash").agg(F.first("text").alias("text"))
    a, b = n.alias("a"), store.select("document_id", "revision_kind", "parent_revision_id", "content_hash").distinct().alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("document_id", "revision_kind", "parent_revision_id", "content_hash")]
    fresh = a.join(b, same, "left_anti")
    from casebolt.operators.families import numbered

    top = store.agg(F.coalesce(F.max("revision_id"), F.lit(0))).first()[0]  # one number
    fresh = numbered(fresh, F.col("document_id"), F.col("revision_kind"), F.col("content_hash")).withColumn("revision_id", F.col("ordinal") + F.lit(top))
    tokens = F.when(F.trim("text") != "", text.token_estimate(F.col("text"))).otherwise(0)
    fresh = fresh.select("revision_id", "document_id", "revision_kind", "parent_revision_id", "content_hash", F.length("text").cast("long").alias("char_count"), tokens.cast("long").alias("token_estimate"), "text")
    return store.unionByName(fresh)


def activate(docs: DataFrame, revisions: DataFrame, wanted: DataFrame, policy: str = "manual") -> tuple[DataFrame, DataFrame]:
    """(documents with their active revision, chunks to replace). ``wanted`` is (document_id, revision_id, activated_at, by_job); a request of a job
    counts under the policy always only. The last request of a document wins; a revision of another document is refused. Chunks are
    those of the documents whose revision changed, made anew from its text."""
    asked = wanted.where(~F.col("by_job")) if policy != "always" else wanted
    strangers = asked.join(revisions.select("revision_id", F.col("document_id").alias("_owner")), "revision_id", "left").where("_owner is null or _owner <> document_id")
    if not strangers.isEmpty():
        raise ValueError("a revision of another document")
    last = asked.groupBy("document_id").agg(F.max_by("revision_id", F.struct("activated_at", "revision_id")).alias("_to")).withColumnRenamed("document_id", "id")
    out = docs.join(last, "id", "left").withColumn("changed", F.coalesce(~F.col("active_revision_id").eqNullSafe(F.col("_to")) & F.col("_to").isNotNull(), F.lit(False)))
    out = out.withColumn("active_revision_id", F.coalesce("_to", "active_revision_id")).drop("_to")
    again = out.where("changed").select("id", F.col("active_revision_id").alias("revision_id")).join(revisions.select("revision_id", "text"), "revision_id")
    return out, text.chunks(again.select("id", "text"))
