"""Results out: CSV, a zip of selected files, manifests of previews."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, fields: list[str], one_file: bool = False) -> None:
    """Selected fields as CSV with a header, in parallel files; one file only where the user asks for it."""
    out = df.select(*fields)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_step(df: DataFrame, path: str, key: str, size: int) -> dict:
    """The next ``size`` rows of an export of documents, entities or conversations in the order of ``key``, written to path/step=N. The
    greatest key of the steps there is the cursor, so an export that was broken off goes on where it stopped; a step is there as a whole or
    not at all. Returns the state, the cursor and the rows of this step; completed once a step finds no more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    steps = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [s for s in steps if s.startswith("step=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{s}/_SUCCESS"))]
    cursor = spark.read.parquet(*[f"{path}/{s}" for s in done]).agg(F.max(key)).first()[0] if done else None
    left = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    part = left.orderBy(key).limit(size)
    target = f"{path}/step={len(done)}"
    part.write.mode("overwrite").parquet(target)
    r = spark.read.schema(df.schema).parquet(target).agg(F.count("*").alias("n"), F.max(key).alias("at")).first()
    return {"state": "running" if r["n"] == size else "completed", "cursor": cursor if r["at"] is None else r["at"], "rows": r["n"]}


def export_table(df: DataFrame, path: str, key: str, size: int = 1_000_000) -> dict:
    """All steps of an export, from where an earlier call stopped."""
    state = export_step(df, path, key, size)
    while state["state"] == "running":
        state = export_step(df, path, key, size)
    return state


def export_archive(manifest: DataFrame, path: str) -> int:
    """A zip of the selected documents' source files, below their control numbers; rows are streamed to the driver one by one."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in manifest.select("control_number", "path").orderBy("control_number").toLocalIterator():
            z.write(r["path"], f"{r['control_number']}/{r['path'].rsplit('/', 1)[-1]}")
            n += 1
    return n


def preview_units(docs: DataFrame) -> DataFrame:
    """(conversation_id, unit, first_id, documents): mail is shown by its whole chain; documents of a chat on consecutive days are
    one unit (gaps and islands)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conversation_id").orderBy("date_created", "id")
    gap = F.when((F.col("content_type") == "Chat") & (F.datediff("date_created", F.lag("date_created").over(w)) > 1), 1).otherwise(0)
    j = docs.where("conversation_id is not null").withColumn("g", gap).withColumn("unit", F.sum("g").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return j.groupBy("conversation_id", "unit").agg(F.min("id").alias("first_id"), F.count("*").alias("documents"))
