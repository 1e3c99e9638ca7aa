"""Incremental ingest: a landing folder as a stream, each micro-batch merged like a batch rescan.

``availableNow`` works off what is there and ends; the checkpoint holds what was read, so a file is merged once. Late or repeated
rows of one key are settled by the merge: the last version of a key wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebolt.operators.occurrences import upsert


#: Batches that are kept beside the base before all are merged into a new one.
MOST_BATCHES = 16


def merge_landing(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str, key: list[str]) -> None:
    """Merges the JSON files of a folder into a table. A micro-batch writes its own rows only (table/v=N, with their key as _key); every
    MOST_BATCHES of them are merged into a base (table/base=N), after which they and the old base are removed. ``current`` reads the base
    and the batches after it."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = upsert(batch.limit(0), batch, key).withColumn("_key", F.struct(*key))
        rows.write.mode("overwrite").parquet(f"{table}/v={number}")
        base, batches = _parts(spark, table)
        if len(batches) > MOST_BATCHES:
            _merged(spark, table, base, batches).write.mode("overwrite").parquet(f"{table}/base={batches[-1]}")
            for name in [f"v={n}" for n in batches] + ([] if base is None else [f"base={base}"]):
                _fs(spark, table)[1].delete(_fs(spark, f"{table}/{name}")[0], True)

    q = spark.readStream.schema(schema).json(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, table: str) -> tuple[int | None, list[int]]:
    """The newest base and the batches after it, of those written completely."""
    p, fs = _fs(spark, table)
    if not fs.exists(p):
        return None, []
    done = [s.getPath().getName().split("=") for s in fs.listStatus(p) if fs.exists(_fs(spark, f"{table}/{s.getPath().getName()}/_SUCCESS")[0])]
    base = max((int(x[1]) for x in done if x[0] == "base"), default=None)
    return base, sorted(int(x[1]) for x in done if x[0] == "v" and (base is None or int(x[1]) > base))


def _merged(spark: SparkSession, table: str, base: int | None, batches: list[int]) -> DataFrame:
    read = lambda name, n: spark.read.parquet(f"{table}/{name}={n}").withColumn("_v", F.lit(n))
    every = ([] if base is None else [read("base", base)]) + [read("v", n) for n in batches]
    rows = every[0]
    for x in every[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    kept = [c for c in rows.columns if c not in ("_key", "_v")]
    return rows.groupBy("_key").agg(F.max_by(F.struct(*kept), "_v").alias("x")).select("x.*", "_key")


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of each key; a table without any batch is not there."""
    base, batches = _parts(spark, table)
    if base is None and not batches:
        raise FileNotFoundError(table)
    return _merged(spark, table, base, batches).drop("_key")


def activity(events: DataFrame, bucket: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and calendar bucket, as a stream with a watermark or as a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", bucket).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket_start"), "event_type", "n", "total")
