"""Session, table and intermediate-storage helpers shared by all operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "casebolt", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for: UTC, AQE with skew handling, Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. Where the session names none, a session on one machine
    (tests) gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="casebolt-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Written tables of one run in the shared folder. They cut lineage and survive the loss of executors.

    ``put`` writes a DataFrame and returns it as read back; ``drop`` deletes a table no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/casebolt-{label}-{uuid.uuid4().hex[:12]}"
        self._n, self._paths = 0, {}

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(schema).parquet(path)
        self._paths[id(back)] = path
        back._casebolt_path = path
        return back

    @staticmethod
    def there(df: DataFrame) -> bool:
        """Whether a written table is still in its folder."""
        sc = df.sparkSession.sparkContext
        hp = sc._jvm.org.apache.hadoop.fs.Path(df._casebolt_path)
        return hp.getFileSystem(sc._jsc.hadoopConfiguration()).exists(hp)

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            p = getattr(df, "_casebolt_path", None)
            if p:
                hp = jvm.org.apache.hadoop.fs.Path(p)
                hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now; they would stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def total_cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def norm_text_key(c):
    """Key texts compare without case and outer white space; blank becomes null."""
    t = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(t != "", t)
