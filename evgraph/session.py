"""The session's settings."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``partitions`` for small local runs only."""
    b = SparkSession.builder.appName("evgraph").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def _folder(spark) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="evgraph-"))


def cut(df):
    """``df`` computed, its lineage cut, in the folder of spark.checkpoint.dir (a temporary one only where unset)."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df):
    """:func:`cut` as Parquet in the same folder, which is smaller, and which :func:`drop` can delete before the session ends."""
    spark = df.sparkSession
    _folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def drop(*dfs) -> None:
    """Deletes what :func:`stored` has written of ``dfs``, and lets Spark clear shuffles that nothing refers to any more."""
    for df in dfs:
        if path := getattr(df, "_stored", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    if dfs:
        gc.collect()
        dfs[0].sparkSession.sparkContext._jvm.System.gc()
