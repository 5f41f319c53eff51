"""Generations: immutable folders of Parquet tables, and one pointer to the current one.

A generation is written whole before a manifest names it; readers take the highest manifest, and see all of its tables
or none. Files go through Spark and Hadoop's file system, so a store may lie anywhere that Spark can write.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators.order import positions

SCHEMA_VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def generation_id(tables: dict[str, DataFrame]) -> str:
    """A digest of the tables' contents, whatever their order: counts and sums of row hashes of each."""
    parts = {}
    for name in sorted(tables):
        df = tables[name]
        cols = [F.to_json(F.struct(c)) for c in sorted(df.columns)]
        h = F.xxhash64(*cols).cast("decimal(38,0)")
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(*cols)).alias("x")).first()
        parts[name] = [row.n, str(row.s), row.x]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def publish(root: str, number: int, tables: dict[str, DataFrame], parent: str | None = None, versions: dict[str, str] | None = None) -> dict:
    """Writes generation ``number``: its tables, then the manifest that makes it count. Written again, it is the same.
    ``versions``: of the extractors that made it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/gen={number:010d}/{name}")
    back = {name: spark.read.parquet(f"{root}/gen={number:010d}/{name}") for name in tables}
    manifest = {"number": number, "id": generation_id(back), "parent": parent, "schema_version": SCHEMA_VERSION, "versions": versions, "counts": {n: df.count() for n, df in back.items()}}
    fs, tmp, jvm = _fs(spark, f"{root}/manifests/.{number:010d}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{number:010d}.json")
    fs.delete(final, False)
    fs.rename(tmp, final)
    return manifest


def manifest(spark: SparkSession, root: str, below: int | None = None) -> dict | None:
    """The newest generation's manifest; no table is read."""
    fs, folder, jvm = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    names = [n for n in names if below is None or int(n[:-5]) < below]
    if not names:
        return None
    raw = spark.read.text(f"{root}/manifests/{names[-1]}", wholetext=True).first()[0]
    return json.loads(raw)


def current(spark: SparkSession, root: str, name: str, below: int | None = None) -> DataFrame | None:
    """A table of the current generation; None where there is none."""
    found = manifest(spark, root, below)
    return spark.read.parquet(f"{root}/gen={found['number']:010d}/{name}") if found else None


def dense_ordinals(nodes: DataFrame, provider_rank: DataFrame) -> DataFrame:
    """nodes with rank and ordinal 0, 1, ...: by provider rank, path, id. Nodes of a provider without a rank are left out.
    Ranks (provider, rank) are a handful; numbers come from sorted ranges, not from one task."""
    return positions(nodes.join(provider_rank, "provider"), ["rank", "path", "id"], "ordinal", 0)


def federate(parts: dict[str, DataFrame]) -> DataFrame:
    """The repositories' slices together, each of one generation: a slice of several is refused."""
    out = None
    for repo, df in parts.items():
        if df.agg(F.count_distinct("generation_id")).first()[0] > 1:
            raise ValueError(f"{repo}: several generations")
        one = df.withColumn("repo", F.lit(repo))
        out = one if out is None else out.unionByName(one)
    return out
