"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evgraph.plans import context, docs, evidence, extraction, graph, journal, retrieval

MODULES = (graph, retrieval, docs, journal, extraction, context, evidence)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.QUERIES["impact"][0](spark, sf_dir)
