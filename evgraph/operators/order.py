"""Positions in an order, numbered from sorted ranges and not by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.session import cut


def positions(rows: DataFrame, order: list[str | Column], name: str = "position", first: int = 1) -> DataFrame:
    """``rows`` with their place in ``order``, from ``first`` on; rows that are equal in it are numbered in any order.

    The ranged rows are computed once, with the number of their range, and their lineage cut: ranges come from a sample, so
    two computations need not cut them alike. One row for each range is all that is gathered.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut(rows.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*cols)))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place") + F.lit(first - 1))
    return out.select(*rows.columns, name)
