"""Neighbourhoods within budgets: pages of ranked nodes and edges, and packs around anchors."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators import analytics, ranking, traverse
from evgraph.session import cut


def page(nodes: DataFrame, edges: DataFrame, budget: int, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """(phase, position, cost, used): what of the ranked ``nodes`` and ``edges`` (position from 1, cost of 1 or more) a page
    within ``budget`` takes, beginning behind the positions ``after``.

    Nodes are taken in order until one does not fit; then edges, as far as what is left goes. The first row of a page is
    taken whatever it costs. As rows cost 1 at least, ``budget`` + 1 of each are all that is looked at.
    """
    most = max(1, budget) + 1
    w = Window.orderBy("position")  # over at most ``most`` rows

    def candidates(rows: DataFrame, phase: str, skip: int) -> DataFrame:
        some = rows.where(F.col("position") > skip).orderBy("position").limit(most)
        return some.select(F.lit(phase).alias("phase"), "position", F.col("cost").cast("long").alias("cost")).withColumn("run", F.sum("cost").over(w)).withColumn("nth", F.row_number().over(w))

    n = candidates(nodes, "node", after[0])
    n = n.where((F.col("run") <= budget) | (F.col("nth") == 1))
    spent = n.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("spent"))
    e = candidates(edges, "edge", after[1]).crossJoin(F.broadcast(spent))  # with one row
    e = e.where((F.col("run") + F.col("spent") <= budget) | ((F.col("nth") == 1) & (F.col("spent") == 0)))
    return n.select("phase", "position", "cost", F.col("run").alias("used")).unionByName(e.select("phase", "position", "cost", (F.col("run") + F.col("spent")).alias("used")))


def cursor(taken: DataFrame, after: tuple[int, int], nodes: int, edges: int) -> tuple[int, int] | None:
    """Where the next page begins; None where all ``nodes`` and ``edges`` have been given."""
    last = {r.phase: r.last for r in taken.groupBy("phase").agg(F.max("position").alias("last")).collect()}
    at = (last.get("node", after[0]), last.get("edge", after[1]))
    return at if at[0] < nodes or at[1] < edges else None


class Pack(NamedTuple):
    """What a neighbourhood holds: neurons (id, score, depth, used), synapses (the edges between them), omissions
    (reason, n)."""

    neurons: DataFrame
    synapses: DataFrame
    omissions: DataFrame


def pack(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, budget: int, hops: int = 2, radius: int | None = None) -> Pack:
    """The best of what lies around ``anchors`` (id), ranked by personalised PageRank of the local subgraph only.

    nodes: (id, cost); edges: (source, target, kind, ...). The subgraph is what ``radius`` hops reach (``hops`` + 1 unless
    given). Anchors are always in; of the others those within ``hops`` are taken in order of score while they fit what is
    left of the budget, and passed over where they don't. Omitted: by budget, by hops, and edges without a target.
    """
    local = cut(traverse.local_hops(anchors, edges, hops + 1 if radius is None else radius).join(nodes, "id"))
    inside = lambda end: local.select(F.col("id").alias(end))
    within = edges.join(inside("source"), "source", "left_semi").join(inside("target"), "target", "left_semi").select(*edges.columns)
    return _packed(local, within, anchors, edges.where("target is null").select(F.lit("unresolved").alias("reason")), budget, hops)


def typed_pack(nodes: DataFrame, relations: list[traverse.Relation], anchors: list[str], budget: int, hops: int = 2, radius: int | None = None) -> Pack:
    """:func:`pack` over relations; ``anchors`` are ids. Synapses are (source, target, kind)."""
    spark = nodes.sparkSession
    local = cut(traverse.typed_local_hops(spark, anchors, relations, hops + 1 if radius is None else radius).join(nodes, "id"))
    loose = [r.rows.where(F.col(r.target_key).isNull()).select(F.lit("unresolved").alias("reason")) for r in relations]
    named = spark.createDataFrame([(x,) for x in anchors], "id string")
    return _packed(local, traverse.typed_inside(local, relations), named, reduce(DataFrame.unionByName, loose), budget, hops)


def _packed(local: DataFrame, within: DataFrame, anchors: DataFrame, loose: DataFrame, budget: int, hops: int) -> Pack:
    """The pack of ``local`` (id, depth, cost), the edges ``within`` it and the omissions (reason) of edges without a target."""
    within = cut(within)
    named = anchors.select("id").distinct().withColumn("anchor", F.lit(True))
    every = local.join(named, "id", "left").select(F.lit("").alias("grp"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    score = analytics.page_rank(within.select(F.lit("").alias("grp"), "source", "target", F.lit(False).alias("anchor")).unionByName(every))
    rows = cut(local.join(score.select("id", F.round("score", 9).alias("score")), "id").join(named, "id", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False))))
    spent = rows.where("anchor").agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    rest = rows.where(~F.col("anchor") & (F.col("depth") <= hops)).withColumn("grp", F.lit("")).withColumn("neg", -F.col("score"))
    told = cut(ranking.budget_skip(rest, "id", "cost", ["neg", "id"], int(budget - spent), ["grp"]).select("id", "taken"))
    neurons = cut(rows.where("anchor").select("id", "score", "depth", "cost").unionByName(rows.join(told.where("taken").select("id"), "id", "left_semi").select("id", "score", "depth", "cost")))
    kept = lambda end: neurons.select(F.col("id").alias(end))
    synapses = within.join(kept("source"), "source", "left_semi").join(kept("target"), "target", "left_semi").select(*within.columns)
    left = told.where("not taken").select(F.lit("budget").alias("reason")).unionByName(rows.where(~F.col("anchor") & (F.col("depth") > hops)).select(F.lit("hops").alias("reason")))
    left = left.unionByName(loose)
    return Pack(neurons, synapses, left.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
