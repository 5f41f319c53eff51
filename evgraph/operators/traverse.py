"""Traversals of the graph: closures, neighbours, paths, dependents and flows.

Edges have (source, target, kind, ...); a null target is kept as evidence but never followed. Small depths are one plan
of joins, whose frontiers adaptive execution broadcasts when they are small; deeper closures cut the lineage each hop.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators.order import positions
from evgraph.session import cut

UNROLLED = 3


def arcs(edges: DataFrame, direction: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(at, to): what one hop from ``at`` reaches."""
    e = edges.where(F.col("target").isNotNull())
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    out = e.select(F.col("source").alias("at"), F.col("target").alias("to"))
    back = e.select(F.col("target").alias("at"), F.col("source").alias("to"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def closure(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, depth): everything within ``depth`` hops of ``seeds`` (id), with the least number of hops.

    No seeds: no rows. Cycles and parallel edges count once.
    """
    step = arcs(edges, direction, kinds)
    front = seeds.select("id").distinct()
    if depth <= UNROLLED:
        seen = front.withColumn("depth", F.lit(0))
        for d in range(1, depth + 1):
            front = step.join(front, step["at"] == front["id"]).select(F.col("to").alias("id")).distinct()
            seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
        return seen.groupBy("id").agg(F.min("depth").alias("depth"))
    step = cut(step.distinct())
    seen = cut(front.withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        new = step.join(front.select(F.col("id").alias("at")), "at").select(F.col("to").alias("id")).distinct()
        front = cut(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


class Relation(NamedTuple):
    """Edges of one kind between nodes of two kinds, as a table with a column of keys at either end. A node's id is its
    kind, a colon and its key. Rows may repeat; null keys are no edges."""

    source: str
    target: str
    kind: str
    rows: DataFrame
    source_key: str
    target_key: str


def typed_closure(spark: SparkSession, seeds: Iterable[str], relations: list[Relation], depth: int, direction: str = "out", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, depth): :func:`closure` over relations: a frontier for each kind of node, so a hop reads only the tables that
    leave a kind on the frontier, two columns of them, and the first hop filters them where they are scanned.

    ``seeds`` are ids. No seeds, or ids of kinds that no relation has: themselves. Keys are whole numbers.
    """
    given: dict[str, list[int]] = {}
    for x in dict.fromkeys(seeds):
        given.setdefault(x.partition(":")[0], []).append(int(x.partition(":")[2]))
    if not given:
        return spark.createDataFrame([], "id string, depth int")
    arms = [(r.source, r.source_key, r.target, r.target_key, r.rows) for r in relations if (not kinds or r.kind in kinds) and direction != "in"]
    arms += [(r.target, r.target_key, r.source, r.source_key, r.rows) for r in relations if (not kinds or r.kind in kinds) and direction != "out"]
    front = {k: spark.createDataFrame([(x,) for x in keys], "key long") for k, keys in given.items()}
    seen: dict[str, DataFrame] = {k: df.withColumn("depth", F.lit(0)) for k, df in front.items()}
    for d in range(1, depth + 1):
        come: dict[str, list[DataFrame]] = {}
        for a, at, b, to, rows in arms:
            if a in front:
                rows = rows.where(F.col(to).isNotNull()).select(F.col(at).cast("long").alias("at"), F.col(to).cast("long").alias("key")) if d > 1 else rows.where(F.col(at).isin(given[a]) & F.col(to).isNotNull()).select(F.col(to).cast("long").alias("key"))
                come.setdefault(b, []).append(rows if d == 1 else rows.join(front[a].withColumnRenamed("key", "at"), "at", "left_semi").select("key"))
        new = {}
        for k, parts in come.items():
            rows = reduce(DataFrame.unionByName, parts).distinct()
            rows = rows.join(seen[k].select("key"), "key", "left_anti") if k in seen else rows
            new[k] = cut(rows) if d < depth and depth > UNROLLED else rows
        for k, rows in new.items():
            rows = rows.withColumn("depth", F.lit(d))
            seen[k] = seen[k].unionByName(rows) if k in seen else rows
        front = new
        if not front or (d < depth and depth > UNROLLED and all(x.isEmpty() for x in front.values())):
            break
    return reduce(DataFrame.unionByName, (df.select(F.concat(F.lit(f"{k}:"), F.col("key").cast("string")).alias("id"), "depth") for k, df in seen.items()))


def typed_layers(relations: list[Relation]) -> DataFrame | None:
    """(id, layer): :func:`analytics.layers` over relations: the longest path from a node that nothing enters. None where kinds
    refer to each other in a circle, as only then nodes can.

    Kinds are taken from the first to the last of their order, so a relation is read once: a node's layer is one more than the
    greatest of the nodes that refer to it. Rows of a kind that nothing enters are all of layer 0 and need no join. Nothing is
    written on the way.
    """
    into: dict[str, list[Relation]] = {}
    for r in relations:
        into.setdefault(r.target, []).append(r)
        into.setdefault(r.source, [])
    order: list[str] = []
    while len(order) < len(into):
        free = [k for k, rs in into.items() if k not in order and all(r.source in order for r in rs)]
        if not free:
            return None
        order += free
    layer: dict[str, DataFrame] = {}
    for kind in order:
        come = []
        for r in into[kind]:
            rows = r.rows.select(F.col(r.source_key).cast("long").alias("at"), F.col(r.target_key).cast("long").alias("key")).where("key is not null")
            if into[r.source]:
                known = layer[r.source].select(F.col("key").alias("at"), F.col("layer").alias("before"))
                come.append(rows.join(known, "at", "left").select("key", F.coalesce(F.col("before") + 1, F.lit(0)).alias("layer")))
            else:
                come.append(rows.select("key", F.when(F.col("at").isNotNull(), 1).otherwise(0).alias("layer")))
        for r in relations:
            if r.source == kind:
                own = r.rows.where(F.col(r.target_key).isNotNull() & F.col(r.source_key).isNotNull())
                come.append(own.select(F.col(r.source_key).cast("long").alias("key"), F.lit(0).alias("layer")))
        layer[kind] = reduce(DataFrame.unionByName, come).groupBy("key").agg(F.max("layer").alias("layer"))
    return reduce(DataFrame.unionByName, (df.select(F.concat(F.lit(f"{k}:"), F.col("key").cast("string")).alias("id"), "layer") for k, df in layer.items()))


def typed_shortest_path(spark: SparkSession, start: str, goal: str, relations: list[Relation], depth: int = 5) -> DataFrame:
    """(step, id): :func:`shortest_path` over relations. Each level is written once, with whether it holds the goal."""
    kind, _, key = start.partition(":")
    front = {kind: spark.createDataFrame([(int(key), [start])], "key long, path array<string>")}
    seen, found = {kind: front[kind].select("key")}, [front[kind]] if start == goal else []
    to_kind, _, to_key = goal.partition(":")
    for d in range(1, depth + 1):
        if found:
            break
        come: dict[str, list[DataFrame]] = {}
        for r in relations:
            if r.source in front:
                rows = r.rows.where(F.col(r.source_key) == int(key)) if d == 1 else r.rows
                rows = rows.where(F.col(r.target_key).isNotNull()).select(F.col(r.source_key).cast("long").alias("at"), F.col(r.target_key).cast("long").alias("key")).distinct()
                rows = rows.join(front[r.source].withColumnRenamed("key", "at"), "at")
                come.setdefault(r.target, []).append(rows.select("key", F.concat("path", F.array(F.concat(F.lit(f"{r.target}:"), F.col("key").cast("string")))).alias("path")))
        front = {}
        for k, parts in come.items():
            rows = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.min("path").alias("path"))
            front[k] = cut(rows.join(seen[k], "key", "left_anti") if k in seen else rows)
            seen[k] = seen[k].unionByName(front[k].select("key")) if k in seen else front[k].select("key")
        if not front:
            break
        if to_kind in front and not (hit := front[to_kind].where(F.col("key") == int(to_key))).isEmpty():
            found = [hit]
    if not found:
        return spark.createDataFrame([], "step int, id string")
    return found[0].select(F.posexplode("path").alias("step", "id"))


def neighbor_edges(reached: DataFrame, edges: DataFrame, mode: str = "induced", depth: int | None = None) -> DataFrame:
    """The edges of a neighbourhood.

    induced: both ends reached, or the source reached and no target. incident: an end among those expanded, which are
    the reached nodes nearer than ``depth``.
    """
    ids = reached.select(F.col("id"))
    if mode == "induced":
        inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        return inside.where("target is null").unionByName(inside.where("target is not null").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*inside.columns))
    inner = reached.where(F.col("depth") < depth).select("id")
    out = edges.join(inner.withColumnRenamed("id", "source"), "source", "left_semi")
    rest = edges.join(inner.withColumnRenamed("id", "source"), "source", "left_anti").join(inner.withColumnRenamed("id", "target"), "target", "left_semi")
    return out.select(*edges.columns).unionByName(rest.select(*edges.columns))


def blast_radius(changed: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """Everything that depends on ``changed``, upstream, of any kind."""
    return closure(changed, edges, depth, "in")


def impact(target: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """The same without the target itself."""
    return closure(target, edges, depth, "in").where("depth > 0")


def shortest_path(start: str, goal: str, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(step, id) of a shortest path along edges; of several the least by node names, compared from the start.

    Paths grow level by level and only the least path to each node goes on, so a level holds a node once. No path: no
    rows.
    """
    spark = edges.sparkSession
    step = arcs(edges, "out").distinct()
    paths = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    found = paths.where(F.col("id") == goal)
    seen = paths.select("id")
    for _ in range(depth):
        nxt = step.join(paths.withColumnRenamed("id", "at"), "at").select(F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        paths = cut(nxt.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        found = found.unionByName(paths.where(F.col("id") == goal))
        if not paths.where(F.col("id") == goal).isEmpty() or paths.isEmpty():
            break
        seen = seen.unionByName(paths.select("id"))
    best = found.orderBy(F.size("path"), "path").limit(1)
    return best.select(F.posexplode("path").alias("step", "id"))


def dependents(changed: DataFrame, depends: DataFrame, hops: int = 2, limit: int = 500) -> DataFrame:
    """(id, depth, kept): dependents within ``hops``, nearest and least first; ``kept`` while within ``limit``."""
    reach = closure(changed, depends, hops, "in").where("depth > 0")
    return positions(reach, ["depth", "id"]).withColumn("kept", F.col("position") <= limit).drop("position")


def flows(entries: DataFrame, edges: DataFrame, longest: int = 13, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(entry, terminal, length, path): all simple paths from ``entries`` to nodes that no edge leaves."""
    step = arcs(edges, "out", kinds).distinct()
    inner = step.select(F.col("at").alias("id")).distinct()
    paths = entries.select(F.col("id").alias("entry"), F.col("id"), F.array("id").alias("path"))
    done = None
    for _ in range(longest - 1):
        ends = paths.join(inner, "id", "left_anti")
        done = ends if done is None else done.unionByName(ends)
        paths = cut(step.join(paths.withColumnRenamed("id", "at"), "at").where(~F.array_contains("path", F.col("to"))).select("entry", F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path")))
        if paths.isEmpty():
            break
    else:
        done = done.unionByName(paths.join(inner, "id", "left_anti"))
    return done.select("entry", F.col("id").alias("terminal"), F.size("path").alias("length"), F.array_join("path", ">").alias("path"))


#: Kinds that a local subgraph follows forward only (fixed values); all others go both ways.
FORWARD = ("IMPORTS", "CALLS", "TESTS", "CONFIGURES")


def local_hops(anchors: DataFrame, edges: DataFrame, radius: int = 3) -> DataFrame:
    """(id, depth) of the local subgraph around ``anchors``."""
    e = edges.where("target is not null")
    two_way = e.where(~F.col("kind").isin(*FORWARD)).select(F.col("target").alias("source"), F.col("source").alias("target"), "kind")
    return closure(anchors, e.select("source", "target", "kind").unionByName(two_way), radius, "out")


def typed_local_hops(spark: SparkSession, anchors: Iterable[str], relations: list[Relation], radius: int = 3) -> DataFrame:
    """:func:`local_hops` over relations; ``anchors`` are ids."""
    back = [Relation(r.target, r.source, r.kind, r.rows, r.target_key, r.source_key) for r in relations if r.kind not in FORWARD]
    return typed_closure(spark, anchors, [*relations, *back], radius, "out")


def typed_inside(reached: DataFrame, relations: list[Relation]) -> DataFrame:
    """(source, target, kind): the edges of ``relations`` with both ends among ``reached`` (id)."""
    def inside(kind: str, name: str) -> DataFrame:
        return reached.where(F.startswith("id", F.lit(f"{kind}:"))).select(F.substring("id", F.lit(len(kind) + 2), F.length("id")).cast("long").alias(name))

    out = None
    for r in relations:
        e = r.rows.select(F.col(r.source_key).cast("long").alias("source"), F.col(r.target_key).cast("long").alias("target"))
        e = e.join(inside(r.target, "target"), "target", "left_semi").join(inside(r.source, "source"), "source", "left_semi")
        e = e.select(*[F.concat(F.lit(f"{k}:"), F.col(c).cast("string")).alias(c) for k, c in ((r.source, "source"), (r.target, "target"))], F.lit(r.kind).alias("kind"))
        out = e if out is None else out.unionByName(e)
    return out
