"""Whole-graph analytics: degrees, entry points, strongly connected components, layers, PageRank."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.session import cut, drop, stored


def kind_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def degree_total(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end; an edge without a target counts at its source."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def hotspots(edges: DataFrame, n: int = 20) -> DataFrame:
    return out_degree(edges).orderBy(F.desc("degree"), "id").limit(n)


def node_min_tier(edges: DataFrame, rank) -> DataFrame:
    """(id, rank): the most certain tier of a node's edges; ``rank`` maps the tier column to a number."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), rank(F.col("tier")).alias("rank")).where("id is not null")
    return ends.groupBy("id").agg(F.min("rank").alias("rank"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge leaves and none enters."""
    return nodes.join(edges.select(F.col("source").alias("id")), "id", "left_semi").join(edges.where("target is not null").select(F.col("target").alias("id")), "id", "left_anti")


def terminals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.where("target is not null").select(F.col("target").alias("id")), "id", "left_semi").join(edges.select(F.col("source").alias("id")), "id", "left_anti")


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters; roots are not exempt."""
    return nodes.join(edges.where("target is not null").select(F.col("target").alias("id")), "id", "left_anti")


def _spread(label: DataFrame, step: DataFrame) -> DataFrame:
    """The least label that reaches each node along ``step`` (at, to), to the fixpoint. label: (id, c)."""
    while True:
        come = step.join(label.withColumnRenamed("id", "at"), "at").groupBy(F.col("to").alias("id")).agg(F.min("c").alias("n"))
        new = stored(label.join(come, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved")))
        drop(label)
        label = new.select("id", "c")
        label._stored = new._stored
        if new.where("moved").isEmpty():
            return label


def _inside(e: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges (at, to) between ``ids``."""
    return e.join(ids.select(F.col("id").alias("at")), "at", "left_semi").join(ids.select(F.col("id").alias("to")), "to", "left_semi").select("at", "to")


def _coloured(left: DataFrame, e: DataFrame) -> DataFrame:
    """(id, c): the members of those components that hold the least node which reaches them, named by it. The least node that
    reaches a node is its colour; those of a colour that reach back to the node of that id are a component."""
    colour = _spread(left.select("id", F.col("id").alias("c")), e)
    same = stored(e.join(colour.select(F.col("id").alias("at"), F.col("c").alias("ca")), "at").join(colour.select(F.col("id").alias("to"), F.col("c").alias("cb")), "to").where("ca = cb").select(F.col("to").alias("at"), F.col("at").alias("to"), F.col("ca").alias("c")))
    front = stored(colour.where("id = c").select("id", "c"))
    parts = [front]
    while not front.isEmpty():
        got = reduce(DataFrame.unionByName, parts)
        front = stored(same.join(front.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("to").alias("id"), "c").distinct().join(got.select("id"), "id", "left_anti"))
        parts.append(front)
    got = stored(reduce(DataFrame.unionByName, parts))
    drop(colour, same, *parts)
    return got


def _sparse(e: DataFrame) -> DataFrame:
    """Two edges out of and two into each node, picked by hashes: aggregates by node, whatever the number of edges."""
    pick = lambda by, of: e.groupBy(by).agg(*(F.min_by(of, F.xxhash64("at", "to", F.lit(k))).alias(f"p{k}") for k in (1, 2)))
    out, back = pick("at", "to"), pick("to", "at")
    rows = out.select("at", F.explode(F.array("p1", "p2")).alias("to")).unionByName(back.select(F.explode(F.array("p1", "p2")).alias("at"), "to"))
    return rows.distinct()


def scc(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components, named by their least member.

    Nodes are whole numbers on the way: hashes of their ids, with another seed where two ids clash. What is connected by a
    few edges of each node is connected by all: components of such a sparse graph are found first, by one colouring, and drawn
    together. Few edges are then left as a rule; on them, whole, colouring goes on until every node has its component. Nodes
    that no cycle can hold (no edge in or none out) are trimmed first, each a component of its own.
    """
    ends = edges.where("target is not null and source is not null").select("source", "target")
    ids = stored(ends.select(F.col("source").alias("name")).distinct().unionByName(ends.select(F.col("target").alias("name")).distinct()).distinct())
    seed = 0
    code = lambda c: F.xxhash64(F.col(c), F.lit(seed))
    while not ids.groupBy(code("name").alias("h")).count().where("count > 1").isEmpty():
        seed += 1
    e = ends.select(code("source").alias("at"), code("target").alias("to"))
    some = stored(_sparse(e))
    first = _coloured(stored(some.select(F.col("at").alias("id")).union(some.select("to")).distinct()), some)
    drop(some)
    name = lambda a, b: first.select(F.col("id").alias(a), F.col("c").alias(b))
    drawn = e.join(name("at", "a"), "at", "left").select(F.coalesce("a", "at").alias("at"), "to").distinct()
    drawn = drawn.join(name("to", "b"), "to", "left").select("at", F.coalesce("b", "to").alias("to")).where("at <> to").distinct()
    e = stored(drawn)
    left = stored(e.select(F.col("at").alias("id")).union(e.select("to")).distinct())
    found = []
    while not left.isEmpty():
        while True:  # trim: nodes that go are components of their own
            core = stored(left.join(e.select(F.col("at").alias("id")), "id", "left_semi").join(e.select(F.col("to").alias("id")), "id", "left_semi"))
            if core.count() == left.count():
                break
            small = stored(_inside(e, core))
            drop(e, left)
            e, left = small, core
        if left.isEmpty():
            break
        got = _coloured(left, e)
        found.append(got)
        rest = stored(left.join(got, "id", "left_anti"))
        small = stored(_inside(e, rest))
        drop(e)
        e, left = small, rest
    nodes = ids.select("name", code("name").alias("id")).join(first, "id", "left").select("name", F.coalesce("c", "id").alias("id"))
    if found:
        last = reduce(DataFrame.unionByName, found)
        nodes = nodes.join(last, "id", "left").select("name", F.coalesce("c", "id").alias("id"))
    nodes = stored(nodes)
    least = nodes.groupBy("id").agg(F.min("name").alias("component"))
    return nodes.join(least, "id").select(F.col("name").alias("id"), "component")


def cycles(edges: DataFrame) -> DataFrame:
    """Components of more than one node, or with an edge to itself."""
    got = cut(scc(edges))
    loops = edges.where("source = target").select(F.col("source").alias("id")).distinct().withColumn("own", F.lit(True))
    groups = got.join(loops, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max(F.coalesce("own", F.lit(False))).alias("own"))
    return groups.where("size > 1 or own").select("component", "size")


def layers(edges: DataFrame) -> DataFrame:
    """(id, layer): the longest path from a node that nothing enters; a component of a cycle counts as one node."""
    comp = cut(scc(edges))
    name = lambda a, b: comp.select(F.col("id").alias(a), F.col("component").alias(b))
    e = cut(edges.where("target is not null").join(name("source", "a"), "source").join(name("target", "b"), "target").where("a <> b").select("a", "b").distinct())
    label = cut(comp.select(F.col("component").alias("id")).distinct().withColumn("layer", F.lit(0)))
    while True:
        come = e.join(label.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg((F.max("layer") + 1).alias("n"))
        new = cut(label.join(come, "id", "left").select("id", F.greatest("layer", F.coalesce("n", F.lit(0))).alias("layer"), (F.coalesce("n", F.lit(0)) > F.col("layer")).alias("moved")))
        label = new.select("id", "layer")
        if new.where("moved").isEmpty():
            return comp.join(label.withColumnRenamed("id", "component"), "component").select("id", "layer")


#: Rows of a group up to which one task ranks it; larger groups are ranked by joins.
GROUP_ROWS = 200_000


def _parts(sizes: DataFrame, most: int) -> tuple[bool, DataFrame, bool]:
    """Whether any group of ``sizes`` (grp, n) has up to ``most`` rows; the larger groups' names; whether there are any. A group
    without a name counts as small."""
    large = F.coalesce(F.col("grp").isNotNull() & (F.col("n") > most), F.lit(False))
    told = sizes.agg(F.count(F.when(~large, 1)).alias("small"), F.count(F.when(large, 1)).alias("large")).first()
    return told.small > 0, sizes.where(large).select("grp"), told.large > 0


def page_rank(groups: DataFrame, damping: float = 0.85, rounds: int = 20, most: int = GROUP_ROWS) -> DataFrame:
    """(grp, id, score) of personalised PageRank, a group at a time.

    ``groups``: (grp, source, target, anchor): edges of a local subgraph, and rows with a null target naming a node; anchor
    marks the node ``source`` as a place to restart from. Ranks start at 1/n, restart at anchors only, and nodes that
    nothing leaves spread evenly over all. Parallel edges count each. Groups of more than ``most`` rows are ranked by
    :func:`wide_page_rank`, so no task holds an unbounded group; both give the same scores.
    """
    small, names, large = _parts(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), most)
    if large and not small:
        return wide_page_rank(groups, damping, rounds, most)
    if large:
        rest = page_rank(groups.join(names, "grp", "left_anti"), damping, rounds, 1 << 62)
        return rest.unionByName(wide_page_rank(groups.join(names, "grp", "left_semi"), damping, rounds, most))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf.source, pdf.target[pdf.target.notna()]]).astype(str))
        at = {x: i for i, x in enumerate(ids)}
        e = pdf[pdf.target.notna()]
        src, dst = e.source.map(at).to_numpy(int), e.target.map(at).to_numpy(int)
        n, out = len(ids), np.bincount(e.source.map(at).to_numpy(int), minlength=len(ids)).astype(float)
        start = np.zeros(n)
        start[[at[x] for x in pdf.source[pdf.anchor].unique()]] = 1.0
        start /= start.sum() or 1.0
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
            rank = (1 - damping) * start + damping * (np.bincount(dst, share[src], n) + rank[out == 0].sum() / n)
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "id": ids, "score": rank})

    return groups.groupBy("grp").applyInPandas(one, "grp string, id string, score double")


def wide_page_rank(groups: DataFrame, damping: float = 0.85, rounds: int = 20, most: int = GROUP_ROWS) -> DataFrame:
    """:func:`page_rank` for groups of any size.

    Nodes that nothing enters have one rank if they are anchors (role 1) and one if not (role 2), so a row of a group stands for
    all of a role, and what they give a node is its column ``w1`` or ``w2`` times that rank. The rest (nodes that are entered, role
    0, and the edges between them) is ranked by one task a group where it has up to ``most`` rows. Else a round is one join
    along the edges and two aggregates; its lineage is cut, so a lost executor costs a round.
    """
    edge = F.col("source").isNotNull() & F.col("target").isNotNull()
    ends = groups.select("grp", F.col("source").alias("id"), "anchor", edge.cast("long").alias("out"), F.lit(False).alias("entered"))
    ends = ends.unionByName(groups.where("target is not null").select("grp", F.col("target").alias("id"), F.lit(False).alias("anchor"), F.lit(0).cast("long").alias("out"), F.lit(True).alias("entered")))
    nodes = ends.groupBy("grp", "id").agg(F.coalesce(F.max("anchor"), F.lit(False)).alias("anchor"), F.sum("out").alias("out"), F.max("entered").alias("entered"))
    role = F.when(F.col("entered"), 0).when(F.col("anchor"), 1).otherwise(2)
    nodes = cut(nodes.select("grp", "id", "anchor", "out", role.alias("role"), F.when(F.col("entered"), F.col("id")).alias("key")))
    size = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("int")).alias("anchors"))  # a row for each group
    e = groups.where("target is not null").select("grp", "source", "target").join(nodes.select("grp", F.col("id").alias("source"), "role", "key", "out"), ["grp", "source"])
    e = cut(e.groupBy("grp", "role", F.col("key").alias("source"), F.col("target").alias("key")).agg(F.sum(1.0 / F.col("out")).alias("weight")))
    given = e.where("role > 0").groupBy("grp", "key").agg(*[F.sum(F.when(F.col("role") == r, F.col("weight")).otherwise(0.0)).alias(f"w{r}") for r in (1, 2)])
    some = nodes.groupBy("grp", "role", "key").agg(F.max("anchor").alias("anchor"), F.sum((F.col("out") == 0).cast("long")).alias("ends")).join(F.broadcast(size), "grp").join(given, ["grp", "key"], "left")
    start = F.when(F.col("anchor"), 1.0 / F.col("anchors")).otherwise(0.0).alias("start")
    some = cut(some.select("grp", "role", "key", "ends", "n", start, *[F.coalesce(w, F.lit(0.0)).alias(w) for w in ("w1", "w2")]))
    e = e.where("role = 0").select("grp", "source", "key", "weight")

    def one(some: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        at = {x: i for i, (x, role) in enumerate(zip(some.key, some.role)) if role == 0}
        src, dst = e.source.map(at).to_numpy(int), e.key.map(at).to_numpy(int)
        weight, start, ends, w1, w2 = e.weight.to_numpy(float), *(some[c].to_numpy(float) for c in ("start", "ends", "w1", "w2"))
        n, of = some.n.iloc[0], [(some.role == r).to_numpy() for r in (1, 2)]
        rank = np.full(len(some), 1.0 / n)
        for _ in range(rounds):
            come = np.bincount(dst, rank[src] * weight, len(some)) + w1 * rank[of[0]].sum() + w2 * rank[of[1]].sum()
            rank = (1 - damping) * start + damping * (come + rank @ ends / n)
        return some[["grp", "role", "key"]].assign(score=rank)

    def joined(some: DataFrame, e: DataFrame) -> DataFrame:
        rank = some.withColumn("score", 1.0 / F.col("n"))
        for _ in range(rounds):
            share = rank.where("role = 0").select("grp", F.col("key").alias("source"), "score")
            come = e.join(share, ["grp", "source"]).groupBy("grp", "key").agg(F.sum(F.col("score") * F.col("weight")).alias("come"))
            told = rank.groupBy("grp").agg(F.sum(F.col("score") * F.col("ends")).alias("lost"), *[F.sum(F.when(F.col("role") == r, F.col("score")).otherwise(0.0)).alias(f"s{r}") for r in (1, 2)])
            come = some.join(come, ["grp", "key"], "left").join(F.broadcast(told), "grp")  # a row for each group
            got = F.coalesce("come", F.lit(0.0)) + F.col("w1") * F.col("s1") + F.col("w2") * F.col("s2") + F.col("lost") / F.col("n")
            rank = cut(come.select(*some.columns, ((1 - damping) * F.col("start") + damping * got).alias("score")))
        return rank.select("grp", "role", "key", "score")

    small, names, large = _parts(some.select("grp").unionByName(e.select("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("n")), most)
    score = joined(some.join(names, "grp", "left_semi"), e.join(names, "grp", "left_semi")) if large else None
    if small or not large:
        few = [df.join(names, "grp", "left_anti").select(*[F.col(c).alias(c) for c in df.columns]) if large else df for df in (some, e)]  # new columns: cogroup takes joined ones for ambiguous
        told = cut(few[0].groupBy("grp").cogroup(few[1].groupBy("grp")).applyInPandas(one, "grp string, role int, key string, score double"))
        score = told if score is None else score.unionByName(told)
    inner = nodes.where("role = 0").join(score.where("role = 0").select("grp", "key", "score"), ["grp", "key"])
    outer = nodes.where("role > 0").join(F.broadcast(score.where("role > 0").select("grp", "role", "score")), ["grp", "role"])  # up to two rows for each group
    return inner.select("grp", "id", "score").unionByName(outer.select("grp", "id", "score"))
