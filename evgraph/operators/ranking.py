"""Ranking, retrieval and packing into token budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evgraph.functions import text as X
from evgraph.operators.order import positions
from evgraph.schema import TIERS
from evgraph.session import cut

#: Components of a hybrid score (fixed values); a weight not given is 1, penalties included.
COMPONENTS = ("exact_anchor", "structural_proximity", "evidence_confidence", "claim_relevance", "change_relevance", "lexical_score", "semantic_score", "centrality", "diversity_penalty", "budget_cost")


def tier_rank(tier: Column) -> Column:
    """0 for the most certain tier, 4 for none known."""
    out = F.lit(4)
    for i, name in reversed(list(enumerate(TIERS))):
        out = F.when(tier == name, i).otherwise(out)
    return out


def tier_confidence(tier: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in TIERS.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def at_least(edges: DataFrame, tier: str) -> DataFrame:
    """Edges at least as certain as ``tier``."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    return edges.where(F.col("tier").isNotNull() & (tier_rank(F.col("tier")) <= list(TIERS).index(tier)))


def rank_nodes(reached: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(id, position): the root first, then by best tier, degree, depth, id. ``reached``: (id, depth)."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), tier_rank(F.col("tier")).alias("t")).where("id is not null")
    about = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.min("t").alias("t"))
    rows = reached.join(about, "id", "left").select("id", "depth", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("t", F.lit(99)).alias("t"))
    return positions(rows, [(F.col("id") != root).cast("int"), "t", F.desc("degree"), "depth", "id"]).select("id", F.col("position").cast("int").alias("position"))


def rank_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge columns, position): by tier, nearer end's depth, then source, target, kind."""
    depth = lambda end: reached.select(F.col("id").alias(end), F.col("depth").alias(f"d_{end}"))
    rows = edges.join(depth("source"), "source", "left").join(depth("target"), "target", "left")
    near = F.least(F.coalesce("d_source", F.lit(99)), F.coalesce("d_target", F.lit(99)))
    return positions(rows, [tier_rank(F.col("tier")), near, "source", "target", "kind"]).select(*edges.columns, F.col("position").cast("int").alias("position"))


def budget_prefix(rows: DataFrame, cost: str, order: list[str], budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order while their running cost is within the budget; the first row always. ``by``: a budget for each.

    A row costs 1 at least, so only the first ``budget`` + 1 rows (of each) are numbered and summed.
    """
    if by:
        most = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        rows = rows.withColumn("_most", most).where(F.col("_most") <= budget + 1).drop("_most")
    else:
        rows = rows.orderBy(*order).limit(budget + 1)
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    run = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("used", F.sum(cost).over(run)).withColumn("place", F.row_number().over(w.orderBy(*order)))
    return got.where((F.col("used") <= budget) | (F.col("place") == 1))


def budget_skip(rows: DataFrame, key: str, cost: str, order: list[str], budget: int, by: list[str]) -> DataFrame:
    """Rows in order, each taken if it fits what is left, else passed over. (by, key, taken)

    What is left only shrinks, so of the rows of one cost the first ones are taken, and no more than ``budget`` over the cost.
    The fold is over these candidates, which the budget bounds whatever the size of a group; all rows are then compared with
    the last one taken of their cost. Costs are 0 or more: 0 always fits, less is an error, and null is neither taken nor not.
    """
    at = [f"_by{i}" for i in range(len(by))]
    size = F.col(cost).cast("long")
    size = F.when(size < 0, F.raise_error(F.lit("a cost is less than 0"))).otherwise(size)
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("_cost").alias("cost"), F.col(key).alias("key"))
    rows = cut(rows.withColumn("_cost", size).select(*[F.col(c).alias(n) for c, n in zip(by, at)], "_cost", item.alias("_item")))
    nth = F.row_number().over(Window.partitionBy(*at, "_cost").orderBy("_item"))
    some = rows.where((F.col("_cost") > 0) & (F.col("_cost") <= budget)).withColumn("_nth", nth).where(F.col("_nth") <= max(budget, 0)).where(F.col("_nth") * F.col("_cost") <= budget)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(T.ArrayType(rows.schema["_item"].dataType)).alias("out"))
    fits = lambda acc, x: acc["used"] + x["cost"] <= budget
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    took = some.groupBy(*at).agg(F.aggregate(F.array_sort(F.collect_list("_item")), start, step)["out"].alias("out")).select(*at, F.explode("out").alias("_last"))
    last = took.groupBy(*at, F.col("_last.cost").alias("_cost"), "_last").agg(F.count(F.lit(1)).alias("_copies")).groupBy(*at, "_cost").agg(F.max(F.struct("_last", "_copies")).alias("_end"))
    last = last.select(*[F.col(n).alias(f"{n}_") for n in at], F.col("_cost").alias("_cost_"), "_end._last", "_end._copies")
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in at], F.col("_cost") == F.col("_cost_"))
    told = rows.join(cut(last), same, "left")
    ends = F.coalesce(F.col("_item") == F.col("_last"), F.lit(False))
    sure = told.where(~ends).withColumn("taken", F.when(F.col("_cost") == 0, F.lit(budget >= 0)).when(F.col("_cost").isNotNull(), F.coalesce(F.col("_item") < F.col("_last"), F.lit(False))))
    # rows like the last one in everything: as many as were taken
    tied = told.where(ends).withColumn("taken", F.row_number().over(Window.partitionBy(*at, "_cost").orderBy("_item")) <= F.col("_copies"))
    return sure.unionByName(tied).select(*[F.col(n).alias(c) for c, n in zip(by, at)], F.col("_item.key").alias(key), "taken")


def lexical_search(nodes: DataFrame, query_terms: list[str], limit: int = 20) -> DataFrame:
    """(id, score): nodes by how many terms their kind, name and path contain; a pool of max(3n, n + 20) of them."""
    score = X.term_score(F.concat_ws(" ", "kind", "name", "path"), query_terms) if query_terms else F.lit(1)
    return nodes.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(max(3 * limit, limit + 20))


def token_index(nodes: DataFrame) -> DataFrame:
    """(token, id): the inverted index of names."""
    return nodes.select(F.explode(X.symbol_tokens(F.col("name"))).alias("token"), "id")


def term_search(index: DataFrame, tokens: list[str], limit: int = 20) -> DataFrame:
    """(id, token): the hits of the longest token that has any; of equal lengths the first given; ``*`` if none has."""
    spark = index.sparkSession
    order = sorted(dict.fromkeys(tokens), key=lambda t: (-len(t), tokens.index(t))) + ["*"]
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(order)], "token string, place int")
    hits = index.join(F.broadcast(asked), "token")  # as many rows as the query has words
    best = hits.agg(F.min("place").alias("place"))
    return hits.join(F.broadcast(best), "place").orderBy("id").limit(limit).select("id", "token")


def vector_search(vectors: DataFrame, query: list[float], limit: int | None = 10, least: float | None = None) -> DataFrame:
    """(id, score) by cosine; vectors of another length or of norm zero are passed over. No limit: all, in no order."""
    got = vectors.select("id", X.cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in query])).alias("score")).where("score is not null")
    if least is not None:
        got = got.where(F.col("score") >= least)
    return got if limit is None else got.orderBy(F.desc("score"), "id").limit(limit)


def hybrid_rank(candidates: DataFrame, semantic: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score, components): candidates (id and any components) with the semantic score of ``semantic`` (id, score)."""
    weights = weights or {}
    rows = candidates.join(semantic.select("id", F.col("score").alias("_semantic")), "id", "left")
    value = {c: F.coalesce(F.col("_semantic") if c == "semantic_score" else F.col(c) if c in candidates.columns else F.lit(0.0), F.lit(0.0)).cast("double") for c in COMPONENTS}
    total = sum((F.lit(float(weights.get(c, 1))) * v for c, v in value.items()), F.lit(0.0))
    return rows.select("id", total.alias("score"), *(v.alias(c) for c, v in value.items()))


def capped(rows: DataFrame, order: list, by: str, each: int, total: int | None = None) -> DataFrame:
    """Rows in order, ``each`` of a group at most and ``total`` in all."""
    got = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= each)
    return got.orderBy(*order).limit(total) if total else got


def percentile_nearest(rows: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """The nearest-rank percentile: the ceil(q n)-th of the sorted values."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("value"), F.count(F.lit(1)).alias("n"))


def score_cases(ranked: DataFrame, gold: DataFrame, at: int = 10) -> DataFrame:
    """For each query: its first right rank (null: none), hit within ``at``, reciprocal rank. ranked: (q, id, rank)."""
    first = ranked.join(gold, ["q", "id"]).groupBy("q").agg(F.min("rank").alias("rank"))
    return gold.select("q").distinct().join(first, "q", "left").select("q", "rank", (F.coalesce("rank", F.lit(at + 1)) <= at).alias("hit"), F.when(F.col("rank") <= at, 1 / F.col("rank")).otherwise(0.0).alias("rr"))


def vector_upsert(vectors: DataFrame, entries: DataFrame, model: str = "unknown") -> DataFrame:
    """vectors (id, v, model) with the ``entries`` (seq, id, v, model) written over them: the last of an id counts. Entries
    without an id, or with a null or empty vector, are passed over; those without a model get ``model``."""
    good = entries.where("id is not null and v is not null and size(v) > 0").withColumn("model", F.coalesce("model", F.lit(model)))
    last = good.groupBy("id").agg(F.max_by(F.struct("v", "model"), "seq").alias("e")).select("id", "e.v", "e.model")
    return vectors.select("id", "v", "model").join(last.select("id"), "id", "left_anti").unionByName(last)


def vector_scan(vectors: DataFrame, query: list[float], limit: int | None = 10, least: float | None = None, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`vector_search` among the vectors of ``model`` (None: all), and (scanned, dim_mismatches) of them. A query that is
    empty or of norm zero scans nothing."""
    rows = vectors if model is None else vectors.where(F.col("model") == model)
    if not any(query):
        rows = rows.where("false")
    told = rows.agg(F.count(F.lit(1)).alias("scanned"), F.coalesce(F.sum((F.size("v") != len(query)).cast("long")), F.lit(0).cast("long")).alias("dim_mismatches"))
    return vector_search(rows, query, limit, least), told


def qualify(expected: DataFrame, actual: DataFrame, exact: tuple[str, ...] = ("symbol_definition",)) -> DataFrame:
    """(task, kind, expected, missing, state): whether a task's answers hold the evidence that it asks for.

    expected: (task, kind, path, start, end, content_hash); actual: (task, path, start, end, content_hash). A piece is there
    if an answer of the same contents, at the path or at one that ends with it, has the same span (kinds of ``exact``) or
    one that covers it. Only answers of a task and of equal contents meet its pieces.
    """
    want = expected.select("task", "kind", "path", "start", "end", "content_hash").distinct()
    got = actual.select("task", "content_hash", F.col("path").alias("a_path"), F.col("start").alias("a_start"), F.col("end").alias("a_end")).distinct()
    same = (F.col("a_path") == F.col("path")) | F.endswith("a_path", F.concat(F.lit("/"), "path"))
    span = F.when(F.col("kind").isin(*exact), (F.col("a_start") == F.col("start")) & (F.col("a_end") == F.col("end"))).otherwise((F.col("a_start") <= F.col("start")) & (F.col("a_end") >= F.col("end")))
    met = want.join(got, ["task", "content_hash"]).where(same & span).select(*want.columns).distinct().withColumn("met", F.lit(True))
    rows = want.join(met, want.columns, "left")
    out = rows.groupBy("task", "kind").agg(F.count(F.lit(1)).alias("expected"), F.count(F.when(F.col("met").isNull(), 1)).alias("missing"))
    return out.withColumn("state", F.when(F.col("missing") == 0, "passed").otherwise("failed"))
