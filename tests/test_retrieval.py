"""Retrieval over more rows than the small tables have."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.plans import retrieval


def test_more_than_a_million_vectors(spark, sf, monkeypatch):
    n = 1_000_007
    monkeypatch.setattr(retrieval, "_query_vector", lambda spark, d: [1.0, 0.0])
    monkeypatch.setattr(retrieval, "_vectors", lambda spark, d: spark.range(n).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"), F.lit(0).alias("label")))
    assert retrieval.cosine_min_score(spark, sf).where("score = 1").count() == n
    assert retrieval.hybrid(spark, sf).where("score = 1.5 + id % 3").count() == n


def test_nearest_is_what_joins_give(spark):
    """blocks of matrices against the join of all pairs, with ties, copies, odd lengths, nulls and zeros."""
    import numpy as np

    from pyspark.sql import Window

    from evgraph.functions import text as X
    from evgraph.operators import nearest

    rng = np.random.default_rng(5)
    some = rng.integers(-2, 3, (40, 4)).astype(float)
    data = [(i, some[i % 40].tolist() if i % 3 else rng.normal(size=4).tolist(), i % 5) for i in range(3_000)]
    data += [(3_000, None, 1), (3_100, [0.0] * 4, 2), (3_200, [1.0, 2.0], 3), (3_201, [1.0, 2.5], None), (3_300, [1.0, None, 0.0, 1.0], 1), (3_400, [1e-200] * 4, 1), (3_500, [float("nan"), 1.0, 1.0, 1.0], 1), (3_600, [], 1), (100, [5.0, 1.0, 0.0, 0.0], 4), (None, [1.0] * 4, 1)]
    v = spark.createDataFrame(data, "id long, v array<double>, label int").repartition(3)
    q = v.where("id % 100 = 0").select(F.col("id").alias("q"), "v", "label")
    pairs = v.join(q.select("q", F.col("v").alias("qv"), F.col("label").alias("ql")), F.col("id") != F.col("q")).select("q", "id", F.round(X.cosine(F.col("v"), F.col("qv")), 9).alias("s"), (F.col("label") == F.col("ql")).alias("right"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where("rank <= 10").select("q", "id", "rank", "right")
    got = nearest.nearest(v, q, 10, 9)
    key = lambda r: (r.q, r.rank)
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=key)] == [tuple(r)[:3] for r in sorted(want.collect(), key=key)]
    assert nearest.nearest(v, q.where("false")).count() == 0


def test_recall_of_many_vectors(spark, sf, monkeypatch):
    """36 million pairs, which took minutes a pair at a time."""
    import time

    v = spark.range(60_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin((F.col("id") * 131 + k * k * 7).cast("double"))).alias("v"), (F.col("id") % 7).alias("label"))
    monkeypatch.setattr(retrieval, "_vectors", lambda spark, d: v)
    began = time.time()
    assert retrieval.recall_mrr(spark, sf).first().cases == 600
    assert time.time() - began < 45
