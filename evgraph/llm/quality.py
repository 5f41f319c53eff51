"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Features of a text are indicators of its words, word pairs and byte trigrams, hashed into ``BUCKETS``. Each is scaled
by the class log-count ratio, every text is brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. The fit takes at most ``MAX_TRAIN`` labelled texts, those of the least hash of their key; the model
is one float per bucket. Scoring is one pass over the texts with the model broadcast: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import M1, bucket_of, fresh, frugal, grams, ship, stage, table, text_slices, utf8, word_hashes, words

SCORE = "quality_score"
BUCKETS, MAX_TRAIN, EPOCHS, C, ALPHA = 1 << 16, 12_000, 12, 1.0, 1.0
SLICE = 1 << 20


def indicators(arr: pa.Array, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The sorted distinct buckets of each text; none for a null or empty one."""
    buf, off = utf8(arr)
    starts, ends, begins = words(buf, off)
    h = word_hashes(buf, starts, ends)
    top = np.uint64(64 - (buckets.bit_length() - 1))
    one = ((h * M1) >> top).astype(np.int64)
    pair, at = grams(h, begins, 2)
    two = (pair >> top).astype(np.int64)
    pair_begins = np.searchsorted(at, begins)
    n = len(buf) - 8
    x = buf[: n + 2].astype(np.uint32)
    tri = (x[:n] | (x[1 : n + 1] << np.uint32(8)) | (x[2 : n + 2] << np.uint32(16))) * np.uint32(0x9E3779B1)
    three = (tri >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)
    seen = np.zeros(buckets, bool)
    for i in range(len(off) - 1):
        seen[one[begins[i] : begins[i + 1]]] = True
        seen[two[pair_begins[i] : pair_begins[i + 1]]] = True
        seen[three[off[i] : max(off[i], off[i + 1] - 2)]] = True
        got = np.flatnonzero(seen)
        seen[got] = False
        yield got


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights (per bucket, of the scaled features) and bias of min |w|^2/2 + c * sum of hinge losses; y is -1 or 1."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    square = scale * scale
    unit = np.array([1.0 / (np.sqrt(square[r].sum()) or 1.0) for r in rows])  # features are scaled when met: only their numbers are held
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r] * unit[i]
            g = y[i] * (w[r] @ x + bias) - 1.0
            new = min(max(alpha[i] - g / (x @ x + 1.0), 0.0), c)
            if d := new - alpha[i]:
                alpha[i] = new
                w[r] += d * y[i] * x
                bias += d * y[i]
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, buckets: int = BUCKETS) -> dict:
    """A model from the labelled rows of ``labels`` (key, label 0 or 1; others and nulls don't count).

    Where a key has several labels the larger counts; where it has several texts, that of the least hash of its features
    does, so the order in which rows arrive decides nothing. Without labels of both classes every text scores one half.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    number = np.dtype(np.uint16 if buckets <= 65536 else np.int32)
    picked = known.orderBy(F.xxhash64("_k"), "_k").limit(max_train)  # at most max_train short rows: safe to broadcast

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_slices(b.column(0), SLICE):
                got = [x.astype(number).tobytes() for x in indicators(b.column(0).slice(lo, hi - lo), buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)], ["x", "_y", "_k"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(picked), "_k").select("_t", F.col("_y").cast("int").alias("_y"), F.col("_k").cast("long").alias("_k"))
    found = rows.mapInArrow(frugal(features), "x binary, _y int, _k long")
    got = found.groupBy("_k").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x", "_y")).alias("m")).select("_k", "m.x", "m._y").toArrow()  # max_train rows at most
    order = np.argsort(got["_k"].to_numpy(), kind="stable")
    xs = [np.frombuffer(got["x"][int(i)].as_py(), number) for i in order]
    y = np.where(got["_y"].to_numpy()[order] == 1, 1.0, -1.0) if len(order) else np.zeros(0)
    del got
    if not (y > 0).any() or not (y < 0).any():
        return {"w": np.zeros(buckets), "scale": np.zeros(buckets), "bias": 0.0}
    p, q = (np.full(buckets, ALPHA) for _ in range(2))
    for r, s in zip(xs, y, strict=True):
        (p if s > 0 else q)[r] += 1
    scale = np.log((p / p.sum()) / (q / q.sum()))
    w, bias = dual_coordinate_descent(xs, y, scale, C, EPOCHS)
    return {"w": w * scale, "scale": scale * scale, "bias": bias}


def score_batch(model: dict, arr: pa.Array) -> np.ndarray:
    buckets, out = len(model["w"]), np.zeros(len(arr))
    for i, r in enumerate(indicators(arr, buckets)):
        out[i] = model["w"][r].sum() / (np.sqrt(model["scale"][r].sum()) or 1.0)
    return 1.0 / (1.0 + np.exp(-2.0 * np.clip(out + model["bias"], -30, 30)))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, and quality_score (0 to 1) of every row, from its whole text.

    A null or empty text has no feature: its score is the bias alone. Repeated rows score alike. A column of ``keep``
    that is named as the score gives way to it.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    cols = [key, *(c for c in keep if c not in (key, text) and c.lower() != SCORE)]
    also = [c for c in keep if c == text]
    (whole,) = fresh(docs.columns, "_text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_slices(b.column(0), SLICE):
                part = b.slice(lo, hi - lo)
                got = pa.array(score_batch(held.value, part.column(0)))
                yield pa.RecordBatch.from_arrays([*(part.columns if also else part.columns[1:]), got], names=[*(part.schema.names if also else part.schema.names[1:]), SCORE])

    source = docs.select(F.col(text).alias(whole), *cols)
    kinds = StructType([*(f for f in source.schema if also or f.name != whole), StructField(SCORE, DoubleType())])
    out = source.mapInArrow(frugal(run), kinds)
    return out.withColumnRenamed(whole, text) if also else out


def _model(spark, sf_dir: str) -> dict:
    labels = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 3) != 1)
    return fit(table(spark, sf_dir, "documents"), labels)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents; a null doc_id is not held out and not learned from."""
    got = score(table(spark, sf_dir, "documents"), _model(spark, sf_dir))
    return got.select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@stage
def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier does not reject, with their columns.

    Null and empty texts are judged by the bias alone; repeated rows alike; very long texts whole. No rows: none. Columns
    besides doc_id and text pass through, whatever their names.
    """
    got = score(docs, _model(spark, sf_dir), keep=tuple(docs.columns))
    return got.where(F.col(SCORE) >= 0.5).select(*docs.columns)
