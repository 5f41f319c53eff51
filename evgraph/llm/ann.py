"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of ``M`` full-dimensional codewords, one of each codebook. Codebooks are trained on a
bounded sample: k-means of what the books before leave over, then ``ROUNDS`` of beam-search encoding and of fitting each
book anew to what all others leave. Every row is encoded once, by beam search, and the index of its code, its
approximation's norm and its vector is written. A search builds a lookup table of query-codeword products, scores codes by
table lookup (an inner product needs no more; a distance adds the stored norm), and reranks the best exactly on the
original vectors.

All rows are indexed. The queries come in blocks of bounded size, each broadcast to a pass over the index, so no row is
shuffled. A task scores its rows a part of bounded size at a time, reranks the ``RERANK`` best of each part (three in a
thousand of a full one), and returns its k best of each query. Equal vectors of a part share one code and one candidate
place, and stand for their smallest keys, of which no answer can need more than k + 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, ship, table, written

M, K, BEAM, SAMPLE, ROUNDS = 32, 256, 3, 8192, 1
PART_ROWS, BLOCK_QUERIES, BLOCK_BYTES, RERANK = 32768, 16384, 16 << 20, 100


def clean(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Rows that take part, as (id, v array<double>): not null, not zero, every component finite, and of the length that
    most such rows have (of lengths equally common, the smallest): one index holds one kind of vector."""
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where(ok)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == usual[0].d) if usual else rows


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def encode(books: np.ndarray, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x M) by beam search over the residuals."""
    m, k, _ = books.shape
    out = np.zeros((len(x), m), np.uint8)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024].astype(np.float32)
        n = len(part)
        res, codes, err = part[:, None, :], np.zeros((n, 1, 0), np.uint8), (part * part).sum(1)[:, None]
        for j in range(m):
            c = books[j].astype(np.float32)
            e = err[:, :, None] - 2 * res @ c.T + (c * c).sum(1)
            e = e.reshape(n, -1)
            b = min(beam, e.shape[1])
            pick = np.argpartition(e, b - 1, axis=1)[:, :b] if b < e.shape[1] else np.tile(np.arange(b), (n, 1))
            row, was, word = np.arange(n)[:, None], pick // k, pick % k
            res = res[row, was] - c[word]
            codes = np.concatenate([codes[row, was], word[:, :, None].astype(np.uint8)], 2)
            err = e[row, pick]
        out[lo : lo + n] = codes[np.arange(n), err.argmin(1)]
    return out


def decode(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def train(x: np.ndarray, m: int = M, k: int = K, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (m x k x dimensions)."""
    rng, x = np.random.default_rng(11), x.astype(np.float32)
    res, books = x, []
    for _ in range(m):
        c = _kmeans(res, k, rng)
        res = res - c[((c * c).sum(1) - 2 * res @ c.T).argmin(1)]
        books.append(c)
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(books, x)
        res = x - decode(books, codes)
        for j in range(m):  # each word becomes the mean of what the other books leave for it
            n = np.bincount(codes[:, j], minlength=k)
            sums = np.zeros((k, x.shape[1]), np.float32)
            np.add.at(sums, codes[:, j], res)
            step = sums / np.maximum(n, 1)[:, None]
            books[j] += step
            res = res - step[codes[:, j]]
    return books


def fit(rows: DataFrame, sample: int = SAMPLE, m: int = M, k: int = K) -> np.ndarray | None:
    """Codebooks for ``rows`` (id, v), fitted on the ``sample`` rows of least hash; None if there is no row."""
    got = rows.orderBy(F.xxhash64("id"), F.xxhash64("v")).limit(sample).toArrow()
    return train(_vectors(got["v"]), m, k) if got.num_rows else None


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(rows: DataFrame, books: np.ndarray | None) -> DataFrame:
    """The index, written: (id, v, code, norm) of every row of ``rows`` (id, v), already :func:`clean`."""
    shape = "id long, v array<double>, code binary, norm float"
    if books is None:
        return rows.sparkSession.createDataFrame([], shape)
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                codes = encode(held.value, _vectors(b.column(1)))
                norm = (decode(held.value, codes).astype(np.float64) ** 2).sum(1).astype(np.float32)
                ends = pa.py_buffer(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                code = pa.Array.from_buffers(pa.binary(), len(codes), [None, ends, pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(norm)], ["id", "v", "code", "norm"])

    return written(rows.select("id", "v").mapInArrow(frugal(run), shape), "index")


def exact(rows: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores in double precision; a row's does not depend on the rows beside it, so equal vectors score alike."""
    return (rows * q).sum(1) if metric == "ip" else -((rows - q) ** 2).sum(1)


def search_block(books: np.ndarray, part: dict[str, np.ndarray], qids: np.ndarray, q: np.ndarray, k: int, rerank: int, metric: str = "ip") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query its best of one part (ids, x, codes, norms): keys and exact scores, the best first. Ties by the smaller
    key; never the query's own row."""
    order = np.argsort(part["ids"], kind="stable")
    ids, x = part["ids"][order], part["x"][order]
    whole = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1]))).reshape(-1)
    _, first, kind, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    by = np.argsort(kind.reshape(-1), kind="stable")  # within a kind by key
    begins = np.concatenate([[0], np.cumsum(count)])
    kinds, codes, norms = x[first], part["codes"][order][first], part["norms"][order][first]
    m, top = len(books), min(rerank, len(kinds))
    flat = np.ascontiguousarray((codes.astype(np.int64) + np.arange(m) * books.shape[1]).T)
    words = books.reshape(-1, books.shape[2])
    for lo in range(0, len(q), 64):
        some = q[lo : lo + 64]
        lut = some.astype(np.float32) @ words.T
        score = lut[:, flat[0]]
        for j in range(1, m):
            score += lut[:, flat[j]]
        if metric == "l2":
            score = 2 * score - norms
        near = np.argpartition(-score, top - 1, axis=1)[:, :top] if top < len(kinds) else np.tile(np.arange(top), (len(some), 1))
        for i, cand in enumerate(near):
            s = exact(kinds[cand], some[i], metric)
            best = np.argsort(-s, kind="stable")
            best = best if len(best) <= k + 1 else best[s[best] >= s[best[k]]]
            got_v = np.concatenate([ids[by[begins[c] : min(begins[c] + k + 1, begins[c + 1])]] for c in cand[best]])
            got_s = np.repeat(s[best], np.minimum(count[cand[best]], k + 1))
            ok = got_v != qids[lo + i]
            got_v, got_s = got_v[ok], got_s[ok]
            keep = np.lexsort((got_v, -got_s))[:k]
            yield got_v[keep], got_s[keep]


def search(held_index: DataFrame, queries: DataFrame, books: np.ndarray | None, k: int = 20, rerank: int = RERANK, metric: str = "ip") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query (all rows, if fewer).

    ``held_index`` is that of :func:`index`; ``queries`` has (id, v), :func:`clean` and of the index's length. A query's own
    id is no answer. Score: the exact inner product, or minus the squared distance. Repeated ids are several rows;
    repeated queries of one id and vector are one. No rows or queries: no result.
    """
    spark = held_index.sparkSession
    ship(spark)
    shape = "query_id long, rank int, vec_id long, score double"
    queries = queries.select("id", "v").distinct()
    if books is None or not (asked := queries.count()):
        return spark.createDataFrame([], shape)
    model = spark.sparkContext.broadcast(books)
    blocks = max(-(-asked // BLOCK_QUERIES), -(-asked * books.shape[2] * 8 // BLOCK_BYTES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    queries = written(queries, "queries") if blocks > 1 else queries
    paths = []
    for nth in range(blocks):
        got = queries.where(F.col("block") == nth).select("id", "v").toArrow()  # about BLOCK_QUERIES rows, BLOCK_BYTES
        if got.num_rows:
            paths.append(_block(held_index, got["id"].to_numpy(), _vectors(got["v"]), model, k, rerank, metric))
            if blocks > 1:
                paths[-1] = written(paths[-1], "found")
    return reduce(DataFrame.union, paths)


def _block(held_index: DataFrame, ids: np.ndarray, vectors: np.ndarray, model: Broadcast, k: int, rerank: int, metric: str) -> DataFrame:
    """The answers to one block of queries, by one pass over the index."""
    ask = held_index.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, (qids, q) = model.value, ask.value
        vec = [np.zeros(0, np.int64)] * len(qids)
        score = [np.zeros(0)] * len(qids)
        for part in _parts(batches):
            for i, (v, s) in enumerate(search_block(books, part, qids, q, k, rerank, metric)):
                v, s = np.concatenate([vec[i], v]), np.concatenate([score[i], s])
                keep = np.lexsort((v, -s))[:k]
                vec[i], score[i] = v[keep], s[keep]
        sizes = [len(v) for v in vec]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(qids)), sizes)), pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate(vec)), pa.array(np.concatenate(score))], ["nth", "query_id", "vec_id", "score"])

    found = held_index.mapInArrow(frugal(run), "nth long, query_id long, vec_id long, score double")
    w = Window.partitionBy("nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a task, about PART_ROWS at a time."""
    held, n = [], 0

    def part() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return {"ids": t["id"].to_numpy(), "x": _vectors(t["v"]), "codes": codes, "norms": t["norm"].to_numpy()}

    for b in batches:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= PART_ROWS:
            yield part()
            held, n = [], 0
    if held:
        yield part()


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of each vector whose vec_id is divisible by 20, among all others."""
    rows = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    books = fit(rows)
    return search(index(rows, books), rows.where(F.col("id") % 20 == 0), books)
