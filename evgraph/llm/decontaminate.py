"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Items are indexed in pieces of ``PIECE`` words at most, and every passage of every training text is a query: passages of
``PASSAGE`` words, each beginning half a passage after the last, so that some passage holds a whole piece. Scores are
divided by the piece's score for itself, so one threshold fits all. Pieces lie in at most ``BLOCKS`` blocks; the sum of a
passage's block-maximum weights bounds the score of every piece of the block, and is taken for all passages of a slice at
once. For the passages that remain it is taken again, over their distinct words and over finer blocks (as many as
``CELLS`` maxima allow). In the fine blocks that remain, WAND walks the postings by pivot and scores only pieces that can
reach the threshold: all of them are retrieved. A pair is reported when the passage (for an item of several pieces: with as many words on either
side as the item has besides the piece) also holds the item's word trigrams, of its question and of its answer. So what is
found of an item depends on its own length only, never on the other items'.

The index is broadcast. Benchmarks beyond ``SHARD_BYTES`` of text are searched a shard at a time, by the weights of the
whole benchmark, so how items are split decides nothing. Texts are read once a shard and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, grams, ship, stage, table, text_slices, utf8, word_hashes, words, written

PASSAGE, PIECE, BLOCKS, CELLS, SHARD_BYTES, GRAM = 128, 64, 16, 4 << 20, 4 << 20, 3
K1, B, THRESHOLD, BOTH, EACH = 1.2, 0.75, 0.6, 0.6, 0.3
TABLE_BITS = 20

#: Bytes that part words: all of ASCII but letters and digits.
PARTS = np.ones(256, bool)
PARTS[128:] = False
PARTS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of every text, and where each text's begin."""
    buf, off = utf8(pc.utf8_lower(arr.cast(pa.string())))
    starts, ends, begins = words(buf, off, PARTS)
    return word_hashes(buf, starts, ends, seed=3), begins


def item_tokens(questions: list[str | None], answers: list[str | None] | None) -> tuple[np.ndarray, np.ndarray]:
    whole = [f"{q or ''}\n{a or ''}" for q, a in zip(questions, answers, strict=True)] if answers else [q or "" for q in questions]
    return tokens(pa.array(whole, pa.string()))


def pieces(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of all items begin (and the last ends), and each piece's item: an item of more than PIECE words is
    cut into equal parts, as few as possible."""
    size = np.diff(begins)
    parts = -(-size // PIECE)
    item = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(item)) - (np.cumsum(parts) - parts)[item]
    return np.append(begins[:-1][item] + size[item] * nth // parts[item], begins[-1]), item


class Whole(NamedTuple):
    """What weights depend on, of a whole benchmark: its pieces, their words in all, and in how many pieces each word of a
    shard occurs (sorted hashes, counts)."""

    n: int
    total: int
    hashes: np.ndarray
    df: np.ndarray


class Index:
    """Postings of one shard's pieces, their block maxima, and what verification needs of each item. ``whole``: of the
    benchmark that the items are a shard of, if they aren't all of it."""

    def __init__(self, ids: list[int | None], questions: list[str | None], answers: list[str | None] | None, whole: Whole | None = None):
        h, begins = item_tokens(questions, answers)
        size = np.diff(begins)
        if answers:
            split = np.diff(tokens(pa.array(questions, pa.string()))[1])
        else:  # a text of one piece: its first half asks, its second answers
            split = (size + 1) // 2
        self.ids, self.size = ids, size
        cut, item = pieces(begins)
        length = np.diff(cut)
        order = np.lexsort((np.arange(len(length)), length))  # alike in length, so a block's maxima are tight
        self.item = item[order]
        n = len(order)
        self.rest = size[self.item] - length[order]  # words of the item besides the piece
        self.vocabulary = np.unique(h)
        docs = [np.searchsorted(self.vocabulary, h[cut[i] : cut[i + 1]]) for i in order]
        if whole:
            df = whole.df[np.searchsorted(whole.hashes, self.vocabulary)].astype(float)
        else:
            df = np.zeros(len(self.vocabulary))
            for d in docs:
                df[np.unique(d)] += 1
        many, total = (whole.n, whole.total) if whole else (n, int(size.sum()))
        idf = np.log(1 + (many - df + 0.5) / (df + 0.5))
        mean = total / many if many else 1.0
        most = max(BLOCKS, CELLS // (len(self.vocabulary) + 1))
        self.block = -(-n // most) or 1
        coarse = -(-n // BLOCKS) or 1
        self.maxima = np.zeros((len(self.vocabulary) + 1, BLOCKS), np.float32)
        self.fine = np.zeros((len(self.vocabulary) + 1, -(-n // self.block) or 1), np.float32)
        post: dict[int, list] = {}
        for k, d in enumerate(docs):
            t, tf = np.unique(d, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
            w /= w.sum()
            for table, size in ((self.maxima, coarse), (self.fine, self.block)):
                table[t, k // size] = np.maximum(table[t, k // size], w)
            for a, b in zip(t.tolist(), w.tolist(), strict=True):
                post.setdefault(a, []).append((k, b))
        self.postings = {t: (np.array([k for k, _ in p]), [w for _, w in p]) for t, p in post.items()}
        self.question, self.answer = [], []
        for i in range(len(ids)):
            x = h[begins[i] : begins[i + 1]]
            for part, out in ((x[: split[i]], self.question), (x[split[i] :], self.answer)):
                m = min(GRAM, len(part))
                out.append((m, np.unique(grams(part, np.array([0, len(part)]), m)[0]) if m else np.zeros(0, np.uint64)))
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.table[(self.vocabulary >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = np.arange(len(self.vocabulary))
        crowded = self.table[(self.vocabulary >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] != np.arange(len(self.vocabulary))
        self.crowd = {int(self.vocabulary[t]): int(t) for t in np.flatnonzero(crowded)}

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes; words that no item has get the last."""
        none = len(self.vocabulary)
        if not none:
            return np.zeros(len(h), np.int64)
        t = self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        ok = (t >= 0) & (self.vocabulary[t] == h)
        out = np.where(ok, t, none).astype(np.int64)
        if self.crowd:
            odd = np.flatnonzero(~ok & (t >= 0))
            keys = np.array(sorted(self.crowd), np.uint64)
            at = np.minimum(np.searchsorted(keys, h[odd]), len(keys) - 1)
            hit = keys[at] == h[odd]
            out[odd[hit]] = [self.crowd[int(x)] for x in h[odd[hit]]]
        return out

    def wand(self, terms: list[int], blocks: list[int], threshold: float) -> list[tuple[int, float]]:
        """All pieces of the fine blocks whose score for the distinct ``terms`` reaches the threshold."""
        out = []
        for b in blocks:
            end = (b + 1) * self.block
            lists = []
            for t in terms:
                if (top := float(self.fine[t, b])) > 0:
                    items, weights = self.postings[t]
                    lists.append([int(np.searchsorted(items, b * self.block)), items, weights, top])
            while True:
                live = sorted((x for x in lists if x[0] < len(x[1]) and x[1][x[0]] < end), key=lambda x: x[1][x[0]])
                bound, pivot = 0.0, None
                for x in live:
                    bound += x[3]
                    if bound >= threshold:
                        pivot = int(x[1][x[0]])
                        break
                if pivot is None:
                    break
                if live[0][1][live[0][0]] == pivot:
                    score = 0.0
                    for x in live:
                        if x[1][x[0]] != pivot:
                            break
                        score += x[2][x[0]]
                        x[0] += 1
                    if score >= threshold:
                        out.append((pivot, score))
                else:
                    for x in live:
                        if x[1][x[0]] >= pivot:
                            break
                        x[0] += int(np.searchsorted(x[1][x[0] :], pivot))
        return out

    def hits(self, arr: pa.Array, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
        """(row, item id, best score, question and answer overlap) of every text of ``arr`` that holds an item."""
        h, begins = tokens(arr)
        if not len(h) or not len(self.item):
            return []
        half = PASSAGE // 2
        parts = -(-np.diff(begins) // half)
        row = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(row)) - (np.cumsum(parts) - parts)[row]
        starts = begins[:-1][row] + nth * half
        t = self.terms(h)
        sums = np.add.reduceat(self.maxima[t], starts, axis=0)
        follows = np.append(row[1:] == row[:-1], False)
        bound = sums.copy()
        bound[:-1][follows[:-1]] += sums[1:][follows[:-1]]
        ends = np.minimum(starts + PASSAGE, begins[1:][row])
        passage = np.flatnonzero((bound.max(1) >= threshold - 1e-4) & (follows | (nth == 0)))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        none = len(self.vocabulary)
        for k in passage.tolist():
            distinct = np.unique(t[starts[k] : ends[k]])
            distinct = distinct[distinct < none]
            exact = self.fine[distinct].sum(0)
            blocks = np.flatnonzero(exact >= threshold - 1e-4).tolist()
            seen: dict[int, list[np.ndarray]] = {}
            for piece, score in self.wand(distinct.tolist(), blocks, threshold) if blocks else ():
                item, more = int(self.item[piece]), int(self.rest[piece])
                if more not in seen:
                    x = h[max(begins[row[k]], starts[k] - more) : min(begins[row[k] + 1], ends[k] + more)]
                    seen[more] = [np.sort(grams(x, np.array([0, len(x)]), m)[0]) for m in range(1, GRAM + 1)]
                held = self.verified(item, seen[more])
                if held is not None:
                    key = (int(row[k]), item)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *held))
        return [(r, self.ids[item], *found) for (r, item), found in sorted(best.items())]

    def verified(self, item: int, seen: list[np.ndarray]) -> tuple[float, float] | None:
        """The shares of the item's question and answer that a passage with the n-grams ``seen`` (of 1 to GRAM words) holds,
        if it holds enough of both."""
        share, sizes = [], []
        for m, part in (self.question[item], self.answer[item]):
            sizes.append(len(part))
            share.append(np.isin(part, seen[m - 1]).sum() / len(part) if m else -1.0)
        both = sum(max(0.0, x) * n for x, n in zip(share, sizes, strict=True)) / max(1, sum(sizes))
        return (share[0], max(0.0, share[1])) if both >= BOTH and all(x < 0 or x >= EACH for x in share) else None


def indexes(items: DataFrame, key: str = "item_id", question: str = "text", answer: str | None = None) -> Iterator[Index]:
    """An index for each shard of the benchmark; shards hold about SHARD_BYTES of text. Items of a null key are items; items
    that are alike in key and texts are one."""
    cols = [F.col(key).cast("long").alias("id"), F.col(question).cast("string").alias("q"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a")]
    rows = items.select(*cols).distinct()
    size = rows.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)) + 64)).first()[0] or 0
    shards = -(-size // SHARD_BYTES)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "q", "a"), F.lit(shards)) if shards else F.lit(0).cast("long"))
    sums, df = _whole(rows, answer is not None) if shards > 1 else (None, None)
    for s in range(shards):
        got = rows.where(F.col("shard") == s).orderBy("id").toArrow()
        whole = None
        if sums:
            d = df.where(F.col("shard") == s).orderBy("h").toArrow()
            hashes = d["h"].to_numpy().view(np.uint64)
            order = np.argsort(hashes)
            whole = Whole(*sums, hashes[order], d["df"].to_numpy()[order])
        yield Index(got["id"].to_pylist(), got["q"].to_pylist(), got["a"].to_pylist() if answer else None, whole)


def _whole(rows: DataFrame, answers: bool) -> tuple[tuple[int, int], DataFrame]:
    """Of all items (q, a, shard): how many pieces there are, and the words in all; and (shard, h, df), the pieces that each
    word of a shard occurs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, begins = item_tokens(b.column(0).to_pylist(), b.column(1).to_pylist() if answers else None)
            cut, item = pieces(begins)
            each = [np.unique(h[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
            flat = np.concatenate(each) if each else h
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(item)), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["shard", "size", "hs"])

    found = written(rows.select("q", "a", "shard").mapInArrow(run, "shard long, size long, hs array<bigint>"), "items")
    n, total = found.agg(F.count(F.lit(1)), F.sum("size")).first()
    df = found.select("shard", F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.collect_set("shard").alias("shards"))
    return (n, total or 0), written(df.select(F.explode("shards").alias("shard"), "h", "df"), "words")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **item) -> DataFrame:
    """``key``, item_id, score, question_overlap, answer_overlap: a row for each item that a row of ``docs`` holds.

    Whole texts are searched. Null and empty texts and items hold, and are in, nothing. Repeated rows are each reported;
    items that are alike in key and texts are one, those of a null key have a null item_id. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    shape = f"key {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], shape)
    for one in indexes(items, **item):
        held = spark.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi in text_slices(b.column(1)):
                    if got := held.value.hits(b.column(1).slice(lo, hi - lo)):
                        rows, ids, *more = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + r for r in rows])), pa.array(ids, pa.int64()), *(pa.array(m, pa.float64()) for m in more)], ["key", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(frugal(run), shape)
        out = out.union(found)
    return out.withColumnRenamed("key", key)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score and overlaps of all documents that hold an item of benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@stage
def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no item of benchmark, with their columns.

    Each row is judged by its whole text, whatever its doc_id: null and empty texts hold nothing and stay, as do all rows
    where the benchmark is empty. No rows: none.
    """
    ship(spark)
    out = docs
    for one in indexes(table(spark, sf_dir, "benchmark")):
        held = spark.sparkContext.broadcast(one)
        at = out.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], held=held, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi in text_slices(b.column(at)):
                    keep = np.ones(hi - lo, bool)
                    keep[[r for r, *_ in held.value.hits(b.column(at).slice(lo, hi - lo))]] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(keep))

        out = out.mapInArrow(frugal(run), out.schema)
    return out
