"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A window is ``WINDOW`` consecutive words of one text. Its hash is a polynomial in the words' hashes, taken for all windows
of a slice from prefix sums (the rolling hash, vectorised); a second polynomial deals the windows into buckets of about
``BUCKET_WINDOWS``, whose number grows with the corpus. A slice of texts sends each of its window hashes once, the
first occurrence; later ones are known repeats already. A task also keeps (a bounded number of) the windows that it has
met in a slice twice or in two slices running, each with an occurrence that it has sent, and sends no later one: a window
that a third of all texts hold reaches its bucket a few times a task. A bucket sorts its hashes and marks all occurrences but the first (smallest key, then earliest start).
The marks meet their texts by a join on the key and the row; a bounded bitmap of the marked rows lets all other texts be
finished where they are read, so only texts that lose words are shuffled. Marked windows merge into maximal removal intervals.

Two windows count as equal if 64 bits of one hash and the bucket by the other agree. With n windows that is wrong for
an expected n * n / 2 ** 65 / buckets pairs: about 0.00001 in a gigabyte of input, and in proportion to it, as the buckets
grow with n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import frugal, mix, ship, stage, table, text_slices, unique, utf8, word_hashes, words, written
from .near_dup import _bitmap

WINDOW, BUCKET_WINDOWS, SLICE, FREQUENT = 20, 1 << 20, 2 << 20, 1 << 19

#: Odd bases of the two rolling hashes, and their inverses modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def rolling(h: np.ndarray, at: np.ndarray, window: int, base: int) -> np.ndarray:
    """The hashes of the windows that start at the words ``at``."""
    up, down = _powers(base, max(16, int(len(h)).bit_length()))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[at + window] - sums[at]) * down[at])


def _window_starts(begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window, and its text."""
    n = np.maximum(np.diff(begins) - window + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) - first[doc] + begins[:-1][doc], doc


def _packed(key: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """One row for each run of equal ``key`` (sorted), each column's bytes of the run as one binary value."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cut, len(key)).astype(np.int64)
    out = []
    for c in cols:
        c = np.ascontiguousarray(c)
        width = c.nbytes // max(1, len(c))
        out.append(pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(c)]))
    return key[cut] if len(key) else key, out


def joined(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(t[name].to_pylist()), kind)


class Frequent:
    """The windows that a task meets again and again: hash, bucket, and an occurrence that went to the bucket. At most
    FREQUENT are kept; those forgotten are only sent once more."""

    def __init__(self):
        self.known = [np.zeros(0, t) for t in (np.uint64, np.int32, np.int64, np.uint32)]
        self.last = self.known[:2]

    def later(self, h: np.ndarray, bucket: np.ndarray, ids: np.ndarray, pos: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Which windows of a slice (sorted by h; ``same``: those known to repeat the one before) start later than an
        occurrence that was sent; the slice's own are learned."""
        out = np.zeros(len(h), bool)
        old_h, old_bucket, old_ids, old_pos = self.known
        if len(old_h):
            at = np.minimum(np.searchsorted(old_h, h), len(old_h) - 1)
            hit = np.flatnonzero((old_h[at] == h) & (old_bucket[at] == bucket))
            at = at[hit]
            out[hit] = (ids[hit] > old_ids[at]) | (ids[hit] == old_ids[at]) & (pos[hit] > old_pos[at])
        last_h, last_bucket = self.last
        learn = np.zeros(len(h), bool)
        if len(last_h):
            at = np.minimum(np.searchsorted(last_h, h), len(last_h) - 1)
            learn = (last_h[at] == h) & (last_bucket[at] == bucket)
        learn[:-1] |= same[1:]
        learn &= ~same & ~out
        new = [x[learn] for x in (h, bucket, ids, pos)]
        if len(new[0]):
            if len(old_h) + len(new[0]) > FREQUENT:
                new = [x[:FREQUENT] for x in new]
            else:
                new = [np.concatenate(x) for x in zip(self.known, new, strict=True)]
            _, first = np.unique(new[0], return_index=True)
            self.known = [x[first] for x in new]
        self.last = [h, bucket]
        return out


def marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, row, starts): the starts (uint32 each, sorted) of the windows of ``docs`` (id, row, text) that repeat an earlier
    one, a row for each (id, row) that has any. ``row`` tells rows of one id apart; which windows repeat does not depend
    on it. What a bucket marks goes to one of ``buckets / 8`` groups of rows as one row."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, size // 6 // BUCKET_WINDOWS)
    groups = max(8, buckets // 8)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent()
        for b in batches:
            for lo, hi in text_slices(b.column(2), SLICE):
                part = b.slice(lo, hi - lo)
                order = np.argsort(part.column(0).to_numpy(), kind="stable")
                part = part.take(pa.array(order))
                ids, row = part.column(0).to_numpy(), part.column(1).to_numpy()
                buf, off = utf8(part.column(2))
                starts, ends, begins = words(buf, off)
                h = word_hashes(buf, starts, ends, seed=1)
                del buf
                at, doc = _window_starts(begins, window)
                if not len(at):
                    continue
                h1 = rolling(h, at, window, BASES[0])
                bucket = (rolling(h, at, window, BASES[1]) % np.uint64(buckets)).astype(np.int32)
                pos = (at - begins[:-1][doc]).astype(np.uint32)
                by = np.argsort(h1, kind="stable")
                same = np.zeros(len(by), bool)
                s1, s2 = h1[by], bucket[by]
                same[1:] = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
                if (ids[1:] == ids[:-1]).any():  # rows that share a key: leave ties to the bucket
                    same[:] = False
                again = np.zeros(len(by), bool)
                again[by[same | frequent.later(s1, s2, ids[doc[by]], pos[by], same)]] = True
                new = np.flatnonzero(~again)
                new = new[np.argsort(bucket[new], kind="stable")]
                key, (a, i, r, p) = _packed(bucket[new], h1[new], ids[doc[new]], row[doc[new]], pos[new])
                yield pa.RecordBatch.from_arrays([pa.array(key), a, i, r, p], ["bucket", "h", "i", "r", "p"])
                old = np.flatnonzero(again)
                if len(old):
                    key, (i, r, p) = _packed(np.full(len(old), -1 - int(ids[0] % buckets), np.int32), ids[doc[old]], row[doc[old]], pos[old])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([b""] * len(key), pa.binary()), i, r, p], ["bucket", "h", "i", "r", "p"])

    def judged(group: pa.Table) -> pa.Table:
        ids, row, pos = joined(group, "i", np.int64), joined(group, "r", np.int64), joined(group, "p", np.uint32)
        if group["bucket"][0].as_py() >= 0:
            h = joined(group, "h", np.uint64)
            by = np.argsort(h)
            s = h[by]
            eq = s[1:] == s[:-1]
            many = np.zeros(len(s), bool)
            many[1:] |= eq
            many[:-1] |= eq
            sub = by[many]  # only windows that occur twice
            sub = sub[np.lexsort((pos[sub], ids[sub], h[sub]))]
            h, ids, row, pos = h[sub], ids[sub], row[sub], pos[sub]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            late = (ids != ids[lead]) | (pos != pos[lead])
            ids, row, pos = ids[late], row[late], pos[late]
        grp = (mix((ids ^ row).view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(grp, kind="stable")
        key, (i, r, p) = _packed(grp[order], ids[order], row[order], pos[order])
        return pa.table({"grp": key, "i": i, "r": r, "p": p})

    def gathered(group: pa.Table) -> pa.Table:
        ids, row, pos = joined(group, "i", np.int64), joined(group, "r", np.int64), joined(group, "p", np.uint32)
        order = np.lexsort((pos, row, ids))
        ids, row = ids[order], row[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
        _, (p,) = _packed(np.cumsum(new), pos[order])
        return pa.table({"id": ids[new], "row": row[new], "starts": p})

    found = docs.select("id", "row", "text").mapInArrow(frugal(hashed), "bucket int, h binary, i binary, r binary, p binary")
    found = found.groupBy("bucket").applyInArrow(judged, "grp int, i binary, r binary, p binary")
    return found.groupBy("grp").applyInArrow(gathered, "id long, row long, starts binary")


def intervals(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Maximal removal intervals [from, to) of words, from the starts of marked windows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    s = np.unique(starts.astype(np.int64))
    cut = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + window]))
    return np.stack([s[cut], np.minimum(np.append(s[cut[1:] - 1], s[-1]) + window, n)], 1)


#: Stands for a null key, which counts as later than every other.
LAST = (1 << 63) - 1


def _marked(docs: DataFrame, window: int, key: str, text: str):
    """The id and the row of each row of ``docs`` and its place in a bitmap of marked rows (Columns), the marks, the bitmap.

    Rows of one id are told apart by a hash of their texts, which is the same however often and wherever a row is read
    (a running number is so only for some plans); rows that have both in common have the same marks. Where no id occurs
    twice there is nothing to tell apart: the row is 0, which costs the shuffles nothing.
    """
    spark = docs.sparkSession
    at = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    row = F.lit(0).cast("long") if unique(docs, at) else F.xxhash64(text)
    found = written(marks(docs.select(at.alias("id"), row.alias("row"), F.col(text).alias("text")), window), "marks")
    bitmap, bits = _bitmap(found.select(F.xxhash64("id", "row").alias("id")))
    place = F.pmod(F.xxhash64(F.xxhash64(at, row)), F.lit(bits))
    return at, row, place, found, spark.sparkContext.broadcast(bitmap)


def _hit(held: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (held[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def _left(arr: pa.Array, starts: list[bytes | None], window: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """What the marked windows leave of each text, its words joined by one space, all in one buffer; where each begins (and
    the last ends), how many words each had and lost, and the intervals that went."""
    buf, off = utf8(arr)
    first, end, begins = words(buf, off)
    n, cuts = np.diff(begins), [np.zeros((0, 2), np.int64)] * len(starts)
    keep = np.ones(len(first), bool)
    for i, marked in enumerate(starts):
        if marked:
            cuts[i] = intervals(np.frombuffer(marked, np.uint32), int(n[i]), window)
            for a, b in cuts[i].tolist():
                keep[begins[i] + a : begins[i] + b] = False
    k = np.flatnonzero(keep)
    owner = np.searchsorted(begins, k, "right") - 1
    gap = np.zeros(len(k), np.int64)  # a space follows each word that is not the last of its text
    gap[:-1] = owner[1:] == owner[:-1]
    first, end = first[k], end[k]
    buf[end[gap == 1]] = 32
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[first] += 1
    edge[end + gap] -= 1
    out = buf[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)].tobytes()
    sizes = np.bincount(owner, weights=end - first + gap, minlength=len(starts)).astype(np.int64)
    lost = n - np.bincount(owner, minlength=len(starts))
    return out, np.concatenate([[0], np.cumsum(sizes)]), n, lost, cuts


def _digests(ids: pa.Array, texts: pa.Array, starts: list[bytes | None], window: int) -> Iterator[tuple]:
    """id, n_words, n_removed, kept_sha256, removed of each text."""
    out, at, n, lost, cuts = _left(texts, starts, window)
    out = memoryview(out)
    for k, i in enumerate(ids.to_pylist()):
        yield i, int(n[k]), int(lost[k]), hashlib.sha256(out[at[k] : at[k + 1]]).hexdigest(), cuts[k].tolist()


def dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, n_removed, kept_sha256, removed (array of [from, to) word intervals) of every row.

    Words are removed that a window covers whose word sequence starts earlier: at a smaller key, or earlier in the same
    text. Windows are judged on the input. Null and empty texts have no words. Rows that share a key (the null key too)
    are each judged against all others, and lose their own words only; an equal start in both is no repeat. A null key
    is later than all keys. Texts shorter than a window have none, and lose nothing. Other columns are not read.
    """
    at, row, place, marked, held = _marked(docs, window, key, text)
    names = ["id", "row", "text", "n", "sha"]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes texts without a mark; passes on the others."""
        for b in batches:
            hit = _hit(held.value, b.column(3).to_numpy())
            for mask, done in ((~hit, True), (hit, False)):
                part = b.filter(pa.array(mask))
                for lo, hi in text_slices(part.column(2), SLICE):
                    x = part.slice(lo, hi - lo)
                    if done:
                        _, n, _, sha, _ = zip(*_digests(x.column(0), x.column(2), [None] * len(x), window), strict=True)
                        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.nulls(len(x), pa.string()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names)
                    else:
                        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2).cast(pa.string()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.string())], names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.list_(pa.int32())))])
        for b in batches:
            for lo, hi in text_slices(b.column(1), SLICE):
                x = b.slice(lo, hi - lo)
                todo = x.column(2).is_null().to_numpy(zero_copy_only=False)
                part, rest = x.filter(pa.array(todo)), x.filter(pa.array(~todo))
                rows = list(_digests(part.column(0), part.column(1), part.column(4).to_pylist(), window)) if len(part) else []
                rows += [(i, n, 0, sha, []) for i, n, sha in zip(*(rest.column(k).to_pylist() for k in (0, 2, 3)), strict=True)]
                cols = zip(*rows, strict=True) if rows else [[]] * len(kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

    passed = docs.select(at.alias("id"), row.alias("row"), F.col(text).alias("text"), place.alias("p")).mapInArrow(frugal(clean), "id long, row long, text string, n long, sha string")
    out = passed.join(marked, ["id", "row"], "left").select("id", "text", "n", "sha", "starts").mapInArrow(frugal(finish), "id long, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>")
    return out.withColumn("id", F.when(F.col("id") != LAST, F.col("id"))).withColumnRenamed("id", key)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed of all documents."""
    return dedup(table(spark, sf_dir, "documents"))


@stage
def substring_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its text without the repeated words (joined by one space where any went).

    Rows in are rows out: null and empty texts stay as they are, rows that share a doc_id (the null one too) each lose
    their own repeats, and a text of which nothing is left is empty. A column n_chars is counted anew for texts that lost
    words. No rows: none.
    """
    at, row, place, marked, held = _marked(docs, WINDOW, "doc_id", "text")
    cols, text = docs.columns, docs.columns.index("text")
    chars = cols.index("n_chars") if "n_chars" in cols else None

    def part(hits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = _hit(held.value, b.column(b.num_columns - 1).to_numpy())
                x = b.filter(pa.array(hit if hits else ~hit))
                yield x.select(range(b.num_columns - 1))

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_slices(b.column(text), SLICE):
                x = b.slice(lo, hi - lo)
                texts, arrays = x.column(text).to_pylist(), x.columns[:-1]
                sizes = x.column(chars).to_pylist() if chars is not None else []
                marked = x.column(len(cols)).to_pylist()
                left, begin, *_ = _left(x.column(text), marked, WINDOW)
                for k, starts in enumerate(marked):
                    if starts:
                        texts[k] = left[begin[k] : begin[k + 1]].decode("utf-8", "surrogatepass")
                        if chars is not None:
                            sizes[k] = len(texts[k])
                arrays[text] = pa.array(texts, x.column(text).type)
                if chars is not None:
                    arrays[chars] = pa.array(sizes, x.column(chars).type)
                yield pa.RecordBatch.from_arrays(arrays, cols)

    tagged = docs.select(*cols, at.alias("_id"), row.alias("_row"), place.alias("_place"))
    rest = tagged.select(*cols, "_place").mapInArrow(frugal(part(False)), docs.schema)
    kind = StructType([*docs.schema.fields, StructField("_id", LongType()), StructField("_row", LongType())])
    found = marked.select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("starts").alias("_starts"))
    lost = tagged.mapInArrow(frugal(part(True)), kind).join(found, ["_id", "_row"], "left").select(*cols, "_starts").mapInArrow(frugal(cut), docs.schema)
    return rest.union(lost)
