"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A text's set is its distinct runs of ``SHINGLE`` lower-cased words. Its signature has ``CHUNKS * WIDTH`` slots of b = 16
bits. Split into chunks, two signatures that differ in at most ``2 * CHUNKS - 1`` slots have a chunk with at most one
differing slot (pigeonhole), so each signature is indexed under every chunk with every one of its slots left out: all
pairs within that distance share a key. At similarity 0.85 a pair is within it, or shares a key anyway, but for a
chance of 3e-6 (0.165 ** 7).

Texts of equal sets become one class first, so copies never pair. Within a key, members pair with one member only, the
one that shares keys with the most others; pairs are confirmed by exact intersection, and confirmed links are contracted
to components. Keys whose members are still in several components get another centre, and at last all their pairs of
different components are weighed: a parity sketch of each set (a bit for each residue of its hashes, flipped by every
element) bounds the symmetric difference from below, so pairs that cannot be links are passed over exactly, and each
other pair is emitted once, at its first shared key. Members of crowded keys, such as those of a text that very many
documents frame differently, are not paired by the key: two linked sets share one of their rarest shingles (the prefix
that the similarity asks for), so only members that share such a shingle meet, and what all of them share pairs nobody.
No link is lost, and a large group of copies emits few pairs. Joins are plain equi-joins, which adaptive execution
splits where a key is hot; nothing but counts and one bounded bitmap comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import M1, frugal, grams, mix, numbered, ship, stage, table, text_slices, unique, utf8, word_hashes, words, written

SHINGLE, CHUNKS, WIDTH, STARS, CROWD, PLACES = 5, 7, 5, 2, 64, 1 << 18
SLOTS = CHUNKS * WIDTH
MAX_BITMAP_BITS = 1 << 26
_rng = np.random.default_rng(2024)
_MUL = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)


def shingle_sets(arr: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, text after text, and how many each has.

    Fewer than ``size`` words: the whole sequence is the one shingle; no words: none.
    """
    buf, off = utf8(arr, lower=True)
    starts, ends, begins = words(buf, off)
    h = word_hashes(buf, starts, ends, seed=5)
    g, at = grams(h, begins, size)
    cuts = np.searchsorted(at, begins)
    count = np.diff(begins)
    parts: list[np.ndarray] = []
    short: dict[int, np.ndarray] = {}
    for n in range(1, size):
        if (count == n).any():
            gn, an = grams(h, begins, n)
            for i in np.flatnonzero(count == n):
                short[int(i)] = gn[np.searchsorted(an, begins[i])][None]
    for i in range(len(off) - 1):
        parts.append(short[i] if i in short else np.unique(g[cuts[i] : cuts[i + 1]]))
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def signatures(s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit slots (texts x SLOTS) and a 128-bit digest of each set (two words); zero for empty sets."""
    has = np.flatnonzero(sizes)
    sig, d1, d2 = np.zeros((len(sizes), SLOTS), np.int16), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if len(has):
        begins = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
        d1[has] = np.add.reduceat(s * M1, begins).view(np.int64)
        d2[has] = np.add.reduceat(mix(s), begins).view(np.int64)
        for k in range(SLOTS):
            x = (s ^ _XOR[k]) * _MUL[k]
            low = np.minimum.reduceat(x, begins)
            sig[has, k] = (mix(low) >> np.uint64(48)).astype(np.uint16).view(np.int16)
    return sig, d1, d2


def sketches(s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches (64-bit words, text after text) and how many words each has: 64 bits for up to 16 shingles,
    doubled as often as needed for 4 bits a shingle. Halves of a sketch combine by exclusive or to one of half the size."""
    count = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 16)).astype(np.int64).clip(0))
    begins = np.cumsum(count) - count
    bits = (s * M1) >> np.uint64(16) & np.uint64((1 << 40) - 1)
    bit = bits & (np.repeat(count, sizes).astype(np.uint64) * np.uint64(64) - np.uint64(1))
    out = np.zeros(count.sum(), np.uint64)
    word = np.repeat(begins, sizes) + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (bit & np.uint64(63)))
    return out, count


def _signed(docs: DataFrame) -> DataFrame:
    """id, n, d1, d2, sig of every row of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_slices(b.column(1)):
                s, sizes = shingle_sets(b.column(1).slice(lo, hi - lo))
                sig, d1, d2 = signatures(s, sizes)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, SLOTS, dtype=np.int32)), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(d1), pa.array(d2), flat], ["id", "n", "d1", "d2", "sig"])

    return docs.mapInArrow(frugal(run), "id long, n long, d1 long, d2 long, sig array<smallint>")


def _bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids: 16 bits an id up to MAX_BITMAP_BITS, beyond which it only lets more rows pass."""
    n = ids.count()
    bits = 1 << 12
    while bits < min(16 * n, MAX_BITMAP_BITS):
        bits <<= 1
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    got = ids.select(at.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("p"), F.lit(32)).cast("int"))).alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out, bits


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, s (array of shingle hashes), sketch of the rows of ``docs`` (id, text) that a bitmap of ``ids`` lets pass."""
    bitmap, bits = _bitmap(ids)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).to_numpy()
            b = b.filter(pa.array((held.value[p >> 5] >> (p & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))
            for lo, hi in text_slices(b.column(1)):
                s, sizes = shingle_sets(b.column(1).slice(lo, hi - lo))
                lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sizes), lists(s, sizes), lists(*sketches(s, sizes))], ["id", "n", "s", "sketch"])

    return docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p")).mapInArrow(frugal(run), "id long, n long, s array<bigint>, sketch array<bigint>")


def components(links: DataFrame, rows: int) -> DataFrame:
    """(id, label) of every id of ``links`` (a, b; at most ``rows``): the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour, and contracts the graph; at least half of the vertices
    that still have an edge go. Every round is written, so a lost executor costs one round.
    """
    g = written(links.select("a", "b").where("a <> b").distinct(), "links", rows)
    labels = written(g.select(F.col("a").alias("id")).union(g.select("b")).distinct().withColumn("label", F.col("id")), "labels", 2 * rows)
    while not g.isEmpty():
        both = g.select("a", "b").union(g.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("label"), F.least("a", "p").alias("p"))
        over = up.select(F.col("label").alias("p"), F.col("p").alias("pp"))
        up = written(up.join(over, "p", "left").select("label", F.coalesce("pp", "p").alias("p")), "parents", 2 * rows)
        labels = written(labels.join(up, "label", "left").select("id", F.coalesce("p", "label").alias("label")), "labels", 2 * rows)
        ends = g.join(up.select(F.col("label").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("label").alias("b"), F.col("p").alias("pb")), "b")
        g = written(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links", rows)
    return labels


def _keys(rows: DataFrame) -> DataFrame:
    """The index: a row (key, at, id, n) for each chunk of each signature with each one of its slots left out; ``at``
    is the number of the slot."""
    keys = []
    for c in range(CHUNKS):
        for w in range(WIDTH):
            slots = [F.get("sig", F.lit(c * WIDTH + k)) for k in range(WIDTH) if k != w]
            keys.append(F.xxhash64(F.lit(c * WIDTH + w), *slots))
    return rows.select(F.posexplode(F.array(*keys)).alias("at", "key"), "id", "n")


def _alike(n1, n2, num: int, den: int):
    """Set sizes that still allow the similarity."""
    return F.least(n1, n2) * den >= F.greatest(n1, n2) * num


def classes(docs: DataFrame, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id of every row of ``docs``, whole texts.

    Links: den * intersection >= num * union of the sets. component_id: the smallest key reachable, itself included.
    Rows without words or text, and rows of a null key, are linked with nothing (a null key's component is null). Rows
    that share a key are documents of their own, each judged by its text. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    if unique(rows.where("id is not null"), "id"):
        out = _linked(rows, num, den)
    else:  # link by the number of the row, and name each component by its smallest key
        rows = numbered(rows, "row")
        known, rest = _by_number(rows, num, den)
        least = known.groupBy("component").agg(F.min("key").alias("least"))
        out = known.join(least, "component").select(F.col("key").alias("id"), "n", F.col("least").alias("component_id")).union(rest)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _by_number(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of numbered rows (row, id, text): (row, key, n, component) of those with a key, the component being the smallest
    row; and (id, n, component_id) of those without."""
    got = _linked(rows.select(F.when(F.col("id").isNotNull(), F.col("row")).alias("id"), "text"), num, den)
    keys = rows.select("row", F.col("id").alias("key"))
    known = got.where("id is not null").select(F.col("id").alias("row"), "n", F.col("component_id").alias("component")).join(keys, "row")
    return known, got.where("id is null")


def _linked(docs: DataFrame, num: int, den: int) -> DataFrame:
    """id, n, component_id of ``docs`` (id, text), of which no two rows share an id that is not null."""
    signed = written(_signed(docs), "signed")
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    some = signed.where("n > 0 and id is not null")
    reps = some.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    member = written(some.join(reps, ["d1", "d2", "n"]).select("id", "rep", "n", F.when(F.col("id") == F.col("rep"), F.col("sig")).alias("sig")), "members")
    index = _keys(member.where("id = rep").select("id", "n", "sig"))
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    index = written(index.join(shared, "key"), "index")
    sets = written(_sets(docs, index.select("id").distinct()), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links, by their full sets."""
        got = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
        got = got.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        return got.where(both * den >= (F.col("na") + F.col("nb") - both) * num).select("a", "b")

    links, label, total, keyed = None, None, 0, index.count()
    for turn in range(STARS + 1):
        if label is None:
            weight = index.groupBy("id").agg(F.sum("m").alias("w"))
            rows = (index if turn else index.join(weight, "id")).withColumn("label", F.col("id"))
        else:  # keys whose members are in several components
            rows = index.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
            mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
            rows = rows.join(mixed, "key")
        if turn < STARS:
            rank = F.xxhash64(F.lit(turn), "id") if turn else -F.col("w")
            centre = rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), F.col("id").alias("c"), F.col("n").alias("nc"), F.col("label").alias("lc"))).alias("m")).select("key", "m.c", "m.nc", "m.lc")
            pairs = rows.join(centre, "key").where((F.col("label") != F.col("lc")) & _alike(F.col("n"), F.col("nc"), num, den)).select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))
        else:
            features = member.where("id = rep").select("id", "sig").join(sets.select("id", "sketch"), "id")
            rows = written(rows.select("key", "at", "id", "n", "m", "label"), "mixed", keyed)
            pairs = _rest(rows.where(F.col("m") <= CROWD).join(features, "id"), num, den)
            crowd = rows.where(F.col("m") > CROWD).select("id", "n", "label").distinct()
            pairs = pairs.union(_crowded(crowd.join(sets.select("id", "s", "sketch"), "id"), num, den))
        pairs = written(pairs.distinct(), "pairs", keyed)
        found = pairs.count()
        if not found:  # of this turn's centres; another turn may have some
            continue
        new, total = confirmed(pairs), total + found
        links = written(new if links is None else links.union(new), "confirmed", 32 * total)
        label = components(links, total)
    if label is not None:
        member = member.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
    else:
        member = member.withColumn("component_id", F.col("rep"))
    return member.select("id", "n", "component_id").union(alone)


def _rest(rows: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of one key in different components that their sketches allow to be links, each at its first shared key."""
    a, b = (rows.select("key", "at", *(F.col(c).alias(c + x) for c in ("id", "n", "sig", "sketch", "label"))) for x in ("1", "2"))
    off = [(F.get("sig1", F.lit(k)) != F.get("sig2", F.lit(k))).cast("int") for k in range(SLOTS)]
    chunk = [reduce(lambda x, y: x + y, off[c * WIDTH : (c + 1) * WIDTH]) for c in range(CHUNKS)]
    first = F.lit(False)  # whether the key's chunk is the first that the pair shares, and its slot the one that differs, or the first
    for c in reversed(range(CHUNKS)):
        here = (a["at"] >= c * WIDTH) & (a["at"] < (c + 1) * WIDTH) & ((chunk[c] == 1) | (a["at"] == c * WIDTH))
        first = F.when(chunk[c] <= 1, here).otherwise(first)
    near = (F.col("id1") < F.col("id2")) & (F.col("label1") != F.col("label2")) & _alike(F.col("n1"), F.col("n2"), num, den) & first
    b = b.withColumnRenamed("at", "at2")
    return a.join(b, (a["key"] == b["key"]) & near & _allowed(num, den)).select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def _allowed(num: int, den: int) -> Column:
    """Whether sketch1 and sketch2 allow their sets, of n1 and n2 shingles, to be linked: |A xor B| is at most
    (den - num) / (den + num) * (|A| + |B|) for a link, and the sketches' difference is no larger than it."""
    words = F.least(F.size("sketch1"), F.size("sketch2"))
    fold = lambda s: F.when(F.size(s) == words, F.col(s)).otherwise(F.zip_with(F.slice(s, F.lit(1), words), F.slice(s, words + 1, words), lambda x, y: x.bitwiseXOR(y)))
    apart = F.aggregate(F.zip_with(fold("sketch1"), fold("sketch2"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return apart.cast("long") * (den + num) <= (F.col("n1") + F.col("n2")) * (den - num)


def _crowded(rows: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of ``rows`` (id, n, label, s, sketch) in different components that share one of their rarest shingles, and
    that sizes and sketches allow to be links.

    Two sets with den * intersection >= num * union share one of the n - ceil(num * n / den) + 1 shingles of each that
    come first in one common order, whichever that is. Here it is by how many of the rows hold a shingle, counted in a
    table of ``PLACES`` by its hash, so that what all of them share comes last. The table is all that is gathered.
    """
    rows = written(rows.select("id", "n", "label", "sketch", "s"), "crowd")
    place = lambda x: (x & np.int64(PLACES - 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for b in batches:
            total += np.bincount(place(b.column(0).flatten().to_numpy()), minlength=PLACES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["p", "f"])

    got = rows.select("s").mapInArrow(frugal(count), "p long, f long").groupBy("p").agg(F.sum("f").alias("f")).toArrow()
    table = np.zeros(PLACES, np.int64)
    table[got["p"].to_numpy()] = got["f"].to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = b.column(4)
            sizes = pc.list_value_length(sets).to_numpy()
            x, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(b)), sizes)
            often = held.value[place(x)]
            order = np.lexsort((x, often, owner))
            begins = np.cumsum(sizes) - sizes
            nth = np.arange(len(x)) - begins[owner]
            length = sizes - -(-sizes.astype(np.int64) * num // den) + 1
            keep = order[(nth < length[owner]) & (often[order] > 1)]  # one that a single row holds pairs nothing
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), *(b.column(k).take(pa.array(owner[keep])) for k in range(4))], ["x", "id", "n", "label", "sketch"])

    prefix = rows.select("id", "n", "label", "sketch", "s").mapInArrow(frugal(first), "x long, id long, n long, label long, sketch array<bigint>")
    a, b = (prefix.select("x", *(F.col(c).alias(c + k) for c in ("id", "n", "sketch", "label"))) for k in ("1", "2"))
    near = (F.col("id1") < F.col("id2")) & (F.col("label1") != F.col("label2")) & _alike(F.col("n1"), F.col("n2"), num, den)
    return a.join(b, (a["x"] == b["x"]) & near & _allowed(num, den)).select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of all documents; a row of null doc_id is kept."""
    got = classes(table(spark, sf_dir, "documents"))
    return got.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@stage
def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (similarity 0.8 or more) the smallest doc_id stays.

    Rows that share a doc_id are documents of their own: of those in one group one stays. Null and empty texts, and rows of
    a null doc_id, are in no group and stay. No rows: none.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    if unique(ids.where("id is not null"), "id"):
        gone = _linked(ids, 80, 100).where("id <> component_id").select(F.col("id").alias("_gone"))
        return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(*docs.columns)
    rows = numbered(docs, "_number")
    known, _ = _by_number(rows.select(F.col("_number").alias("row"), F.col("doc_id").cast("long").alias("id"), "text"), 80, 100)
    first = known.groupBy("component").agg(F.min(F.struct("key", "row")).alias("m")).select(F.col("m.row").alias("_number"))
    return rows.where("doc_id is null").union(rows.where("doc_id is not null").join(first, "_number", "left_semi").select(*rows.columns)).select(*docs.columns)
