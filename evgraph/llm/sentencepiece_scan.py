"""SentencePiece encoding and decoding: the best segmentation by piece scores, as a max-plus parallel scan.

A text is a chain of positions; a piece of n characters is an arc of that length with its score as weight, and the best
path is the encoding (the unigram rule; characters that no piece holds are written as bytes). A giant text is split into
chunks of ``CHUNK`` characters. A state at a chunk's border is how far before it the last cut lies, so a chunk is a
transfer matrix over max and plus: the best score from every state at its start to every state at its end. All chunks'
matrices are made side by side, a character a step; they are combined associatively, by doubling, into the best scores of
every border's states. From those each chunk finds by itself, for every cut, the last piece of the best path to it, and by
that, for every state at its end, the state at its start: maps that are composed from the end backwards. Then every chunk
is traced back by itself.

Of several best paths one rule picks one, wherever the text is cut: every cut's last piece is the shortest that allows the
best score. The best scores of a border's states are those that a search from left to right has there, so chunks of any
size, and texts of any length, have the same ids.

No piece of the vocabulary reaches over a character followed by a space, so ordinary texts are cut there without loss, and
each distinct short segment is searched once by a worker (a bounded cache); longer segments, of any length, go to the
scan. Scores are whole numbers summed in double precision, so the optimum does not depend on where a text was cut. The
chunks of texts over ``GIANT`` characters are rows that Spark deals out; nothing but matrices is gathered by text.

The vocabulary file at hand was made for pair merging; its scores are the ranks of merges. Read as a unigram model the
encoding is a best path and decodes exactly, but parts words in other pieces than merging would: these are not the ids
that the library's encode gives for this file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import M1, fresh, frugal, numbered, ship, stage, table, text_slices, written

CHUNK, STRIDES, GIANT, SHORT, CACHE, LEARN = 512, 4, 1 << 16, 128, 300_000, 1 << 17
SLOT_BITS = 20
SPACE = "▁"
NEVER = -1e18
#: A cut that no piece can reach over: before a space that follows another character.
CUT = re.compile(r"(?<=[^ ]) ")


def vocabulary_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The pieces and scores of a vocabulary file, for both searches."""

    def __init__(self, path: str):
        import sentencepiece

        raw = open(path, "rb").read()
        lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in plain):
            raise ValueError("a piece of this vocabulary reaches over a space")
        self.score = {self.pieces[i]: float(lib.get_score(i)) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10.0
        self.low = np.array([self.byte[b] for b in range(128)])
        self.cache = Cache(self)
        self.text = [b""] * n
        for i in plain:
            self.text[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        # arcs are looked up by a hash of their characters: tables of slots, each piece in the first that has its slot free
        self.names = list(self.score)
        self.hashes = np.array([_hash(p) for p in self.names], np.uint64)
        if len(np.unique(self.hashes)) < len(self.names):
            raise ValueError("pieces collide")
        self.weights = np.array([self.score[p] for p in self.names])
        self.numbers = np.array([self.id[p] for p in self.names], np.int32)
        self.slots, left = [], np.arange(len(self.names))
        while len(left):
            slot = np.full(1 << SLOT_BITS, -1, np.int32)
            at = self._slot(self.hashes[left], len(self.slots))
            slot[at] = left
            self.slots.append(slot)
            left = left[slot[at] != left]

    @staticmethod
    def _slot(h: np.ndarray, nth: int) -> np.ndarray:
        return ((h * np.uint64(2 * nth + 1) ^ h >> np.uint64(23)) * M1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        for nth, slot in enumerate(self.slots):
            got = slot[self._slot(h, nth)]
            ok = (got >= 0) & (self.hashes[got] == h)
            out[ok] = got[ok]
        return out

    def arcs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every position and length: score and id of the piece that ends just before it; NEVER where none does.

        Row i is for the cut after i characters, column k for pieces of k + 1. A character that no piece holds is an arc
        of the unknown score, id -1.
        """
        n = len(codes)
        score, ids = np.full((n + 1, self.longest), NEVER), np.full((n + 1, self.longest), -1, np.int32)
        acc = np.zeros(n, np.uint64)
        for size in range(1, min(self.longest, n) + 1):
            acc = acc[: n - size + 1] * _BASE + codes[size - 1 :].astype(np.uint64) + np.uint64(1)
            got = self.lookup(acc)
            hit = np.flatnonzero(got >= 0)
            score[size + hit, size - 1] = self.weights[got[hit]]
            ids[size + hit, size - 1] = self.numbers[got[hit]]
        score[1:, 0][score[1:, 0] == NEVER] = self.unknown
        return score, ids


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
    return h


@cache
def model(path: str) -> Model:
    return Model(path)


# --- the scan -------------------------------------------------------------------------------------------------------
# State s at a border: the last cut lies s characters before it, 0 <= s < longest. Matrices: [from state, to state].


def transfers(m: Model, score: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Matrices of chunks of one text with the arcs ``score``, made side by side: the step over one character is the same
    for all."""
    w, c = m.longest, len(begins)
    # last[c, s, k]: best score from start state s to a cut k characters back
    last = np.full((c, w, w), NEVER)
    last[:, np.arange(w), np.arange(w)] = 0.0
    for step in range(1, int(sizes.max()) + 1):
        live = np.flatnonzero(sizes >= step)
        arc = score[begins[live] + step]  # [chunk, length - 1]
        best = (last[live] + arc[:, None, :]).max(2)
        last[live] = np.concatenate([best[:, :, None], last[live][:, :, :-1]], 2)
    return last


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus products of two stacks of matrices; associative."""
    return np.maximum((a[:, :, :, None] + b[:, None, :, :]).max(2), NEVER)


def prefixes(mats: np.ndarray) -> np.ndarray:
    """All prefix products, by doubling: log2(n) rounds, each over all chunks at once."""
    out, gap = mats.copy(), 1
    while gap < len(out):
        nxt = out.copy()
        for lo in range(gap, len(out), 256):
            hi = min(len(out), lo + 256)
            nxt[lo:hi] = combine(out[lo - gap : hi - gap], out[lo:hi])
        out, gap = nxt, gap * 2
    return out


def forward(m: Model, score: np.ndarray, enter: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The length of the last piece of the best path to every cut of each chunk (chunks x (most sizes + 1)), the shortest of
    equals; ``enter``: the best scores of the states at each chunk's start."""
    last, took = enter.copy(), np.zeros((len(begins), int(sizes.max()) + 1), np.int8)
    for step in range(1, took.shape[1]):
        live = np.flatnonzero(sizes >= step)
        cand = last[live] + score[begins[live] + step]
        k = cand.argmax(1)
        took[live, step] = k + 1
        last[live, 1:] = last[live, :-1]
        last[live, 0] = cand[np.arange(len(live)), k]
    return took


def left_states(took: np.ndarray, sizes: np.ndarray, w: int) -> np.ndarray:
    """For each chunk and each state at its end, the state at its start (chunks x w)."""
    at = sizes[:, None] - np.arange(w)
    while (inside := at > 0).any():
        at = np.where(inside, at - took[np.arange(len(at))[:, None], np.maximum(at, 0)], at)
    return -at


def trace(m: Model, ids: np.ndarray, codes: np.ndarray, begin: int, took: np.ndarray, end: int, stop: int = 0) -> list[int]:
    """The ids of the pieces of a chunk that end at the cuts from ``end`` down to, without, ``stop``."""
    out: list[int] = []
    while end > stop:
        k = int(took[end])
        p = int(ids[begin + end, k - 1])
        if p >= 0:
            out.append(p)
        else:
            out.extend(m.byte[b] for b in reversed(chr(int(codes[begin + end - 1])).encode("utf-8", "surrogatepass")))
        end -= k
    return out[::-1]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(n: int, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    begins = np.arange(0, max(n, 1), size)
    return begins, np.minimum(size, n - begins)


def entered(mats: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """The best scores of the states at every chunk's start, given those at the first one's."""
    pre = prefixes(mats[:-1]) if len(mats) > 1 else mats[:0]
    return np.concatenate([enter[None], (enter[None, :, None] + pre).max(1)])


def start(w: int) -> np.ndarray:
    """The scores of the states at a text's start: it is a cut."""
    return np.where(np.arange(w) == 0, 0.0, NEVER)


def scan(m: Model, text: str, size: int = CHUNK) -> list[int]:
    """Ids of ``text`` (as it is: no space is put before it), by the scan over its chunks."""
    codes = codes_of(text)
    if not len(codes):
        return []
    begins, sizes = chunks(len(codes), size)
    score, ids = m.arcs(codes)
    took = forward(m, score, entered(transfers(m, score, begins, sizes), start(m.longest)), begins, sizes)
    left, state, out = left_states(took, sizes, m.longest), 0, []
    for k in range(len(begins) - 1, -1, -1):
        out.append(trace(m, ids, codes, int(begins[k]), took[k], int(sizes[k]) - state))
        state = int(left[k, state])
    return list(chain.from_iterable(reversed(out)))


def short(m: Model, text: str) -> tuple[int, ...]:
    """Ids of a short segment: the same best path, from left to right."""
    s, w = text.replace(" ", SPACE), m.longest
    n, get = len(s), m.score.get
    best, took = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(1, n + 1):
        top, arg = best[i - 1] + get(s[i - 1], m.unknown), 1
        for j in range(i - 2, max(i - w, 0) - 1, -1):
            x = get(s[j:i])
            if x is not None and best[j] + x > top:
                top, arg = best[j] + x, i - j
        best[i], took[i] = top, arg
    out: list[int] = []
    while n:
        k = took[n]
        p = m.id.get(s[n - k : n])
        if p is None:
            out.extend(m.byte[b] for b in reversed(s[n - 1].encode("utf-8", "surrogatepass")))
        else:
            out.append(p)
        n -= k
    return tuple(out[::-1])


def many(m: Model, parts: list[str]) -> dict[str, tuple[int, ...]]:
    """:func:`short` for many segments at once (each with a space before it), a character a step over all of them."""
    parts = sorted(parts, key=len, reverse=True)
    codes = codes_of(" " + " ".join(parts)) if parts else np.zeros(0, np.uint32)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    local = np.arange(len(codes)) - np.repeat(begins, sizes)
    arcs, acc = [], np.zeros(len(codes), np.uint64)
    for size in range(1, min(m.longest, int(sizes.max(initial=0))) + 1):
        acc = acc[: len(codes) - size + 1] * _BASE + codes[size - 1 :].astype(np.uint64) + np.uint64(1)
        at = np.arange(len(acc)) if size == 1 else np.flatnonzero(local[size - 1 :] >= size - 1)
        got = np.full(len(codes), -1, np.int32)
        got[at + size - 1] = m.lookup(acc if size == 1 else acc[at])
        arcs.append((got, np.where(got >= 0, m.weights[got], m.unknown if size == 1 else NEVER)))
    best, took = np.zeros(len(codes) + 1), np.ones(len(codes), np.int8)
    live = len(parts)
    for step in range(1, int(sizes.max(initial=0)) + 1):
        while sizes[live - 1] < step:
            live -= 1
        end = begins[:live] + step - 1  # the last character so far; best is kept by the one after it
        top = (best[end] if step > 1 else 0.0) + arcs[0][1][end]
        arg = np.ones(live, np.int8)
        for k in range(2, min(step, m.longest) + 1):
            x = (best[end - k + 1] if k < step else 0.0) + arcs[k - 1][1][end]
            better = x > top
            top, arg = np.where(better, x, top), np.where(better, np.int8(k), arg)
        best[end + 1], took[end] = top, arg  # the next segment's first place is not read before it is set
    at, who = begins + sizes, np.arange(len(parts))
    found, owner = [], []
    while len(who):
        end = at - 1
        k = took[end].astype(np.int64)
        ids = np.full(len(who), -1, np.int64)
        for size in np.unique(k):
            sel = k == size
            got = arcs[size - 1][0][end[sel]]
            ids[sel] = np.where(got >= 0, m.numbers[got], -1)
        single = (ids < 0) & (codes[end] < 128)
        ids[single] = m.low[codes[end[single]]]
        found.append(ids)
        owner.append(who)
        at = at - k
        left = at > begins[who]
        at, who = at[left], who[left]
    if not parts:
        return {}
    ids, owner = np.concatenate(found)[::-1], np.concatenate(owner)[::-1]
    order = np.argsort(owner, kind="stable")
    flat, ends = ids[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(parts))).tolist()
    odd = set(owner[ids < 0].tolist())
    out, lo = {}, 0
    for i, (p, hi) in enumerate(zip(parts, ends, strict=True)):
        out[p] = short(m, " " + p) if i in odd else tuple(flat[lo:hi])
        lo = hi
    return out


class Cache(dict):
    """Ids of the segments met, without the space before them; emptied when CACHE are held."""

    def __init__(self, m: Model):
        self.model = m

    def __missing__(self, part: str) -> tuple[int, ...] | list[int]:
        return scan(self.model, " " + part) if len(part) > SHORT else short(self.model, " " + part)

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if len(p) <= SHORT and p not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = [p for p in parts if len(p) <= SHORT]
        new.sort(key=len)
        ends = np.cumsum([len(p) + 1 for p in new])
        lo = 0
        while lo < len(new):  # the arcs of all characters at once are many times the text
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LEARN, "right")))
            self.update(many(self.model, new[lo:hi]))
            lo = hi


def encode_batch(m: Model, texts: list[str | None]) -> Iterator[list[int]]:
    """Ids of each text; none for null and empty."""
    cut = [(CUT.split(x) if "  " in x or x[0] == " " else x.split(" ")) if x else [] for x in texts]
    m.cache.learn(set(chain.from_iterable(cut)))
    for parts in cut:
        yield list(chain.from_iterable(map(m.cache.__getitem__, parts)))


def encode(m: Model, text: str | None) -> list[int]:
    return next(encode_batch(m, [text]))


def decode(m: Model, ids: list[int]) -> str:
    """The text of ``ids``; the space before it goes again."""
    return b"".join(map(m.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep: tuple[str, ...] = (), giant: int = GIANT) -> DataFrame:
    """``key``, ``keep``, ids (array<int>), n_tokens, decodes (whether decoding gives the text again) of every row.

    Null and empty texts have no ids. Repeated rows are each encoded. Texts with more than ``giant`` characters are
    split over tasks, which does not change their ids; a null key is allowed, as rows are told apart by a number of their
    own. A column of ``keep`` that is named as one of the three results gives way to it.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary_path()
    results = ("ids", "n_tokens", "decodes")
    cols = [c for c in dict.fromkeys((key, *keep)) if c != text and c.lower() not in results]
    also = text in keep
    whole, number = fresh([*docs.columns, *results], "_text_", "_row_")
    source = docs.select(F.col(text).alias(whole), *cols)
    long = F.coalesce(F.length(whole) > giant, F.lit(False))
    kinds = StructType([*source.schema, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("decodes", BooleanType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for lo, hi in text_slices(b.column(0), 1 << 20):
                part = b.slice(lo, hi - lo)
                sizes, flat, same = [0], [], []
                texts = part.column(0).to_pylist()
                for x, ids in zip(texts, encode_batch(m, texts), strict=True):
                    flat += ids
                    sizes.append(len(flat))
                    same.append(decode(m, ids) == (x or ""))
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(np.diff(sizes).astype(np.int32)), pa.array(same)], names=[*part.schema.names, "ids", "n_tokens", "decodes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            same = [decode(m, ids) == x for x, ids in zip(b.column(0).to_pylist(), b.column(b.schema.get_field_index("ids")).to_pylist(), strict=True)]
            yield b.append_column("decodes", pa.array(same, pa.bool_()))

    found = source.where(~long).mapInArrow(frugal(rows), kinds)
    big = source.where(long)
    if not big.isEmpty():
        big = numbered(big, number)
        ids = _giant(big.select(F.col(number).alias("row"), F.col(whole).alias("text")), path)
        out = big.join(ids.withColumnRenamed("row", number), number).select(*source.columns, "ids", F.size("ids").alias("n_tokens"))
        found = found.union(out.mapInArrow(frugal(check), kinds))
    return found.withColumnRenamed(whole, text) if also else found.drop(whole)


def _giant(big: DataFrame, path: str) -> DataFrame:
    """(row, ids) of giant texts (row, text): strides of chunks as rows, their matrices combined by text, each stride traced
    back by itself from every state at its end, and put together by text."""
    stride = 64 * CHUNK

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model(path).longest
        kind = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("before", pa.int32()), ("part", pa.string())])
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = " " + x
                for n, lo in enumerate(range(0, len(x), stride)):
                    before = min(lo, w - 1)
                    yield pa.RecordBatch.from_pylist([{"row": i, "n": n, "before": before, "part": x[lo - before : lo + stride]}], schema=kind)

    def arcs(m: Model, before: int, part: str):
        codes = codes_of(part)
        begins, sizes = chunks(len(codes) - before)
        return codes, begins + before, sizes, *m.arcs(codes)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for i, n, before, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, begins, sizes, score, _ = arcs(m, before, x)
                whole = prefixes(transfers(m, score, begins, sizes))[-1]
                yield pa.RecordBatch.from_pylist([{"row": i, "n": n, "mat": whole.tobytes()}], schema=pa.schema([("row", pa.int64()), ("n", pa.int32()), ("mat", pa.binary())]))

    def borders(group: pa.Table) -> pa.Table:
        w = model(path).longest
        order = np.argsort(group["n"].to_numpy())
        mats = np.stack([np.frombuffer(group["mat"][int(k)].as_py()).reshape(w, w) for k in order])
        enter = entered(mats, start(w))
        return pa.table({"row": pa.array([group["row"][0].as_py()] * len(mats), pa.int64()), "n": pa.array(np.arange(len(mats), dtype=np.int32)), "enter": pa.array([x.tobytes() for x in enter], pa.binary())})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        kind = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("head", pa.list_(pa.int32())), ("tails", pa.list_(pa.list_(pa.int32()))), ("left", pa.list_(pa.int32()))])
        for b in batches:
            for i, n, before, x, enter in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes, begins, sizes, score, ids = arcs(m, before, x)
                took = forward(m, score, entered(transfers(m, score, begins, sizes), np.frombuffer(enter)), begins, sizes)
                # the chunks' lengths of last pieces one after the other: place j is for the cut after j characters
                flat = np.concatenate([[0], *(took[k, 1 : size + 1] for k, size in enumerate(sizes))]).astype(np.int64)
                most = len(flat) - 1
                ends = [most - s for s in range(m.longest)]
                met = list(ends)  # walk all paths back until they meet
                while (far := max(met)) > 0 and min(met) != far:
                    met = [j - int(flat[j]) if j == far else j for j in met]
                meet = max(0, max(met))
                tails = [trace(m, ids, codes, before, flat, e, meet) for e in ends]
                head, left, at = trace(m, ids, codes, before, flat, meet), [], meet
                while at > 0:
                    at -= int(flat[at])
                if meet:
                    left = [-at] * m.longest
                else:
                    left = [-j for j in met]
                yield pa.RecordBatch.from_pylist([{"row": i, "n": n, "head": head, "tails": tails, "left": left}], schema=kind)

    def joined(group: pa.Table) -> pa.Table:
        state, out = 0, []
        for r in sorted(group.to_pylist(), key=lambda r: -r["n"]):
            out.append(r["head"] + r["tails"][state])
            state = r["left"][state]
        ids = list(chain.from_iterable(reversed(out)))
        return pa.table({"row": pa.array([group["row"][0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    cut = big.mapInArrow(split, "row long, n int, before int, part string")
    parts = written(cut, "chunks")
    tasks = max(1, parts.count() // STRIDES)  # small files are read by few tasks: deal the strides anew
    parts = parts.repartition(tasks)
    mats = written(parts.mapInArrow(frugal(matrices), "row long, n int, mat binary"), "matrices")
    ends = mats.groupBy("row").applyInArrow(borders, "row long, n int, enter binary")
    told = parts.join(ends, ["row", "n"]).select("row", "n", "before", "part", "enter").repartition(tasks)
    found = written(told.mapInArrow(frugal(traced), "row long, n int, head array<int>, tails array<array<int>>, left array<int>"), "traced")
    return found.groupBy("row").applyInArrow(joined, "row long, ids array<int>")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decodes of all documents."""
    return encoded(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids", "decodes")


@stage
def sentencepiece_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document with its token ids (n_tokens, ids; columns of those names give way).

    Rows in are rows out, whatever their doc_id; null and empty texts have no ids; very long texts are split over tasks
    and have the ids that they would have in one. No rows: none.
    """
    return encoded(docs, keep=tuple(docs.columns)).select(*docs.columns, "n_tokens", "ids")
