"""Token-id output: texts packed into rows of fixed length by best-fit decreasing.

Texts are encoded by byte-level pair merging (the vocabulary file is a parameter), an end token put after each, and those longer than a row split into rows of their own and a rest, so
no token is lost. The pieces of about ``PACK_TOKENS`` tokens are packed together, longest first, each into the fullest
row that still takes it; a segment tree over capacities finds that row in log(row length) steps. Packing happens where
the texts are read: nothing is shuffled, and a task holds one such load at a time.

A row of the result is one row of the id matrix (little-endian, padded), with the cumulative lengths of its segments,
the positions (which begin anew with each segment), and for each segment its text's key and offset.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import frugal, ship, table, text_slices
from .warc import file_system

ROW, PACK_TOKENS, PAD = 2048, 4 << 20, 0


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str) -> tuple[tiktoken.Encoding, int]:
    """The encoder of a file of ranks, and the end token: the first number that is free."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


class Capacities:
    """A segment tree over the free places of rows: which capacities some row has, and the smallest that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        at = free + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least free places of ``need`` or more, removed from the tree, and how many it has."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, to the first part on the right that has any
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:  # down, by the left
                at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return self.rows[free].pop(), free


def best_fit_decreasing(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Rows of item numbers; every size is 1 to ``most``. Equal sizes are taken in their order."""
    tree, rows = Capacities(most), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        got = tree.take(n)
        if got is None:
            got = (len(rows), most)
            rows.append([])
        row, free = got
        rows[row].append(i)
        if free > n:
            tree.put(row, free - n)
    return rows


SCHEMA = "pack long, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_offsets array<int>"


def _load(keys: list, ids: np.ndarray, ends: np.ndarray, most: int, pack: int) -> pa.RecordBatch:
    begins = np.concatenate([[0], ends[:-1]])
    pieces = -(-(ends - begins) // most)
    owner = np.repeat(np.arange(len(keys)), pieces)
    offset = (np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]) * most
    lo = begins[owner] + offset
    size = np.minimum(most, ends[owner] - lo)
    rows = best_fit_decreasing(size, most)
    kind = ids.dtype
    out: dict[str, list] = {k: [] for k in ("n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "doc_offsets")}
    for row in rows:
        line, pos, cu = np.full(most, PAD, kind), np.zeros(most, kind if most < 65536 else np.uint32), [0]
        for i in row:
            a, n = cu[-1], int(size[i])
            line[a : a + n] = ids[lo[i] : lo[i] + n]
            pos[a : a + n] = np.arange(n)
            cu.append(a + n)
        for k, v in zip(out, (cu[-1], line.tobytes(), cu, pos.tobytes(), [keys[owner[i]] for i in row], [int(offset[i]) for i in row]), strict=True):
            out[k].append(v)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([pack] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(out["n_tokens"], pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["cu_seqlens"], pa.list_(pa.int32())), pa.array(out["positions"], pa.binary()), pa.array(out["doc_ids"], pa.list_(pa.int64())), pa.array(out["doc_offsets"], pa.list_(pa.int32()))],
        ["pack", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "doc_offsets"],
    )


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", row: int = ROW, path: str | None = None, load: int = PACK_TOKENS) -> DataFrame:
    """Packed rows (SCHEMA) of all texts of ``docs``: ids and positions are ``row`` little-endian uint16 (ids of larger
    vocabularies: uint32).

    Every row of ``docs`` is packed, its end token included: a null or empty text is its end token alone. A null key
    stays null; repeated rows are packed each. pack numbers a task's loads and row the rows of a load.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path)
        kind = np.dtype("<u2" if end < 65536 else "<u4")
        pack = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        keys: list = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0
        for b in batches:
            for lo, hi in text_slices(b.column(1), 1 << 20):
                keys += b.column(0).slice(lo, hi - lo).to_pylist()
                flat: list[int] = []
                for x in b.column(1).slice(lo, hi - lo).to_pylist():
                    ids = code.encode_ordinary(x) if x else []
                    flat += ids
                    flat.append(end)
                    sizes.append(len(ids) + 1)
                parts.append(np.array(flat, kind))
                held += len(flat)
                if held >= load:
                    yield _load(keys, np.concatenate(parts), np.cumsum(sizes), row, pack)
                    pack, keys, parts, sizes, held = pack + 1, [], [], [], 0
        if keys:
            yield _load(keys, np.concatenate(parts), np.cumsum(sizes), row, pack)

    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(frugal(run), SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet files: a file holds whole loads, each the rows of an id matrix in order."""
    rows.write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def write_matrices(rows: DataFrame, path: str) -> DataFrame:
    """The packed rows as raw binary files under ``path``, three for each task that has rows: ids (the id matrix) and
    positions (the same shape; they begin anew with each segment), both little-endian, and lengths (int32: for each row the
    number of its cumulative lengths, then these). Returns the list of the files that count, written beside them as the
    table ``files`` (name, id_bytes, position_bytes, rows): a task that runs again writes files of its own."""
    spark = rows.sparkSession
    ship(spark)
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        ctx = TaskContext.get()
        name, outs, n, shape = f"{ctx.partitionId() if ctx else 0}-{uuid.uuid4().hex}", None, 0, (0, 0)
        for b in batches:
            for ids, cu, pos in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("ids", "cu_seqlens", "positions")), strict=True):
                outs = outs or [fs.open_output_stream(f"{root}/{name}.{k}") for k in ("ids", "positions", "lengths")]
                for out, raw in zip(outs, (ids, pos, np.array([len(cu), *cu], "<i4").tobytes()), strict=True):
                    out.write(raw)
                n, shape = n + 1, (len(ids), len(pos))
        if outs:
            for out in outs:
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), pa.array([n], pa.int64())], ["name", "id_bytes", "position_bytes", "rows"])

    rows.select("ids", "cu_seqlens", "positions").mapInArrow(run, "name string, id_bytes int, position_bytes int, rows long").write.parquet(f"{path}/files")
    return spark.read.schema("name string, id_bytes int, position_bytes int, rows long").parquet(f"{path}/files")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(ids, cu_seqlens, positions) of every row of the files that count under ``path``."""
    ship(spark)
    files = spark.read.schema("name string, id_bytes int, position_bytes int, rows long").parquet(f"{path}/files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for b in batches:
            for f in b.to_pylist():
                with fs.open_input_stream(f"{root}/{f['name']}.ids") as ids, fs.open_input_stream(f"{root}/{f['name']}.positions") as pos, fs.open_input_stream(f"{root}/{f['name']}.lengths") as lengths:
                    for _ in range(f["rows"]):
                        (n,) = np.frombuffer(lengths.read(4), "<i4")
                        cu = np.frombuffer(lengths.read(4 * int(n)), "<i4")
                        yield pa.RecordBatch.from_arrays([pa.array([ids.read(f["id_bytes"])], pa.binary()), pa.array([cu], pa.list_(pa.int32())), pa.array([pos.read(f["position_bytes"])], pa.binary())], ["ids", "cu_seqlens", "positions"])

    return files.mapInArrow(run, "ids binary, cu_seqlens array<int>, positions binary")


def op7_token_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded and packed into rows of ROW tokens."""
    return packed(table(spark, sf_dir, "documents"))
