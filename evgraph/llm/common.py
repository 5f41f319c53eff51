"""What the corpus operators share: reading tables, the shared folder, and vectorised text handling.

Text is handled a slice of an Arrow batch at a time, on the UTF-8 bytes themselves: words are found with a byte
table, and each is hashed eight bytes a step for all words of a slice at once. No Python object is made per word.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, ROWS_A_FILE, BATCH_ROWS = 2 << 20, 100_000, 2_000

#: Odd multipliers of 64-bit mixing functions (fixed values).
M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it (a cluster may install it instead), and keeps Arrow
    batches of whole texts small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir; a temporary one only where that is unset."""
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        found = "file://" + tempfile.mkdtemp(prefix="evgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors.

    ``rows``: a bound of its rows where one is known; few rows go to few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(4, rows // ROWS_A_FILE))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as set it apart from ``columns`` (whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(run: Stage) -> Stage:
    """A pipeline stage that sees the columns doc_id, text and n_chars, and all others under names that clash with none of
    its own; they get their names again. Where a stage adds a column that ``docs`` has too, the new one replaces it."""

    @wraps(run)
    def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c if c in ("doc_id", "text", "n_chars") else f"c{i}_": c for i, c in enumerate(docs.columns)}
        out = run(spark, docs.toDF(*names), sf_dir)
        new = [c for c in out.columns if c not in names]
        gone = {c.lower() for c in new}
        return out.select(*(F.col(n).alias(c) for n, c in names.items() if c.lower() not in gone), *new)

    return inner


def unique(docs: DataFrame, key: str | Column) -> bool:
    """Whether no two rows have the same ``key``; nulls are each other's equals."""
    key = F.col(key) if isinstance(key, str) else key
    return docs.groupBy(key.alias("k")).count().where("count > 1").isEmpty()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a number ``name`` of each row: once written, a row's number is the same for every reader."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def release() -> None:
    """Gives the memory that a task has freed back to the system; workers that wait for a task then hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, with :func:`release` after every batch that it gives and after the last."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b
            del b
            release()
        release()

    return inner


def bucket_of(key: str | Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % mod


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def text_slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer single text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield lo, hi
        lo = hi


def utf8(arr: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), padded by 8, and where each begins; ``lower``: A-Z become a-z."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[:-8] = LOWER[data] if lower else data
    return buf, off - off[0]


#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, off: np.ndarray, ends_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every text, and where each text's words begin.

    ``ends_word``: a table of the bytes that part words instead.
    """
    n = len(buf) - 8
    inside = ~(SPACE if ends_word is None else ends_word)[buf[:n]]
    first = np.empty(n, bool)
    last = np.empty(n, bool)
    if n:
        first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
        last[-1], last[:-1] = inside[-1], inside[:-1] & ~inside[1:]
        edges = off[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    view = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    sizes = ends - starts
    h = (sizes.astype(np.uint64) + np.uint64(seed)) * M3
    at, left, live = starts, sizes, slice(None)
    while True:
        x = view[at]
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        y = (h[live] ^ x) * M1
        y ^= y >> np.uint64(32)
        h[live] = y * M2
        more = left > 8
        if not more.any():
            break
        live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    h ^= h >> np.uint64(29)
    return h


def grams(h: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the index of each run's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        acc *= M2
        acc += h[k : len(h) - n + 1 + k]
    ok = np.ones(len(acc), bool)
    for k in range(1, n):  # a run may not reach over the start of the next text
        edge = begins[1:-1] - k
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(acc[at] + np.uint64(n)), at
