"""WARC archives of pages, and their index by external merge.

Writing: each task writes archives of gzip members, one record each, rotated at ``ARCHIVE_BYTES``. Of equal payloads the
capture of the smallest key is the response; the others revisit it. With its archives a task leaves runs of index
entries, sorted by (url key, timestamp, page id), with a sparse index of two levels at their end. Merging: the key space
is cut into ranges at sampled entries; a task seeks the k runs to its range (of each it reads the upper level and one
leaf) and merges them by a loser tree, which gives the captures in global order; where there are more than ``FAN_IN``
runs, groups of them are merged to longer runs first.
Reading follows the merged index and fetches each record at its place.

Files go through the file system of the shared folder's scheme, under names that only one attempt of a task writes; the
list of those that count is what the tasks return, written as a table. So a lost executor costs its tasks' attempts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, shared_dir, ship, table, written

ARCHIVE_BYTES, RUN_ROWS, STRIDE, LEAF, RANGE_ROWS, FAN_IN, SAMPLES = 32 << 20, 50_000, 64, 256, 8_000, 64, 1024
#: Captures are dated by their keys, within a span of years: keys of any size have a date.
EPOCH, SPAN = datetime(2024, 1, 1, tzinfo=UTC), 1 << 28
#: Stands for a null key in index entries: later than every other.
NO_PAGE = 1 << 63


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a uri or plain path, and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """A key that sorts a site's captures together: host labels reversed, then the rest. Null: empty."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return url or ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, when: str, page: int | None, payload: bytes, sha: str, refers: int | None) -> bytes:
    """One record. A revisit carries no payload; its digest and length are those of the full payload. The record of a null
    page is named by a random id."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:{f'page:{page}' if page is not None else f'uuid:{uuid.uuid4()}'}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


# --- runs of index entries ------------------------------------------------------------------------------------------
# Entry: (url key, timestamp, page id, archive, offset, length). A run is a file of framed blocks of STRIDE entries, framed
# leaves with the first key and place of LEAF blocks each, a framed root with those of the leaves, and the root's place.


def _frame(out, value) -> int:
    """Writes one framed block; returns its length."""
    raw = zlib.compress(json.dumps(value).encode(), 1)
    out.write(struct.pack("<I", len(raw)) + raw)
    return 4 + len(raw)


def _framed(f, at: int):
    f.seek(at)
    (n,) = struct.unpack("<I", f.read(4))
    return json.loads(zlib.decompress(f.read(n)))


def write_run(fs: pafs.FileSystem, path: str, entries: Iterator[tuple]) -> tuple[int, list[list]]:
    """Writes sorted entries; returns their number and up to SAMPLES keys spread over the run."""
    index, n, at, entries = [], 0, 0, iter(entries)
    with fs.open_output_stream(path) as out:
        while block := list(islice(entries, STRIDE)):
            index.append((block[0][:3], at))
            at += _frame(out, block)
            n += len(block)
        root = []
        for lo in range(0, len(index), LEAF):
            root.append((index[lo][0], at))
            at += _frame(out, index[lo : lo + LEAF])
        _frame(out, root)
        out.write(struct.pack("<Q", at))
    step = -(-len(index) // SAMPLES) or 1
    return n, [list(k) for k, _ in index[::step]]


def read_run(fs: pafs.FileSystem, path: str, lo: tuple | None = None, hi: tuple | None = None) -> Iterator[tuple]:
    """The entries of a run with lo <= key < hi: the root, the leaves and blocks of that range, one of each in memory."""
    with fs.open_input_file(path) as f:
        f.seek(f.size() - 8)
        (end,) = struct.unpack("<Q", f.read(8))
        for _, leaf in _within(_framed(f, end), lo, hi):
            for _, at in _within(_framed(f, leaf), lo, hi):
                for e in _framed(f, at):
                    key = tuple(e[:3])
                    if hi is not None and key >= hi:
                        return
                    if lo is None or key >= lo:
                        yield tuple(e)


def _within(index: list, lo: tuple | None, hi: tuple | None) -> list:
    """The parts of an index (first key, place) that may hold keys from lo to hi."""
    keys = [tuple(k) for k, _ in index]
    first = max(0, bisect_left(keys, lo) - 1) if lo is not None else 0
    return index[first : bisect_left(keys, hi) if hi is not None else len(keys)]


class LoserTree:
    """Merges k sorted iterators: each step replays only the winner's path of log2(k) matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head: list[tuple | None] = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k  # losers; place 0 holds the winner
        for i in range(self.k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether a's head goes first: ended runs last, ties by the run's number."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # while the tree fills, the first to come waits here
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while True:
            i = self.tree[0]
            got = self.head[i]
            if got is None:
                return
            yield got
            self.head[i] = next(self.runs[i], None)
            self._replay(i)


# --- writing --------------------------------------------------------------------------------------------------------


def _resolved(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, sha, refers: refers is the smallest id of equal payloads, null for that row itself.

    Only digests that occur twice come back to the rows, by an equi-join that adaptive execution may split.
    """
    rows = pages.withColumn("sha", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("sha", "first")
    first = F.when((F.octet_length("payload") >= least) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(same, "sha", "left").select("page_id", "url", "payload", first.alias("refers"))


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> tuple[DataFrame, str]:
    """Writes a record for every row; returns the table of runs (run, n, samples) and the archives' folder.

    The payload is the html in UTF-8 (null: empty). Payloads of fewer than ``least`` bytes never revisit. Null urls are
    written as empty. A row of a null key is later than all others: it revisits an equal payload that has a key. Keys may be
    any long. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, root = file_system(base)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(base)
        ctx = TaskContext.get()
        tag = f"{ctx.partitionId()}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, name, at, files = None, "", 0, 0
        entries: list[tuple] = []
        runs: list[tuple] = []

        def close_run() -> None:
            nonlocal entries
            if entries:
                entries.sort()
                path = f"run-{tag}-{len(runs)}.cdx"
                runs.append((path, *write_run(fs, f"{root}/{path}", iter(entries))))
                entries = []

        for b in batches:
            for page, link, body, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                page, link, body, refers = page.as_py(), link.as_py() or "", body.as_py(), refers.as_py()
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, files = f"part-{tag}-{files}.warc.gz", 0, files + 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                when = EPOCH + timedelta(seconds=(page or 0) % SPAN)
                stamp = when.strftime("%Y-%m-%dT%H:%M:%SZ")
                kind = "revisit" if refers is not None else "response"
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                raw = z.compress(record(kind, link.replace("\r", " ").replace("\n", " "), stamp, page, body, digest(body), refers)) + z.flush()
                out.write(raw)
                entries.append((url_key(link), when.strftime("%Y%m%d%H%M%S"), NO_PAGE if page is None else page, name, at, len(raw)))
                at += len(raw)
                if len(entries) >= RUN_ROWS:
                    close_run()
        if out is not None:
            out.close()
        close_run()
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs]), pa.array([r[1] for r in runs], pa.int64()), pa.array([json.dumps(r[2]) for r in runs])], ["run", "n", "samples"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    return written(_resolved(rows, least).mapInArrow(frugal(run), "run string, n long, samples string"), "runs"), base


def merged_runs(runs: DataFrame, base: str) -> list:
    """Rows (run, n, samples) of about FAN_IN runs at most: while there are more, groups are merged to longer ones."""

    def merge(group: pa.Table) -> pa.Table:
        fs, root = file_system(base)
        path = f"run-merged-{uuid.uuid4().hex}.cdx"
        n, samples = write_run(fs, f"{root}/{path}", iter(LoserTree([read_run(fs, f"{root}/{x}") for x in sorted(group["run"].to_pylist())])))
        return pa.table({"run": [path], "n": pa.array([n], pa.int64()), "samples": [json.dumps(samples)]})

    while (many := runs.count()) > 2 * FAN_IN:
        group = F.pmod(F.xxhash64("run"), F.lit(-(-many // FAN_IN))).alias("g")
        runs = written(runs.groupBy(group).applyInArrow(merge, "run string, n long, samples string"), "runs")
    return runs.collect()


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Archives ``pages``, merges the runs and reads every record back, in the index's global order.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, range, place: rows of one url key
    lie in order of capture; range and place give the place in the whole index. Every digest is checked against the
    bytes read. Repeated rows are each archived; rows of a null key come back with a null page_id. An empty table gives no
    rows.
    """
    spark = pages.sparkSession
    runs, base = archive(pages, key, url, html, least)
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, range int, place int"
    held = merged_runs(runs, base)
    total = sum(r.n for r in held)
    if not total:
        return spark.createDataFrame([], shape)
    ranges = max(1, -(-total // RANGE_ROWS))
    keys = sorted(tuple(k) for r in held for k in json.loads(r.samples))  # at most SAMPLES keys of each of 2 * FAN_IN runs
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if ranges > 1 else []
    names = sorted(r.run for r in held)
    bounds = spark.sparkContext.broadcast([None, *cuts, None])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(base)
        for b in batches:
            for part in b.column(0).to_pylist():
                lo, hi = bounds.value[part : part + 2]
                merged = iter(LoserTree([read_run(fs, f"{root}/{n}", lo, hi) for n in names]))
                place = 0
                while block := list(islice(merged, 1024)):
                    yield _fetched(fs, root, block, part, place)
                    place += len(block)

    return spark.range(0, len(cuts) + 1, 1, len(cuts) + 1).mapInArrow(frugal(read), shape)  # a range for each task


def _fetched(fs: pafs.FileSystem, root: str, block: list[tuple], part: int, place: int) -> pa.RecordBatch:
    """The records of a block of merged entries; read archive by archive, returned in the index's order."""
    rows: list = [None] * len(block)
    order = sorted(range(len(block)), key=lambda i: block[i][3:5])
    name, f = None, None
    for i in order:
        key, stamp, page, file, at, size = block[i]
        if file != name:
            if f is not None:
                f.close()
            name, f = file, fs.open_input_file(f"{root}/{file}")
        f.seek(at)
        fields, body = parse(zlib.decompress(f.read(size), 31))
        kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(body) != sha:
            raise ValueError(f"page {page}: the payload read differs from the one written")
        refers = fields.get("WARC-Refers-To")
        rows[i] = (None if page == NO_PAGE else page, int(fields["X-Payload-Length"]), sha, kind, int(refers[10:-1]) if refers else None, key, stamp, part, place + i)
    if f is not None:
        f.close()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range", "place"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record as read back through the merged index."""
    return captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, html, list_aggregate(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits FROM p)
SELECT page_id, strlen(d.html) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_position(list_transform(range(0, 32), lambda x: lpad(bin(x), 5, '0')), substr(bits, CAST(5 * i + 1 AS INT), 5)) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d JOIN f ON d.html = f.html
"""
