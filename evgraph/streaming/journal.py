"""The file journal: coalescing, renames, ledgers, deltas and freshness, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RENAME_MS = 50


def latest_per_path(journal: DataFrame) -> DataFrame:
    """The journal with applied: 1 for the last event of a path, 2 for those that it makes void."""
    last = F.max("seq").over(Window.partitionBy("path"))
    return journal.withColumn("applied", F.when(F.col("seq") == last, 1).otherwise(2))


def coalesce(journal: DataFrame) -> DataFrame:
    """One event for each path, the last. Partial aggregation meets hot paths before the shuffle."""
    return journal.groupBy("path").agg(F.max_by(F.struct("seq", "observed_ms", "event_kind"), "seq").alias("e"), F.count(F.lit(1)).alias("events")).select("path", "e.*", "events")


def rename_pairs(journal: DataFrame, within_ms: int = RENAME_MS) -> DataFrame:
    """(name, deleted, created): a delete and the first create after it of the same name, within the time.

    Each event is used once. A create pairs with the delete just before it, so two neighbours of one name are looked at,
    never all pairs.
    """
    rows = journal.where(F.col("event_kind").isin("delete", "create"))
    w = Window.partitionBy("name").orderBy("observed_ms", "seq")
    rows = rows.withColumn("next_kind", F.lead("event_kind").over(w)).withColumn("next_ms", F.lead("observed_ms").over(w)).withColumn("created", F.lead("seq").over(w))
    hit = (F.col("event_kind") == "delete") & (F.col("next_kind") == "create") & (F.col("next_ms") - F.col("observed_ms") <= within_ms)
    return rows.where(hit).select("name", F.col("seq").alias("deleted"), "created")


def drop_covered(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events without the deletes and creates that renames cover."""
    return events.join(pairs.select(F.col("deleted").alias("seq")), "seq", "left_anti").join(pairs.select(F.col("created").alias("seq")), "seq", "left_anti")


def ledger_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed by digest."""
    rows = before.select("path", F.col("digest").alias("was")).join(now.select("path", F.col("digest").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return rows.select("path", change.alias("change")).where("change is not null")


def metadata_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, event_kind): create, modify or delete by size, time, and identity where both sides have that column."""
    cols = [c for c in ("size", "mtime", "identity") if c in before.columns and c in now.columns]
    rows = before.select("path", F.struct(*cols).alias("was")).join(now.select("path", F.struct(*cols).alias("now")), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "modify")
    return rows.select("path", kind.alias("event_kind")).where("event_kind is not null")


def folder_digests(children: DataFrame) -> DataFrame:
    """(path, digest) of folders from their children (parent, path, digest).

    Children are parted by the first byte of their names' digests; a part is digested over its sorted children
    (name:digest), the folder over its parts. So no task holds more than a part of a folder, whatever its size.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = children.select("parent", F.substring(F.sha2(name, 256), 1, 2).alias("part"), F.concat(name, F.lit(":"), "digest").alias("child"))
    lines = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = rows.groupBy("parent", "part").agg(lines("child").alias("digest"))
    return parts.groupBy(F.col("parent").alias("path")).agg(lines(F.concat("part", F.lit(":"), "digest")).alias("digest"))


def merkle(leaves: DataFrame, depth: int) -> DataFrame:
    """(path, digest) of all folders up to the root (empty path), from leaves (path, digest) ``depth`` parts deep.

    A level a step: see :func:`folder_digests`. Other levels hold folders only, so each step is smaller than the last.
    """
    from evgraph.functions import text as X

    level, out = leaves.select("path", "digest"), None
    for _ in range(depth):
        level = folder_digests(level.withColumn("parent", X.dirname(F.col("path"))))
        out = level if out is None else out.unionByName(level)
    return out


def apply_delta(facts: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The next generation: facts of unchanged paths, and the new facts. changed: (path)."""
    return facts.join(changed.select("path"), "path", "left_anti").select(*facts.columns).unionByName(new.select(*facts.columns))


def unresolve(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges into deleted nodes stay, without a target and of the least tier."""
    gone = deleted.select(F.col("id").alias("target")).distinct().withColumn("_gone", F.lit(True))
    rows = edges.join(gone, "target", "left")
    return rows.select("source", F.when(F.col("_gone"), None).otherwise(F.col("target")).alias("target"), "kind", F.when(F.col("_gone"), "UNRESOLVED").otherwise(F.col("tier")).alias("tier"))


def freshness(state: DataFrame) -> DataFrame:
    """state (repo, watched, gap, pending) with freshness: unwatched, then degraded, stale, current."""
    return state.withColumn("freshness", F.when(~F.col("watched"), "unwatched").when(F.col("gap"), "degraded").when(F.col("pending") > 0, "stale").otherwise("current"))


def barrier(applied: int, target: int, gap: bool, waited_ms: int, timeout_ms: int = 2000) -> str:
    """What waiting for a clock gives: caught_up, gap_blocked, timeout, or wait."""
    if gap:
        return "gap_blocked"
    if applied >= target:
        return "caught_up"
    return "timeout" if waited_ms >= timeout_ms else "wait"


# --- as a stream ----------------------------------------------------------------------------------------------------


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


#: Every so many batches the journal's tables are merged to one.
COMPACT = 16


def drained(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The last event of each path in ``target``: of the last merged table and the batches since. None: no batch yet."""
    from evgraph.sources.store import manifest

    found = manifest(spark, target, below)
    if found is None:
        return None
    first = max(0, (found["number"] + 1) // COMPACT * COMPACT - 1)
    rows = spark.read.parquet(*(f"{target}/gen={i:010d}/journal" for i in range(first, found["number"] + 1)))
    return rows.groupBy("path").agg(F.max_by(F.struct("seq", "observed_ms", "event_kind"), "seq").alias("e")).select("path", "e.*")


def drain(journal: DataFrame, target: str, checkpoint: str) -> None:
    """Keeps the last event of each path in ``target``, a generation a batch; runs until the input is used up.

    A batch writes its own paths only, every COMPACT-th all of them, under the batch's number: run again, it gives the same.
    """
    from evgraph.sources.store import publish

    def apply(batch: DataFrame, number: int) -> None:
        new = coalesce(batch).select("path", "seq", "observed_ms", "event_kind")
        old = drained(batch.sparkSession, target, number) if number % COMPACT == COMPACT - 1 else None
        if old is not None:
            new = old.unionByName(new).groupBy("path").agg(F.max_by(F.struct("seq", "observed_ms", "event_kind"), "seq").alias("e")).select("path", "e.*")
        publish(target, number, {"journal": new})

    journal.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


PAIR = "name string, deleted long, created long"


def rename_stream(journal: DataFrame, within_ms: int = RENAME_MS) -> DataFrame:
    """The rename pairs of a stream (name, seq, observed_ms, event_kind, ts): the last delete of a name waits for its create.

    State is one delete a name, dropped when the time has passed by the watermark.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.getOption
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        rows = pd.concat(list(batches)).sort_values(["observed_ms", "seq"])
        for seq, ms, kind in zip(rows.seq, rows.observed_ms, rows.event_kind, strict=True):
            if kind == "create" and held is not None and ms - held[1] <= within_ms:
                out.append((key[0], held[0], int(seq)))
            held = (int(seq), int(ms)) if kind == "delete" else None
        if held is not None:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] + within_ms, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["name", "deleted", "created"])

    rows = journal.where(F.col("event_kind").isin("delete", "create")).withWatermark("ts", "1 second")
    return rows.groupBy("name").applyInPandasWithState(pair, PAIR, "seq long, ms long", "append", GroupStateTimeout.EventTimeTimeout)
