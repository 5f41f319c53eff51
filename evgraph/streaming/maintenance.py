"""Keeping a generation up to date: appending to the journal, deltas by owner, dependents, digests, reconciliation, status."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.functions import text as X
from evgraph.operators import traverse
from evgraph.operators.order import positions
from evgraph.session import cut
from evgraph.streaming.journal import folder_digests, ledger_diff, metadata_diff

#: Kinds of events that are applied although the contents have the digest they had (fixed values).
ALWAYS = ("delete", "rename", "repair")
#: Dependents of a change that are repaired, and how many are repaired at once (fixed values).
REPAIR_HOPS, REPAIR_FILES, REPAIR_BATCH = 2, 500, 50


def append(events: DataFrame, high: int, order: list[str]) -> DataFrame:
    """``events`` (path, event_kind, rename_to, observed_ms) as the journal's next rows: seq and source_clock go on from the
    high-water mark ``high``, without gaps and in ``order``; applied is 0. Paths are normalised, an update is a modify."""
    kind = F.when(F.col("event_kind") == "update", "modify").otherwise(F.col("event_kind"))
    rows = events.withColumn("event_kind", kind).withColumn("path", X.normal_path(F.col("path"))).withColumn("rename_to", X.normal_path(F.col("rename_to")))
    rows = positions(rows, order, "seq", high + 1)
    return rows.select("seq", "observed_ms", "event_kind", "path", "rename_to", F.col("seq").alias("source_clock"), F.lit(0).alias("applied"))


def high_water(journal: DataFrame) -> int:
    """The journal's last clock; 0 where it is empty."""
    return journal.agg(F.coalesce(F.max("source_clock"), F.lit(0))).first()[0]


def without_owners(facts: DataFrame, owners: DataFrame) -> DataFrame:
    """``facts`` without those of the owners (path, provider); a null provider stands for all of the path's."""
    whole = owners.where("provider is null").select("path").distinct()
    one = owners.where("provider is not null").select("path", "provider").distinct()
    return facts.join(whole, "path", "left_anti").join(one, ["path", "provider"], "left_anti").select(*facts.columns)


def apply_events(state: DataFrame, facts: DataFrame, events: DataFrame, parsed: DataFrame) -> dict[str, DataFrame]:
    """The next state and facts, and what each event did: {state, facts, applied}.

    state: (path, digest, applied_clock); events: one for each path (path, event_kind, rename_to, digest, source_clock);
    facts and parsed: (id, path, provider, ...), what the changed files now hold. An event whose digest is that of the state
    changes nothing but the clock, unless its kind is one of ALWAYS. Deletes and renames drop all facts of their path;
    others those of the providers that were parsed anew. A rename's facts and state come under its new path.
    """
    rows = cut(events.join(state.select("path", F.col("digest").alias("was"), F.col("applied_clock").alias("prior")), "path", "left"))
    same = F.col("digest").isNotNull() & F.col("was").eqNullSafe(F.col("digest")) & ~F.col("event_kind").isin(*ALWAYS)
    rows = rows.withColumn("noop", same).withColumn("now", F.when(F.col("event_kind") == "rename", F.col("rename_to")).when(F.col("event_kind") != "delete", F.col("path")))
    work = rows.where("not noop")
    dropped = work.where(F.col("event_kind").isin("delete", "rename")).select("path", F.lit(None).cast("string").alias("provider"))
    fresh = parsed.join(work.select(F.col("now").alias("path")), "path", "left_semi").select(*facts.columns)
    renewed = fresh.select("path", "provider").distinct()
    next_facts = without_owners(facts, dropped.unionByName(renewed)).unionByName(fresh)
    clock = F.greatest(F.coalesce("prior", F.lit(0)), "source_clock")
    kept = state.join(rows.select("path"), "path", "left_anti").join(rows.where("now is not null").select(F.col("now").alias("path")), "path", "left_anti")
    after = rows.where("now is not null").select(F.col("now").alias("path"), F.when(F.col("noop"), F.col("was")).otherwise(F.col("digest")).alias("digest"), F.when(F.col("noop"), clock).otherwise(F.col("source_clock")).alias("applied_clock"))
    after = after.groupBy("path").agg(F.max_by(F.struct("digest", "applied_clock"), "applied_clock").alias("s")).select("path", "s.*")
    return {"state": kept.select("path", "digest", "applied_clock").unionByName(after), "facts": next_facts, "applied": rows.select("path", "event_kind", "noop", F.when(F.col("noop"), clock).otherwise(F.col("source_clock")).alias("applied_clock"))}


def dependent_repair(changed: DataFrame, depends: DataFrame, hops: int = REPAIR_HOPS, most: int = REPAIR_FILES, batch: int = REPAIR_BATCH) -> DataFrame:
    """(path, depth, batch): the files to extract again because they depend on changed ones (id), nearest and least first.

    depends: (source, target), the source depending on the target. ``most`` files go, in batches numbered from 0; those
    beyond have a null batch: what remains, to be taken up when the next change comes.
    """
    reach = traverse.closure(changed, depends.withColumn("kind", F.lit("DEPENDS")), hops, "in").where("depth > 0")
    placed = positions(reach, ["depth", "id"], "place", 0)
    return placed.select(F.col("id").alias("path"), "depth", F.when(F.col("place") < most, F.floor(F.col("place") / batch)).alias("batch"))


def merkle_update(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger (path, kind, digest) after ``changes`` (path, digest; null: removed), as a full build would give it.

    Only the folders above a change are digested anew, a level at a time from the deepest, each from its children alone.
    A folder that is left empty goes; the root (empty path) stays.
    """
    files = ledger.where("kind = 'file'").join(changes.select("path"), "path", "left_anti").select("path", "digest")
    files = cut(files.unionByName(changes.where("digest is not null").select("path", "digest")))
    above = cut(changes.select(F.explode(X.parents(F.col("path"))).alias("path")).distinct())
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    folders = ledger.where("kind = 'dir'").join(above, "path", "left_anti").select("path", "digest")
    deepest = above.agg(F.max(depth)).first()[0]
    for level in range(-1 if deepest is None else deepest, -1, -1):
        todo = above.where(depth == level)
        children = files.unionByName(folders).where("path <> ''").withColumn("parent", X.dirname(F.col("path")))
        made = folder_digests(children.join(todo.withColumnRenamed("path", "parent"), "parent", "left_semi").select("parent", "path", "digest"))
        if level == 0:
            made = made.unionByName(todo.join(made, "path", "left_anti").select("path", F.sha2(F.lit(""), 256).alias("digest")))
        folders = cut(folders.unionByName(made))
    return files.select("path", F.lit("file").alias("kind"), "digest").unionByName(folders.select("path", F.lit("dir").alias("kind"), "digest"))


def reconcile(before: DataFrame, now: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """(path, event_kind, rename_to): what has to be queued so that the store catches up with the tree.

    before, now: (path, size, mtime, identity); watched: (path, event_kind, rename_to) that a watcher saw since its
    snapshot. Renames cover the delete and the create of their paths; of several events of one path and target the last
    counts, the tree's own after the watcher's.
    """
    tree = metadata_diff(before, now).withColumn("rename_to", F.lit(None).cast("string")).withColumn("_n", F.lit(1))
    if watched is None:
        return tree.drop("_n")
    both = watched.select("path", "event_kind", "rename_to").withColumn("_n", F.lit(0)).unionByName(tree)
    renames = both.where("event_kind = 'rename' and rename_to is not null").select(F.col("path").alias("_from"), F.col("rename_to").alias("_to")).distinct()
    gone = renames.select(F.col("_from").alias("path"), F.lit("delete").alias("event_kind")).unionByName(renames.select(F.col("_to").alias("path"), F.lit("create").alias("event_kind"))).distinct()
    left = both.join(gone, ["path", "event_kind"], "left_anti")
    w = Window.partitionBy("path", "rename_to").orderBy(F.desc("_n"), F.desc("event_kind"))
    return left.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("path", "event_kind", "rename_to")


def source_signature(files: DataFrame) -> str:
    """A digest of (path, content_hash) rows, whatever their order."""
    h = F.xxhash64("path", "content_hash")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{row.n:x}-{int(row.s or 0) & (1 << 128) - 1:032x}-{(row.x or 0) & (1 << 64) - 1:016x}"


def graph_status(spark: SparkSession, root: str, files: DataFrame, versions: dict[str, str] | None = None, truncated: bool = False) -> dict:
    """{state, pending}: how the current generation under ``root`` compares with the tree's files (path, content_hash).

    missing: there is none; corrupt: its manifest or tables can't be read; incomplete: a table that it counts is not there;
    indeterminate: the scan was ``truncated``; stale: files differ (pending: how many), or ``versions`` of the extractors
    are not those of the manifest; else fresh.
    """
    from evgraph.sources.store import current, manifest

    try:
        found = manifest(spark, root)
    except (json.JSONDecodeError, UnicodeDecodeError):
        return {"state": "corrupt", "pending": 0}
    if found is None:
        return {"state": "missing", "pending": 0}
    if "files" not in found.get("counts", {}):
        return {"state": "incomplete", "pending": 0}
    if truncated:
        return {"state": "indeterminate", "pending": 0}
    try:
        known = current(spark, root, "files").select("path", F.col("content_hash").alias("digest"))
        pending = ledger_diff(known, files.select("path", F.col("content_hash").alias("digest"))).count()
    except Exception as error:  # noqa: BLE001 - whatever a reader says of bytes that are no table
        return {"state": "corrupt", "pending": 0, "error": str(error)[:200]}
    moved = versions is not None and found.get("versions") != versions
    return {"state": "stale" if pending or moved else "fresh", "pending": pending}


def barrier_p95(samples: DataFrame, last: int = 256) -> DataFrame:
    """(p95): the nearest-rank 95th percentile of the last ``last`` samples (seq, ms); none of no samples."""
    recent = samples.orderBy(F.desc("seq")).limit(last).select(F.greatest("ms", F.lit(0)).alias("ms"))
    return recent.agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"))
