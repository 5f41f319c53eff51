"""Source adapters: candidates for a task's context from anchors, the working tree, the graph, git, rules and live files.

An adapter gives two tables: candidates (id, adapter, layer, kind, path, score, start, end) and omissions (id, adapter,
reason). They are put together by :func:`evgraph.operators.context.fan_out`.
"""

from __future__ import annotations

import subprocess
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.functions import text as X

#: Layer of each adapter (fixed values).
LAYERS = {"task-anchor": 1, "dirty-files": 1, "graph-resolve": 3, "git-metadata": 1, "rules-documents": 2, "live-overlay": 1}
#: Score of a changed file by its state; any other 0.5 (fixed values).
DIRTY = {"modified": 0.95, "modified_both": 0.95, "staged": 0.95, "added": 0.92, "renamed": 0.92, "copied": 0.85, "untracked": 0.7, "deleted": 0.6}
#: Scores of a symbol named with its path, of a file, and of a symbol named alone (fixed values).
SYMBOL, FILE, TOKEN = 0.97, 0.9, 0.85
#: What a rule scores, and what its place at the root, its name, and its tags add (fixed values).
RULE, ROOT, NAMED, TAGGED = 0.55, 0.3, 0.1, 0.05
#: Score of a file whose contents, and of one whose time, is past the graph's (fixed values).
CHANGED, NEWER = 0.9, 0.85
#: Names of instructions, those at the root first, and folders of rules (fixed values).
INSTRUCTIONS, RULES = ("AGENTS.md", "CLAUDE.md"), r"^\.[a-z]+/rules/[^/]+\.md$"


class Found(NamedTuple):
    candidates: DataFrame
    omissions: DataFrame


def _candidate(adapter: str, kind: str, ident: Column, path: Column | str, score: Column | float, start: Column | None = None, end: Column | None = None) -> list[Column]:
    one = F.lit(1)
    return [F.concat(F.lit(f"{adapter}:"), ident).alias("id"), F.lit(adapter).alias("adapter"), F.lit(LAYERS[adapter]).alias("layer"), F.lit(kind).alias("kind"), (F.col(path) if isinstance(path, str) else path).alias("path"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("score"), F.coalesce(start if start is not None else one, one).cast("int").alias("start"), F.coalesce(end if end is not None else one, one).cast("int").alias("end")]


def _omission(rows: DataFrame, adapter: str, ident: Column, reason: Column | str) -> DataFrame:
    return rows.select(F.concat(F.lit(f"{adapter}:"), ident).alias("id"), F.lit(adapter).alias("adapter"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _safe(path: Column) -> Column:
    """Whether a path stays inside its root."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.rlike("^[A-Za-z]:")


def task_anchor(anchors: DataFrame, files: DataFrame) -> Found:
    """What a task names: anchors (path, symbol, start, end) that are files (path, lines)."""
    rows = anchors.select("path", "symbol", "start", "end").distinct().join(files.select("path", "lines"), "path", "left")
    good = F.col("lines").isNotNull() & _safe(F.col("path"))
    first, last = F.when(F.col("start") > 0, F.col("start")).otherwise(1), F.when(F.col("end") > 0, F.col("end")).otherwise(F.col("lines"))
    name = F.concat("path", F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.coalesce(F.concat(F.lit("#"), "symbol"), F.lit("")))
    kind = F.when(F.col("symbol").isNotNull(), "task_anchor_symbol").otherwise("task_anchor_path")
    out = rows.where(good).select(*_candidate("task-anchor", "", name, "path", 1.0, first, last), kind.alias("_kind")).withColumn("kind", F.col("_kind")).drop("_kind")
    return Found(out, _omission(rows.where(~good), "task-anchor", F.col("path"), F.when(_safe(F.col("path")), "anchor_missing").otherwise("anchor_outside_scope")))


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, status) of what git says has changed under ``root``; no rows where git does not answer."""
    done = subprocess.run(["git", "-C", root, "status", "--porcelain", "-z", "--untracked-files=all"], capture_output=True, check=False)
    parts, rows = iter(done.stdout.decode("utf-8", "replace").split("\0")) if done.returncode == 0 else iter(()), []
    names = {"?": "untracked", "D": "deleted", "A": "added", "R": "renamed", "C": "copied"}
    for x in parts:
        if len(x) > 3:
            index, tree, path = x[0], x[1], x[3:]
            if index in "RC":
                next(parts, None)  # the path that it came from
            state = names.get(index if index in "?DARC" else tree) or ("modified_both" if index == tree == "M" else "staged" if index == "M" else "modified")
            rows.append((path, state))
    return spark.createDataFrame(rows, "path string, status string")


def dirty_files(status: DataFrame, files: DataFrame) -> Found:
    """Changed files (path, status) that are there (path), and deleted ones."""
    rows = status.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    there = _safe(F.col("path")) & (F.col("_there").isNotNull() | (F.col("status") == "deleted"))
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DIRTY.items() for x in kv]), F.col("status")), F.lit(0.5))
    out = rows.where(there).select(*_candidate("dirty-files", "dirty_overlay", F.col("path"), "path", score))
    return Found(out, _omission(rows.where(~there), "dirty-files", F.col("path"), F.when(_safe(F.col("path")), "dirty_missing").otherwise("dirty_outside_scope")))


def graph_resolve(anchors: DataFrame, tokens: DataFrame, nodes: DataFrame, most: int = 5) -> Found:
    """What the graph knows of a task's anchors (path, symbol) and tokens (token).

    nodes: (id, kind, name, qualified, path, start, end). A symbol named with its path counts most, then files, then symbols
    named alone, ``most`` of each token; a node is given once, by the best of these.
    """
    name = "graph-resolve"
    asked = anchors.select("path", "symbol").distinct()
    symbols = nodes.where("kind <> 'file'")
    exact = asked.where("symbol is not null").join(symbols, "path").where((F.col("name") == F.col("symbol")) | (F.col("qualified") == F.col("symbol")) | F.endswith("qualified", F.concat(F.lit("."), "symbol")))
    exact = exact.withColumn("_n", F.row_number().over(Window.partitionBy("path", "symbol").orderBy("id"))).where("_n = 1")
    files = asked.select("path").distinct().join(nodes.where("kind = 'file'"), "path")
    keys = symbols.select("*", F.explode(F.array_distinct(F.filter(F.array("name", "qualified"), lambda x: x.isNotNull()))).alias("token"))
    alone = keys.join(tokens.select("token").distinct(), "token").withColumn("_n", F.row_number().over(Window.partitionBy("token").orderBy("id"))).where(F.col("_n") <= most)
    parts = [(exact, "graph_resolve_symbol", SYMBOL), (files, "graph_resolve_file", FILE), (alone, "graph_resolve_symbol", TOKEN)]
    every = None
    for rows, kind, score in parts:
        one = rows.select(*_candidate(name, kind, F.col("id"), "path", score, F.col("start"), F.col("end")))
        every = one if every is None else every.unionByName(one)
    out = every.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))).where("_n = 1").drop("_n")
    lost = _omission(asked.where("symbol is not null").join(exact.select("path", "symbol"), ["path", "symbol"], "left_anti"), name, F.concat("path", F.lit("#"), "symbol"), "graph_symbol_not_found")
    return Found(out, lost.unionByName(_omission(asked.select("path").distinct().join(files.select("path"), "path", "left_anti"), name, F.concat(F.lit("file:"), "path"), "graph_file_not_found")))


def git_metadata(spark: SparkSession, root: str) -> Found:
    """One candidate: the branch and the head of the repository; none where git does not answer."""
    got = [subprocess.run(["git", "-C", root, "rev-parse", *a], capture_output=True, text=True, check=False) for a in (["--abbrev-ref", "HEAD"], ["--short", "HEAD"])]
    ok = all(x.returncode == 0 for x in got)
    row = spark.createDataFrame([(":".join(x.stdout.strip() for x in got),)] if ok else [], "ref string")
    return Found(row.select(*_candidate("git-metadata", "git_metadata", F.col("ref"), F.lit(None).cast("string"), 0.6)), _omission(row.where("false"), "git-metadata", F.col("ref"), ""))


def rules_documents(files: DataFrame, terms: list[str], most: int = 24) -> Found:
    """Instructions (by name, the root's first) and the rules whose names share a term with the task; ``most`` rules.

    files: (path, text, lines). A rule without a word in its name always counts.
    """
    name = F.element_at(F.split("path", "/"), -1)
    told = files.where(name.isin(*INSTRUCTIONS) & _safe(F.col("path"))).select(*_candidate("rules-documents", "instruction", F.col("path"), "path", F.lit(RULE) + F.when(F.contains("path", F.lit("/")), 0.0).otherwise(ROOT), None, F.col("lines")))
    stem = X.words(F.regexp_replace(name, r"\.md$", ""))
    hits = F.size(F.array_intersect(stem, F.array(*map(F.lit, terms)).cast("array<string>")))
    rules = files.where(F.col("path").rlike(RULES)).withColumn("_hits", hits).where((F.col("_hits") > 0) | (F.size(stem) == 0))
    tagged = F.col("text").rlike(r"(?s)^---\n.*?\btags:\s*\S.*?\n---")
    rules = rules.orderBy(F.desc("_hits"), "path").limit(most)
    given = rules.select(*_candidate("rules-documents", "instruction", F.col("path"), "path", F.lit(RULE + NAMED) + F.when(tagged, TAGGED).otherwise(0.0), None, F.col("lines")))
    return Found(told.unionByName(given), _omission(files.where("false"), "rules-documents", F.col("path"), ""))


def live_overlay(files: DataFrame, known: DataFrame, indexed_ms: int | None, most: int = 25) -> Found:
    """Files (path, content_hash, mtime, lines) that the graph (path, content_hash) is behind of: other contents, or unknown
    to it and newer than its index. The first ``most`` by path."""
    rows = files.where(_safe(F.col("path"))).join(known.select("path", F.col("content_hash").alias("_was")), "path", "left")
    newer = F.lit(False) if indexed_ms is None else F.col("mtime") > indexed_ms
    moved = F.when(F.col("_was").isNotNull(), F.col("_was") != F.col("content_hash")).otherwise(newer)
    rows = rows.where(moved).orderBy("path").limit(most)
    score = F.when(F.col("_was").isNotNull(), CHANGED).otherwise(NEWER)
    return Found(rows.select(*_candidate("live-overlay", "live_overlay", F.col("path"), "path", score, None, F.col("lines"))), _omission(files.where("false"), "live-overlay", F.col("path"), ""))
