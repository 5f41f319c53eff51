"""Documents: lines, fences, headings, claims, their evidence, and what has to be verified again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import text as X

#: Kinds of comment claims and their patterns: owner or body in group 1, body in group 2 (fixed values).
COMMENTS = (
    ("TODO", r"(?i)\bTODO(?:\(([^)]+)\))?\s*:\s*(.+)$"),
    ("HACK", r"(?i)\bHACK(?:\(([^)]+)\))?\s*:\s*(.+)$"),
    ("NOTE", r"(?i)\bNOTE(?:\(([^)]+)\))?\s*:\s*(.+)$"),
    ("WHY", r"(?i)\bWHY(?:\(([^)]+)\))?\s*:\s*(.+)$"),
    ("DEPRECATED", r"(?i)\bdeprecated(?:\s*:\s*(.+))?"),
    ("OWNER", r"(?i)\bowner\s*[:=]\s*(.+)$"),
)


def structure(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line, text) with in_fence and heading: the last heading outside a fence, the line's own included.

    A document's lines are one window; a document is one row of its table, so that is bounded.
    """
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.trim("text").startswith("```").cast("int")
    rows = lines.withColumn("_n", F.sum(fence).over(w)).withColumn("in_fence", (F.col("_n") % 2 == 1) | (fence == 1))
    head = F.when(~F.col("in_fence") & F.col("text").rlike(r"^#{1,6}\s+\S"), F.regexp_replace("text", r"^#{1,6}\s+", ""))
    return rows.withColumn("heading", F.last(head, ignorenulls=True).over(w)).drop("_n")


def claims(lines: DataFrame) -> DataFrame:
    """(doc_id, line, claim, status) of lines outside fences that look like claims."""
    rows = structure(lines).where(~F.col("in_fence") & X.looks_like_claim(F.col("text")))
    return rows.select("doc_id", "line", X.truncate(X.clean_claim(F.col("text")), 220).alias("claim"), X.classify_status(F.col("text")).alias("status"))


def comment_claims(lines: DataFrame, path: str = "path") -> DataFrame:
    """(id, path, line, kind, owner, body) of TODO, HACK, NOTE, WHY, deprecation and owner comments."""
    clean = F.trim(F.regexp_replace("text", r"^//|^#|^/\*|\*/$|^\s*\*?\s?", ""))
    kinds = []
    for kind, pattern in COMMENTS:
        two = kind in ("TODO", "HACK", "NOTE", "WHY")
        one, second = F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2) if two else F.lit("")
        owner = F.when(one != "", F.trim(one))
        body = F.trim(F.when(second != "", second).when(one != "", one).otherwise(clean))
        kinds.append(F.when(clean.rlike(pattern), F.struct(F.lit(kind).alias("kind"), owner.alias("owner"), body.alias("body"))))
    rows = lines.select(path, "line", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("c"))
    mark = F.substring(F.sha1(F.concat_ws(":", F.col(path), F.col("line").cast("string"), "c.kind", "c.body")), 1, 16)
    return rows.select(F.concat(F.lit("claim:"), mark).alias("id"), path, "line", "c.kind", "c.owner", "c.body")


def lifecycle(lines: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(doc_id, lifecycle, target, on, resolved): superseded where one of the first two non-blank lines says so."""
    mark = r"(?i)^[>*_\s]*superseded by\s+`?([^\s`]+)`?(?:\s+on\s+(\d{4}-\d{2}-\d{2}))?"
    w = Window.partitionBy("doc_id").orderBy("line")
    first = lines.where(F.trim("text") != "").withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    hit = first.where(F.col("text").rlike(mark)).groupBy("doc_id").agg(F.min_by("text", "line").alias("t"))
    out = lines.select("doc_id").distinct().join(hit, "doc_id", "left")
    out = out.select("doc_id", F.when(F.col("t").isNull(), "current").otherwise("superseded").alias("lifecycle"), F.regexp_extract("t", mark, 1).alias("target"), F.expr(f"try_cast(nullif(regexp_extract(t, r'{mark}', 2), '') as date)").alias("on"))
    if paths is None:
        return out.withColumn("resolved", F.lit(None).cast("boolean"))
    known = paths.select(F.col("path").alias("target")).distinct().withColumn("resolved", F.lit(True))
    return out.join(known, "target", "left").withColumn("resolved", F.when(F.col("lifecycle") == "superseded", F.coalesce("resolved", F.lit(False))))


def doc_code_join(claim: DataFrame, refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc_id, line, path, node): every claim with every code reference of its document; the node is the file's, else
    the path's first symbol. claim: (doc_id, line, ...); refs: (doc_id, path); files: (path, node); symbols: (path, ordinal, node)."""
    first = symbols.groupBy("path").agg(F.min_by("node", "ordinal").alias("symbol"))
    rows = claim.join(refs, "doc_id").join(files.withColumnRenamed("node", "file"), "path", "left").join(first, "path", "left")
    return rows.select(*claim.columns, "path", F.coalesce("file", "symbol").alias("node"))


def classify_join(rows: DataFrame) -> DataFrame:
    """rows (lifecycle, status, node) with kind and confidence; rows of no kind are dropped."""
    kind = F.when(F.col("lifecycle") == "superseded", "supersedes").when(F.col("status").isin("stale", "planned"), "contradicts").when(F.col("status").isin("implemented", "partial") & F.col("node").isNotNull(), "supports")
    return rows.withColumn("kind", kind).where("kind is not null").withColumn("confidence", F.when(F.col("kind") == "supersedes", 0.9).otherwise(0.85))


def claim_slice(claim: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Every claim with the sorted list of its edges (target, kind); empty where it has none."""
    nested = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("target", "kind"))).alias("edges"))
    return claim.join(nested, key, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<target:string,kind:string>>")))


def verify_plan(now: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """(key, action, reason): reuse a verdict whose input has the same fingerprint; else verify, and why.

    now: (key, fingerprint, null where an input is missing); before: (key, fingerprint).
    """
    rows = now.join(before.select(key, F.col("fingerprint").alias("was")), key, "left")
    reason = F.when(F.col("fingerprint").isNull(), "missing_input").when(F.col("was").isNull(), "cold_start").when(F.col("was") != F.col("fingerprint"), "input_changed")
    return rows.select(key, F.when(reason.isNull(), "reuse").otherwise("verify").alias("action"), reason.alias("reason"))
