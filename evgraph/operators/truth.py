"""Document truth: maps of documents and claims, supersession, the relational rows of a generation, seals and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions import text as X
from evgraph.operators.resolve import first_wins

#: What makes a claim name a document that it supersedes (fixed values).
SUPERSEDES = r"(?i)\b(supersedes|replaced by|deprecated by)\b"
SUPERSEDED = r"(?i)(?:supersedes|replaced by|deprecated by)\s+([^\s.]+(?:\.[^\s.]+)*)"


def supersedes_chain(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """(source_doc, source_external, source_line, source_text, target_doc, superseded_on): which document stands above which.

    documents: (path, lifecycle, target, on); claims: (path, line, claim). A superseded document is below the one that its
    marker names, or below one outside the repository; a claim that says so puts its document above the one it names.
    """
    marked = documents.where("lifecycle = 'superseded'")
    by = F.nullif(F.col("target"), F.lit(""))
    out = marked.select(by.alias("source_doc"), by.isNull().alias("source_external"), F.lit(None).cast("int").alias("source_line"), F.lit(None).cast("string").alias("source_text"), F.col("path").alias("target_doc"), F.col("on").cast("string").alias("superseded_on"))
    said = claims.where(X.strip_code(F.col("claim")).rlike(SUPERSEDES)).withColumn("_target", F.regexp_extract("claim", SUPERSEDED, 1)).where("_target <> ''")
    told = said.select(F.col("path").alias("source_doc"), F.lit(False).alias("source_external"), F.col("line").cast("int").alias("source_line"), F.substring("claim", 1, 240).alias("source_text"), F.col("_target").alias("target_doc"), F.lit(None).cast("string").alias("superseded_on"))
    return out.unionByName(told)


def code_id(path: Column) -> Column:
    """The id of a path that documents name: readable, and told apart by a digest."""
    return F.concat(F.lit("code."), X.slug(path), F.lit("."), F.substring(F.sha2(path, 256), 1, 8))


def doc_map(documents: DataFrame, claims: DataFrame, refs: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The map of a repository's documents: nodes (id, kind, path), edges (from, to, type), missing_references,
    stale_claims, and invalid_markers (path, target).

    documents: (path, lifecycle, target, resolved); claims: (id, path, status); refs: (path, ref); files: (path). A document
    contains its claims and mentions its references; the document that a marker names, or the path where it is no
    document, supersedes the marked one.
    """
    known = files.select(F.col("path").alias("ref")).distinct().withColumn("exists", F.lit(True))
    refs = refs.select("path", "ref").distinct().join(known, "ref", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    doc = lambda c: F.concat(F.lit("doc:"), F.col(c))
    marked = documents.where("lifecycle = 'superseded' and target <> ''").select("path", "target")
    is_doc = documents.select(F.col("path").alias("target")).distinct().withColumn("_doc", F.lit(True))
    above = marked.join(is_doc, "target", "left").withColumn("_from", F.when(F.col("_doc"), doc("target")).otherwise(code_id(F.col("target"))))
    nodes = documents.select(doc("path").alias("id"), F.lit("doc").alias("kind"), "path").unionByName(claims.select("id", F.lit("claim").alias("kind"), "path"))
    code = refs.select(F.col("ref").alias("path")).unionByName(above.where("_doc is null").select(F.col("target").alias("path"))).distinct()
    nodes = nodes.unionByName(code.select(code_id(F.col("path")).alias("id"), F.lit("code_ref").alias("kind"), "path"))
    edges = claims.select(doc("path").alias("from"), F.col("id").alias("to"), F.lit("contains").alias("type"))
    edges = edges.unionByName(refs.select(doc("path").alias("from"), code_id(F.col("ref")).alias("to"), F.lit("mentions-code").alias("type")))
    edges = edges.unionByName(above.select(F.col("_from").alias("from"), doc("path").alias("to"), F.lit("supersedes").alias("type")))
    return {
        "nodes": nodes,
        "edges": edges,
        "missing_references": refs.where("not exists").select("path", "ref"),
        "stale_claims": claims.where("status = 'stale'").select("id", "path"),
        "invalid_markers": documents.where("lifecycle = 'superseded' and not resolved").select("path", "target"),
    }


def truth_rows(joins: DataFrame, chain: DataFrame, generation: str, paths: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four tables of a generation's document truth.

    joins: (ordinal, doc_path, doc_line, doc_sha, code_path, node, kind, reason, confidence); chain: that of
    :func:`supersedes_chain`; paths: (path) of documents that nothing joins. A claim is told by its document, line, code
    path and kind: the first join of a claim gives its row, the last join of an edge's id gives that edge's. Documents of
    either end of the chain have a row too.
    """
    gen = F.lit(generation).alias("generation_id")
    doc = lambda c: F.concat(F.lit("doc:"), c)
    line = F.coalesce(F.col("doc_line").cast("string"), F.lit("n"))
    rows = joins.where("doc_path is not null").withColumn("claim_id", F.concat_ws(":", F.lit("claim"), doc(F.col("doc_path")), line, F.coalesce(F.translate("code_path", "/", "_"), F.lit("n")), F.coalesce("kind", F.lit("n"))))
    rows = rows.withColumn("edge_id", F.concat_ws(":", F.lit("claimEdge"), "claim_id", F.coalesce("kind", F.lit("n")), F.coalesce("node", "code_path", F.lit("n"))))
    named = rows.select(F.col("doc_path").alias("path"), "ordinal", F.col("doc_sha").alias("content_hash"))
    late = chain.where("not source_external").select(F.col("source_doc").alias("path")).unionByName(chain.select(F.col("target_doc").alias("path")))
    late = late if paths is None else late.unionByName(paths.select("path"))
    named = named.unionByName(late.where("path is not null").select("path", F.lit(None).cast(joins.schema["ordinal"].dataType).alias("ordinal"), F.lit(None).cast("string").alias("content_hash")))
    documents = named.groupBy("path").agg(F.min_by("content_hash", "ordinal").alias("content_hash")).select(doc(F.col("path")).alias("id"), "path", "content_hash", gen)
    claims = rows.groupBy("claim_id").agg(F.min_by(F.struct("doc_path", "doc_line", "reason", "doc_sha"), "ordinal").alias("c"))
    claims = claims.select(F.col("claim_id").alias("id"), doc(F.col("c.doc_path")).alias("document_id"), F.col("c.doc_path").alias("source"), F.col("c.doc_line").alias("line"), F.col("c.reason").alias("text"), F.col("c.doc_sha").alias("sha1"), gen)
    edges = rows.groupBy("edge_id").agg(F.max_by(F.struct("claim_id", F.coalesce("kind", F.lit("supports")).alias("kind"), "code_path", "node", "confidence", "reason"), "ordinal").alias("e")).select(F.col("edge_id").alias("id"), "e.*", gen)
    place = F.concat(F.coalesce("source_doc", F.lit("ext")), F.lit("->"), F.coalesce("target_doc", F.lit("ext")), F.lit(":"), F.coalesce("source_line", F.lit(0)).cast("string"))
    chain = first_wins(chain.withColumn("id", F.concat(F.lit(f"supersede:{generation}:"), place)), ["id"], ["source_text"])
    return {"documents": documents, "claims": claims, "claim_code_edges": edges, "supersession": chain.withColumn("generation_id", F.lit(generation))}


# --- verdicts and phases --------------------------------------------------------------------------------------------


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def evidence_fingerprints(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(id, files, missing, fingerprint): each claim (id, paths) with its evidence's hashes; ``missing``: paths that no file
    (path, content_hash) has. The fingerprint does not depend on the order of the paths."""
    rows = claims.select("id", F.explode_outer(F.array_distinct("paths")).alias("path")).join(files.select("path", "content_hash"), "path", "left")
    pair = F.when(F.col("path").isNotNull(), F.struct("path", "content_hash"))
    out = rows.groupBy("id").agg(F.array_sort(F.collect_list(pair)).alias("files"), F.array_sort(F.collect_list(F.when(F.col("content_hash").isNull(), F.col("path")))).alias("missing"))
    return out.withColumn("fingerprint", fingerprint(F.col("id"), F.col("files")))


def seal(claims: DataFrame, verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """(id, verdict, fingerprint, decision_fingerprint): the verdicts bound to their evidence. A claim without a verdict, or
    with evidence that no file has, is an error that names the first of them."""
    rows = evidence_fingerprints(claims, files).join(verdicts.select("id", "verdict"), "id", "left")
    wrong = rows.where(F.col("verdict").isNull() | (F.size("missing") > 0)).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).first()
    if wrong.n:
        raise ValueError(f"can't seal: {wrong.n} claims lack a verdict or evidence, the first is {wrong.id}")
    return rows.select("id", "verdict", "fingerprint", fingerprint(F.col("id"), F.col("verdict"), F.col("fingerprint")).alias("decision_fingerprint"))


def decisions_current(sealed: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, verdict, current): whether a decision (id, decision, input_fingerprint) was taken on the verdict as it is now."""
    rows = sealed.join(decisions.select("id", "decision", "input_fingerprint"), "id", "left")
    return rows.select("id", "verdict", F.coalesce(F.col("decision").isNotNull() & (F.col("input_fingerprint") == F.col("decision_fingerprint")), F.lit(False)).alias("current"))


#: Verdicts that need a decision of the user's (fixed values).
DIVERGENT = ("contradicted", "stale")


def completion(generation: str | None, facts: dict, decisions: DataFrame | None = None) -> dict:
    """Whether the four phases are complete, and why not: {state, phases, reasons}.

    ``facts`` names what each phase rests on: graph_state; manifest, understanding and verdicts (None: not there; else the
    generation that each is of); pending (verdicts and dimensions still to do; None: not known); documents (None, or the
    generation they show) and workflow (whether they hold the diagram). ``decisions``: that of :func:`decisions_current`.
    """
    reasons: list[tuple[str, str]] = []

    def bound(phase: str, name: str) -> None:
        of = facts.get(name)
        if of is None:
            reasons.append((phase, f"missing_{name}"))
        elif of != generation:
            reasons.append((phase, f"stale_{name}"))

    if facts.get("graph_state") != "fresh":
        reasons.append(("phase1", f"graph_{facts.get('graph_state', 'missing')}"))
    bound("phase1", "manifest")
    bound("phase2", "understanding")
    bound("phase2", "verdicts")
    if facts.get("pending") is None:
        reasons.append(("phase2", "pending_unknown"))
    elif facts["pending"]:
        reasons.append(("phase2", "verification_pending"))
    bound("phase3", "documents")
    if facts.get("documents") == generation and not facts.get("workflow"):
        reasons.append(("phase3", "missing_workflow"))
    phases = {p: "incomplete" if any(q == p for q, _ in reasons) else "complete" for p in ("phase1", "phase2", "phase3")}
    open_ones = 0 if decisions is None else decisions.where(F.col("verdict").isin(*DIVERGENT)).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("current")).cast("int")).alias("left")).first()
    phases["phase4"] = "not_required" if not open_ones or not open_ones.n else "pending" if open_ones.left else "complete"
    if phases["phase4"] == "pending":
        reasons.append(("phase4", "pending_reconciliation"))
    done = all(v in ("complete", "not_required") for v in phases.values())
    return {"state": "complete" if done else "incomplete", "phases": phases, "reasons": [r for _, r in reasons]}
