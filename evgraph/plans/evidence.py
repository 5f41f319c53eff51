"""Queries of neighbourhoods, document truth, module resolution, maintenance, adapters and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions import text as X
from evgraph.operators import adapters, context, listing, neighbourhood, ranking, resolve, traverse, truth
from evgraph.plans.docs import SQL_LINES
from evgraph.plans.graph import ROOT, SQL_EDGES, SQL_NODES, SQL_SMALL, _closure_sql, _seed, pagerank_rounds
from evgraph.plans.journal import folders_sql
from evgraph.session import cut
from evgraph.sources import tables
from evgraph.streaming import journal as J
from evgraph.streaming import maintenance as M


def _pick(values: list, by) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


# --- neighbourhoods -------------------------------------------------------------------------------------------------


def _ranked(spark, d, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Ranked nodes and edges around ROOT, with what each costs."""
    e = tables.edges(spark, d)
    reached = traverse.typed_closure(spark, [ROOT], tables.relations(spark, d), depth, "both")
    inside = traverse.neighbor_edges(reached, e).select("source", "target", "kind", "tier")
    nodes = ranking.rank_nodes(reached, inside, ROOT).withColumn("cost", X.json_tokens(F.length("id")))
    edges = ranking.rank_edges(reached, inside).withColumn("cost", X.json_tokens(F.length(F.concat("source", "target"))))
    return nodes, edges


def bounded_neighbors(spark, d):
    """The second page of a neighbourhood: what 60 tokens take behind the first five nodes."""
    nodes, edges = _ranked(spark, d)
    return neighbourhood.page(nodes.where("position <= 20"), edges, 60, (5, 0)).select("phase", "position", "cost", "used")


def _around(spark, d) -> neighbourhood.Pack:
    nodes = tables.nodes(spark, d, ("region", "nation", "customer", "supplier")).select("id", (F.length("id") * 2).cast("long").alias("cost"))
    return neighbourhood.typed_pack(nodes, tables.small_relations(spark, d), ["region:1", "nation:3"], 900, 1, 2)


def neighborhood(spark, d):
    return _around(spark, d).neurons.select("id", F.round("score", 6).alias("score"), "depth")


def neighborhood_omissions(spark, d):
    return _around(spark, d).omissions


_PACK = f"""WITH RECURSIVE {SQL_SMALL}, arcs AS (SELECT source a, target b FROM small UNION SELECT target, source FROM small),
reach(id, depth) AS (SELECT x, 0 FROM (VALUES ('region:1'), ('nation:3')) t(x) UNION SELECT b, depth + 1 FROM reach JOIN arcs ON a = id WHERE depth < 2),
v AS MATERIALIZED (SELECT 0 AS grp, id, min(depth) AS depth FROM reach GROUP BY id),
e AS MATERIALIZED (SELECT 0 AS grp, source, target FROM small WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)),
anchors AS (SELECT id FROM v WHERE id IN ('region:1', 'nation:3')), {pagerank_rounds("CASE WHEN v.id IN (SELECT id FROM anchors) THEN 0.5 ELSE 0 END")},
sc AS MATERIALIZED (SELECT v.id, v.depth, round(r.s, 9) AS score, length(v.id) * 2 AS cost FROM r20 r JOIN v ON v.id = r.id),
rest AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM sc WHERE depth <= 1 AND id NOT IN (SELECT id FROM anchors)),
fold(pos, used, id, taken) AS (SELECT 0, (SELECT CAST(sum(cost) AS BIGINT) FROM sc WHERE id IN (SELECT id FROM anchors)), '', false
  UNION ALL SELECT o.pos, CASE WHEN f.used + o.cost <= 900 THEN f.used + o.cost ELSE f.used END, o.id, f.used + o.cost <= 900 FROM fold f JOIN rest o ON o.pos = f.pos + 1)"""

# --- document truth -------------------------------------------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    """Documents as paths; every seventh says that the next one stands above it, every 21st that something outside does."""
    i = F.col("doc_id")
    target = F.when(i % 21 == 0, "").when(i % 7 == 0, F.concat(F.lit("doc/"), (i + 1).cast("string"))).otherwise("")
    return tables.read(spark, d, "documents").select(F.concat(F.lit("doc/"), i.cast("string")).alias("path"), F.when(i % 7 == 0, "superseded").otherwise("current").alias("lifecycle"), target.alias("target"), F.when(i % 14 == 0, F.lit("2024-05-01")).cast("date").alias("on"), "doc_id")


def _claims(spark, d) -> DataFrame:
    rows = tables.read(spark, d, "labels").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.lit(3).alias("line"), _pick(["Plan A supersedes doc/5.md. Done", "`supersedes x` is code", "This was Replaced by notes.old now", "Nothing of the kind", "deprecated by   v2"], F.col("doc_id")).alias("claim"), F.when(F.col("toxic") == 1, "stale").otherwise("claim").alias("status"))
    return rows.withColumn("id", F.concat(F.lit("claim:"), F.col("doc_id").cast("string")))


def supersedes(spark, d):
    return truth.supersedes_chain(_documents(spark, d), _claims(spark, d)).groupBy("source_external", "target_doc", "superseded_on").agg(F.count(F.lit(1)).alias("n"), F.min("source_doc").alias("least"))


def doc_map(spark, d):
    """Edges and what is wrong, counted by kind; references are to pages by number."""
    docs = _documents(spark, d)
    last = docs.agg(F.max("doc_id").alias("last"))
    known = docs.crossJoin(F.broadcast(last)).withColumn("resolved", F.when(F.col("lifecycle") == "superseded", (F.col("target") != "") & (F.col("doc_id") < F.col("last"))))
    refs = docs.select("path", F.concat(F.lit("page/"), (F.col("doc_id") % 1000).cast("string")).alias("ref"))
    files = tables.read(spark, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"))
    got = truth.doc_map(known, _claims(spark, d), refs, files)
    out = got["edges"].select(F.concat(F.lit("edge:"), "type").alias("what")).unionByName(got["nodes"].select(F.concat(F.lit("node:"), "kind").alias("what")))
    for name in ("missing_references", "stale_claims", "invalid_markers"):
        out = out.unionByName(got[name].select(F.lit(name).alias("what")))
    return out.groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def _joins(spark, d) -> DataFrame:
    """Turns of conversations as joins of claims and code."""
    i = F.col("conv_id")
    return tables.read(spark, d, "conversations").select((i * 100 + F.col("turn")).alias("ordinal"), F.concat(F.lit("doc/"), (i % 40).cast("string")).alias("doc_path"), F.col("turn").cast("int").alias("doc_line"), F.concat(F.lit("h"), i.cast("string")).alias("doc_sha"), F.concat(F.lit("src/"), (i % 7).cast("string")).alias("code_path"), F.when(i % 3 > 0, F.concat(F.lit("n"), (i % 5).cast("string"))).alias("node"), F.col("role").alias("kind"), F.concat(F.lit("r"), i.cast("string")).alias("reason"), F.lit(0.85).alias("confidence"))


def truth_rows(spark, d):
    got = truth.truth_rows(_joins(spark, d), truth.supersedes_chain(_documents(spark, d), _claims(spark, d).where("false")), "g1")
    out = got["claims"].select(F.lit("claim").alias("what"), "id", F.col("text").alias("of")).unionByName(got["claim_code_edges"].select(F.lit("edge").alias("what"), "id", F.col("reason").alias("of")))
    return out.unionByName(got["documents"].select(F.lit("document").alias("what"), "id", F.col("content_hash").alias("of"))).unionByName(got["supersession"].select(F.lit("above").alias("what"), "id", F.col("superseded_on").alias("of")))


def list_claims(spark, d):
    got = truth.truth_rows(_joins(spark, d), truth.supersedes_chain(_documents(spark, d), _claims(spark, d).where("false")), "g1")
    return listing.listing(got["claim_code_edges"], "g1", ["id"], 50, kind="user").select("id", "claim_id", "reason")


def hydrate_nodes(spark, d):
    asked = tables.read(spark, d, "orders").where("o_orderkey % 50 = 1").groupBy("o_custkey").agg(F.min("o_orderkey").alias("place"))
    ids = asked.select(tables.node_id("customer", "o_custkey").alias("id"), "place").unionByName(spark.createDataFrame([("nation:3", -1), ("nation:none", -2)], "id string, place long"))
    kinds = [tables.nodes(spark, d, (k,)) for k in ("nation", "customer", "supplier")]
    return listing.hydrate(kinds, ids).select("id", "kind", "name", "place")


def list_edges(spark, d):
    return listing.edges_where(tables.edges(spark, d), kind="USES", target="supplier:7").select("source", "target", "tier")


def sealed(spark, d):
    """Labelled documents as claims whose evidence are pages; verdicts bound to it, and which decisions still hold."""
    pages = tables.read(spark, d, "pages").where("page_id < 400")
    files = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.coalesce(F.sha2("html", 256), F.lit("")).alias("content_hash"))
    last = pages.agg(F.count(F.lit(1)).alias("n"))
    claims = tables.read(spark, d, "labels").crossJoin(F.broadcast(last)).select(F.col("doc_id").alias("id"), F.transform(F.array(F.col("doc_id"), F.col("doc_id") + 5), lambda x: F.concat(F.lit("p"), (x % F.col("n")).cast("string"))).alias("paths"), "quality")
    got = truth.seal(claims, claims.select("id", F.when(F.col("quality") == 1, "supported").otherwise("stale").alias("verdict")), files)
    decisions = got.where("id % 3 < 2").select("id", F.lit("keep").alias("decision"), F.when(F.col("id") % 3 == 0, F.col("decision_fingerprint")).otherwise("old").alias("input_fingerprint"))
    return truth.decisions_current(got, decisions).groupBy("verdict", "current").agg(F.count(F.lit(1)).alias("n"))


# --- resolution -----------------------------------------------------------------------------------------------------


def config_edges(spark, d):
    """Parts as constants whose lines name files of suppliers."""
    line = F.concat(F.lit("const c = ['conf/./s"), (F.col("p_partkey") % 150).cast("string"), F.lit(".json', \"x.txt\", 'conf/s"), (F.col("p_partkey") % 90).cast("string"), F.lit(".yaml']"))
    constants = tables.read(spark, d, "part").select(tables.node_id("part", "p_partkey").alias("id"), F.lit("src/a.js").alias("path"), line.alias("line_text"))
    ext = F.when(F.col("s_suppkey") % 2 == 0, ".json").otherwise(".yaml")
    files = tables.read(spark, d, "supplier").select(F.concat(F.lit("conf/s"), F.col("s_suppkey").cast("string"), ext).alias("path"), tables.node_id("supplier", "s_suppkey").alias("id"))
    return resolve.config_edges(constants, files)


def schema_references(spark, d):
    """Parts as tables and types: an sql one references the part of the next key, a graphql one names two."""
    key = F.col("p_partkey")
    s = lambda x: x.cast("string")
    sql = F.concat(F.lit("CREATE TABLE T"), s(key), F.lit(" (a int references db.\"t"), s(key + 1), F.lit("\" , T"), s(key + 2), F.lit(" int)"))
    ql = F.concat(F.lit("extend type T"), s(key), F.lit(" { a: T"), s(key + 2), F.lit("! b: [T"), s(key), F.lit("] t"), s(key + 4), F.lit(": Int }"))
    rows = tables.read(spark, d, "part").select(tables.node_id("part", "p_partkey").alias("id"), F.when(key % 2 == 0, "graphql").otherwise("sql").alias("family"), F.concat(F.lit("T"), s(key)).alias("name"), F.when(key % 2 == 0, ql).otherwise(sql).alias("body"))
    own = rows.unionByName(rows.where("family = 'sql'").select(F.concat("id", F.lit("v")).alias("id"), "family", "name", "body"))
    return resolve.schema_references(own)


def module_resolve(spark, d):
    """Specifiers of six shapes from files of suppliers; a third of the folders has packages of its own."""
    key = F.col("s_suppkey")
    s = lambda x: x.cast("string")
    at = F.concat(F.lit("app/d"), s(key % 3), F.lit("/f"), s(key), F.lit(".ts"))
    spec = _pick(["./g", "../d1/g", "./none", "pkg", "@org/lib/x", "gone"], key)
    wanted = tables.read(spark, d, "supplier").select(at.alias("from_path"), spec.alias("specifier"), (key % 2 == 0).alias("typed"))
    paths = [f"app/d{i}/g{e}" for i, e in ((0, ".js"), (0, ".ts"), (1, "/index.ts"), (2, ".json"))] + ["app/d0/node_modules/pkg/lib/main.js", "app/d0/node_modules/pkg.js", "node_modules/pkg/index.js", "node_modules/@org/lib/x.mjs"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    packages = spark.createDataFrame([("app/d0/node_modules/pkg", "lib/main"), ("node_modules/pkg", None), ("node_modules/@org/lib", "none.js")], "folder string, entry string")
    return resolve.modules(wanted, files, packages).groupBy("specifier", "target", "reason").agg(F.count(F.lit(1)).alias("n"))


def import_edges(spark, d):
    links = tables.read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("specifier"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("target"))
    return resolve.import_edges(links).groupBy("tier", "resolved").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("targets"))


def provider_ranks(spark, d):
    owners = tables.read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), _pick(["file", "symbol", "other"], F.col("l_linenumber")).alias("kind"), F.col("l_returnflag").alias("provider"))
    ranks = spark.createDataFrame([("A", 1), ("N", 0)], "provider string, rank int")
    return resolve.provider_ranks(owners, ranks)


# --- maintenance ----------------------------------------------------------------------------------------------------


def journal_append(spark, d):
    rows = tables.journal(spark, d).select(F.concat(F.lit("./a//"), "path").alias("path"), F.when(F.col("event_kind") == "modify", "update").otherwise(F.col("event_kind")).alias("event_kind"), F.lit(None).cast("string").alias("rename_to"), "observed_ms", F.col("seq").alias("of"))
    return M.append(rows, 1000, ["observed_ms", "of"]).select("seq", "source_clock", "event_kind", "path")


def _owned(spark, d) -> DataFrame:
    """Orders' lines as facts of files (orders) and providers (return flags)."""
    return tables.read(spark, d, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_returnflag").alias("provider"))


def delete_by_owner(spark, d):
    owners = tables.read(spark, d, "orders").where("o_orderkey % 4 < 2").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.when(F.col("o_orderkey") % 4 == 0, "N").alias("provider"))
    return M.without_owners(_owned(spark, d), owners)


def _events(spark, d) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    path = F.concat(F.lit("o"), key.cast("string"))
    state = tables.read(spark, d, "orders").where("o_orderkey % 5 < 4").select(path.alias("path"), F.col("o_orderstatus").alias("digest"), F.lit(3).cast("long").alias("applied_clock"))
    kind = _pick(["modify", "delete", "rename", "repair", "modify", "create"], key)
    events = tables.read(spark, d, "orders").where("o_orderkey % 2 = 0").select(path.alias("path"), kind.alias("event_kind"), F.concat("path", F.lit("n")).alias("rename_to"), F.when(key % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("digest"), (key % 7).cast("long").alias("source_clock"))
    return state, events


def _applied(spark, d) -> dict[str, DataFrame]:
    state, events = _events(spark, d)
    parsed = _owned(spark, d).where("provider <> 'R'").select(F.concat("id", F.lit("+")).alias("id"), F.explode(F.array("path", F.concat("path", F.lit("n")))).alias("path"), "provider")
    return M.apply_events(state, _owned(spark, d), events, parsed)


def apply_events_state(spark, d):
    return _applied(spark, d)["state"].groupBy("digest", "applied_clock").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("least"))


def apply_events_facts(spark, d):
    return _applied(spark, d)["facts"].groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


def dependent_repair(spark, d):
    uses = tables.use_edges(spark, d).select("source", "target")
    return M.dependent_repair(_seed(spark, "supplier:1", "supplier:2"), uses).groupBy("depth", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("least"))


def _tree(spark, d) -> DataFrame:
    return tables.read(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def merkle_update(spark, d):
    """Every ninth document changed, every tenth gone, and a new folder; the ledger is that of a full build."""
    leaves = _tree(spark, d)
    ledger = cut(leaves.select("path", F.lit("file").alias("kind"), "digest").unionByName(J.merkle(leaves, 3).select("path", F.lit("dir").alias("kind"), "digest")))
    number = F.element_at(F.split("path", "/"), -1).cast("long")
    changes = leaves.where((number % 9 == 0) | (number % 10 == 0)).select("path", F.when(number % 10 != 0, F.sha2("digest", 256)).alias("digest"))
    changes = changes.unionByName(spark.createDataFrame([("new/folder/x", "d")], "path string, digest string"))
    return M.merkle_update(ledger, changes).where("kind = 'dir'").select("path", "digest")


def reconcile(spark, d):
    docs = tables.read(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.col("doc_id").alias("identity"))
    i = F.col("identity")
    before = docs.where(i % 6 != 1)
    now = docs.where(i % 6 != 2).withColumn("identity", F.when(i % 6 == 3, -i).otherwise(i))
    watched = docs.where(i % 12 == 2).select("path", F.lit("rename").alias("event_kind"), F.concat(F.lit("d/"), (i - 1).cast("string")).alias("rename_to"))
    watched = watched.unionByName(docs.where(i % 6 == 3).select("path", F.lit("create").alias("event_kind"), F.lit(None).cast("string").alias("rename_to")))
    return M.reconcile(before, now, watched).groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"), F.count("rename_to").alias("renames"))


def barrier(spark, d):
    rows = tables.read(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 1009 - 9).cast("long").alias("ms"))
    return M.barrier_p95(rows)


# --- adapters, evidence, evaluation ---------------------------------------------------------------------------------


def _graph_nodes(spark, d) -> DataFrame:
    n = tables.nodes(spark, d, ("nation", "supplier"))
    return n.select("id", F.when(F.col("kind") == "nation", "file").otherwise("symbol").alias("kind"), "name", F.concat(F.lit("q."), "name").alias("qualified"), F.when(F.col("kind") == "nation", F.col("path")).otherwise(F.concat(F.lit("nation/"), (F.regexp_extract("id", r"(\d+)", 1).cast("int") % 30).cast("string"))).alias("path"), F.lit(2).alias("start"), F.lit(9).alias("end"))


def adapter_fanout(spark, d):
    """All adapters that need no repository, over nations as files and suppliers as symbols."""
    nodes = _graph_nodes(spark, d)
    files = tables.nodes(spark, d, ("nation",)).select("path", F.lit(40).alias("lines"))
    lines = tables.read(spark, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"), F.sha1("n_name").alias("content_hash"), F.col("n_nationkey").alias("mtime"), F.lit(40).alias("lines"))
    anchors = spark.createDataFrame([("nation/3", None, 0, 0), ("nation/4", "Supplier#000000004", 2, 9), ("nation/99", None, 0, 0), ("../x", None, 0, 0)], "path string, symbol string, start int, end int")
    status = tables.read(spark, d, "nation").select(F.concat(F.lit("nation/"), (F.col("n_nationkey") + 10).cast("string")).alias("path"), _pick(["modified", "untracked", "deleted", "odd"], F.col("n_nationkey")).alias("status"))
    told = tables.read(spark, d, "nation").select(_pick(["AGENTS.md", "a/AGENTS.md", ".own/rules/nation.md", ".own/rules/other.md", "x.md"], F.col("n_nationkey")).alias("path"), F.lit("---\ntags: x\n---\n").alias("text"), F.lit(4).alias("lines")).distinct()
    found = [
        adapters.task_anchor(anchors, files),
        adapters.dirty_files(status, files),
        adapters.graph_resolve(anchors, spark.createDataFrame([("Supplier#000000007",)], "token string"), nodes),
        adapters.rules_documents(told, ["nation", "rules"]),
        adapters.live_overlay(lines, lines.where("mtime % 3 > 0").select("path", F.when(F.col("mtime") % 3 == 1, "old").otherwise(F.col("content_hash")).alias("content_hash")), 10),
    ]
    rows = context.fan_out({str(i): (lambda f=f: f.candidates) for i, f in enumerate(found)}, ["id"])[0]
    out = rows.select("adapter", "id", F.round("score", 6).alias("score"))
    for f in found:
        out = out.unionByName(f.omissions.select("adapter", "id", F.lit(-1.0).alias("score")))
    return out


def trim_to_symbol(spark, d):
    """Documents' lines as code: some open a block, some close one."""
    lines = tables.doc_lines(spark, d).select(F.col("doc_id").cast("string").alias("path"), "line", F.when(F.col("line") % 5 == 2, F.concat("text", F.lit(" {"))).when(F.col("line") % 7 == 0, F.concat("text", F.lit("; "))).otherwise(F.translate("text", "{};", "")).alias("text"))
    spans = tables.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(4).alias("start"), F.lit(6).alias("end"))
    return context.trim(lines, spans, 400).select("path", "from_line", "to_line", "kept_to", "bytes", "kept_bytes", "truncated")


def qualify(spark, d):
    key = F.col("l_linenumber")
    rows = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.when(F.col("l_orderkey") % 2 == 0, "symbol_definition").otherwise("reference").alias("kind"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), key.alias("start"), (key + 3).alias("end"), F.col("l_returnflag").alias("content_hash"))
    actual = rows.where("start <> 2").select("task", F.when(F.col("start") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("root/"), "path")).alias("path"), F.when(F.col("start") == 3, 1).otherwise(F.col("start")).alias("start"), F.col("end"), F.when(F.col("start") == 4, "?").otherwise(F.col("content_hash")).alias("content_hash"))
    return ranking.qualify(rows, actual).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("tasks"), F.sum("missing").alias("missing"))


def vector_upsert(spark, d):
    rows = tables.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v"), F.lit("m1").alias("model"))
    i = F.col("id").cast("long")
    both = rows.crossJoin(F.broadcast(spark.range(2).withColumnRenamed("id", "n")))  # each row twice
    new = both.select((i * 3 + F.col("n")).alias("seq"), F.when(i % 11 > 0, (i + 5 * F.col("n")).cast("string")).alias("id"), F.when(i % 13 > 0, F.slice("v", 1, 60)).otherwise(F.array().cast("array<float>")).alias("v"), F.when(i % 2 == 0, "m2").alias("model"))
    return ranking.vector_upsert(rows, new).groupBy("model", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


def vector_scan(spark, d):
    rows = tables.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("v"), F.when(F.col("vec_id") % 2 == 0, "m2").otherwise("m1").alias("model"))
    return ranking.vector_scan(rows, [1.0] * 64, model="m2")[1]


def text_helpers(spark, d):
    docs = tables.read(spark, d, "conversations").select("role", "text", F.concat(F.lit("./src/"), F.col("role"), F.lit("/f"), F.col("turn").cast("string"), _pick([".md", ".py", ".png"], F.col("turn"))).alias("path"))
    terms = F.array(*map(F.lit, ["the", "error", "license"]))
    return docs.groupBy("role").agg(F.sum(F.size(X.task_words(F.col("text")))).cast("long").alias("words"), F.sum(X.term_hits(F.col("text"), terms)).cast("long").alias("hits"), F.sum(F.length(X.search_text(F.col("text")))).cast("long").alias("chars"), F.sum(X.is_document(F.col("path")).cast("long")).alias("documents"), F.sum(X.is_implementation(F.col("path")).cast("long")).alias("code"), F.sum(X.archive_match(F.col("path"), "src/user/").cast("long")).alias("prefix"), F.sum(X.archive_match(F.col("path"), "src/*/f1.*").cast("long")).alias("glob"))


_DOCS = "x AS (SELECT doc_id, 'doc/' || doc_id AS path, doc_id % 7 = 0 AS marked, CASE WHEN doc_id % 21 <> 0 AND doc_id % 7 = 0 THEN 'doc/' || (doc_id + 1) END AS target, CASE WHEN doc_id % 14 = 0 THEN '2024-05-01' END AS onday FROM documents)"
_JOINS = "j AS (SELECT conv_id * 100 + turn AS ordinal, 'doc/' || (conv_id % 40) AS doc_path, turn, 'h' || conv_id AS sha, 'src/' || (conv_id % 7) AS code, CASE WHEN conv_id % 3 > 0 THEN 'n' || (conv_id % 5) END AS node, role AS kind, 'r' || conv_id AS reason FROM conversations), c AS (SELECT *, 'claim:doc:' || doc_path || ':' || turn || ':' || replace(code, '/', '_') || ':' || kind AS claim_id FROM j), ce AS (SELECT *, 'claimEdge:' || claim_id || ':' || kind || ':' || coalesce(node, code) AS edge_id FROM c)"
_CHANGED = "t AS (SELECT source || '/' || lang || '/' || doc_id AS path, sha256(coalesce(text, '')) AS digest, doc_id FROM documents), leaf AS (SELECT path, CASE WHEN doc_id % 9 = 0 THEN sha256(digest) ELSE digest END AS digest FROM t WHERE doc_id % 10 <> 0 UNION ALL SELECT 'new/folder/x', 'd')"
_RANKED = f"""{_closure_sql(ROOT, 1, "both")}, ind AS (SELECT s.* FROM edges s JOIN reached a ON a.id = s.source JOIN reached b ON b.id = s.target), ends AS (SELECT source AS id, rank FROM ind UNION ALL SELECT target, rank FROM ind), ab AS (SELECT id, count(*) AS degree, min(rank) AS t FROM ends GROUP BY id),
rn AS (SELECT r.id, row_number() OVER (ORDER BY (r.id <> '{ROOT}')::INT, coalesce(t, 99), coalesce(degree, 0) DESC, depth, r.id) AS position FROM reached r LEFT JOIN ab ON ab.id = r.id),
re AS (SELECT source, target, row_number() OVER (ORDER BY rank, least(x.depth, y.depth), source, target, kind) AS position FROM ind JOIN reached x ON x.id = source JOIN reached y ON y.id = target)"""
QUERIES = {
    "bounded_neighbors": (
        bounded_neighbors,
        f"""WITH RECURSIVE {_RANKED}, cn AS (SELECT position, greatest(1, CAST(ceil(length(id) / 4.0) AS BIGINT)) AS cost FROM rn WHERE position BETWEEN 6 AND 20), un AS (SELECT *, CAST(sum(cost) OVER (ORDER BY position) AS BIGINT) AS used FROM cn), tn AS (SELECT * FROM un WHERE used <= 60 OR position = 6),
sp AS (SELECT CAST(sum(cost) AS BIGINT) AS spent FROM tn), cx AS (SELECT position, greatest(1, CAST(ceil(length(source || target) / 4.0) AS BIGINT)) AS cost FROM re), ue AS (SELECT *, CAST(sum(cost) OVER (ORDER BY position) AS BIGINT) + spent AS used FROM cx, sp)
SELECT 'node' AS phase, position::INT AS position, cost, used FROM tn UNION ALL SELECT 'edge', position::INT, cost, used FROM ue WHERE used <= 60""",
    ),
    "neighborhood": (neighborhood, f"{_PACK} SELECT id, round(score, 6) AS score, depth FROM sc WHERE id IN (SELECT id FROM anchors) OR id IN (SELECT id FROM fold WHERE taken)"),
    "neighborhood_omissions": (neighborhood_omissions, f"{_PACK} SELECT 'budget' AS reason, count(*) AS n FROM fold WHERE pos > 0 AND NOT taken HAVING count(*) > 0 UNION ALL SELECT 'hops', count(*) FROM sc WHERE depth > 1 HAVING count(*) > 0"),
    "supersedes_chain": (
        supersedes,
        f"""WITH {_DOCS}, a AS (SELECT target AS source_doc, target IS NULL AS source_external, path AS target_doc, onday AS superseded_on FROM x WHERE marked
UNION ALL SELECT 'doc/' || doc_id, false, CASE doc_id % 5 WHEN 0 THEN 'doc/5.md' WHEN 2 THEN 'notes.old' ELSE 'v2' END, NULL FROM labels WHERE doc_id % 5 IN (0, 2, 4)) SELECT source_external, target_doc, superseded_on, count(*) AS n, min(source_doc) AS least FROM a GROUP BY ALL""",
    ),
    "build_doc_map": (
        doc_map,
        f"""WITH {_DOCS}, m AS (SELECT path, target, target IN (SELECT path FROM x) AS isdoc FROM x WHERE marked AND target IS NOT NULL), refs AS (SELECT 'page/' || (doc_id % 1000) AS ref FROM documents), codes AS (SELECT ref FROM refs UNION SELECT target FROM m WHERE NOT isdoc)
SELECT * FROM (SELECT 'edge:contains' AS what, count(*) AS n FROM labels UNION ALL SELECT 'edge:mentions-code', count(*) FROM documents UNION ALL SELECT 'edge:supersedes', count(*) FROM m UNION ALL SELECT 'node:doc', count(*) FROM documents UNION ALL SELECT 'node:claim', count(*) FROM labels UNION ALL SELECT 'node:code_ref', count(*) FROM codes
UNION ALL SELECT 'missing_references', count(*) FROM refs WHERE ref NOT IN (SELECT 'page/' || page_id FROM pages) UNION ALL SELECT 'stale_claims', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'invalid_markers', count(*) FROM x WHERE marked AND (target IS NULL OR doc_id >= (SELECT max(doc_id) FROM documents))) WHERE n > 0""",
    ),
    "doc_truth_rows": (
        truth_rows,
        f"""WITH {_DOCS}, {_JOINS}, named AS (SELECT doc_path AS path, ordinal, sha FROM j UNION ALL SELECT target, NULL, NULL FROM x WHERE marked AND target IS NOT NULL UNION ALL SELECT path, NULL, NULL FROM x WHERE marked)
SELECT 'claim' AS what, claim_id AS id, arg_min(reason, ordinal) AS of FROM c GROUP BY claim_id UNION ALL SELECT 'edge', edge_id, arg_max(reason, ordinal) FROM ce GROUP BY edge_id UNION ALL SELECT 'document', 'doc:' || path, arg_min(sha, ordinal) FROM named GROUP BY path
UNION ALL SELECT 'above', 'supersede:g1:' || coalesce(target, 'ext') || '->' || path || ':0', onday FROM x WHERE marked""",
    ),
    "list_claims": (list_claims, f"WITH {_JOINS} SELECT edge_id AS id, arg_max(claim_id, ordinal) AS claim_id, arg_max(reason, ordinal) AS reason FROM ce WHERE kind = 'user' GROUP BY edge_id ORDER BY edge_id LIMIT 50"),
    "hydrate_nodes": (
        hydrate_nodes,
        f"WITH {SQL_NODES}, a AS (SELECT 'customer:' || o_custkey AS id, min(o_orderkey) AS place FROM orders WHERE o_orderkey % 50 = 1 GROUP BY 1 UNION ALL SELECT 'nation:3', -1) SELECT id, kind, name, place FROM nodes JOIN a USING (id)",
    ),
    "list_edges": (list_edges, f"WITH {SQL_EDGES} SELECT source, target, tier FROM edges WHERE kind = 'USES' AND target = 'supplier:7'"),
    "phase2_seal": (sealed, "SELECT CASE WHEN quality = 1 THEN 'supported' ELSE 'stale' END AS verdict, doc_id % 3 = 0 AS current, count(*) AS n FROM labels GROUP BY 1, 2"),
    "resolve_config": (
        config_edges,
        """WITH w AS (SELECT p_partkey, 'conf/s' || (p_partkey % 150) || '.json' AS path FROM part UNION SELECT p_partkey, 'conf/s' || (p_partkey % 90) || '.yaml' FROM part), f AS (SELECT s_suppkey, 'conf/s' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.json' ELSE '.yaml' END AS path FROM supplier)
SELECT 'part:' || p_partkey AS source, 'supplier:' || s_suppkey AS target, 'CONFIGURES' AS kind, 'CROSS_FILE_HEURISTIC' AS tier FROM w JOIN f USING (path)""",
    ),
    "resolve_schema_refs": (
        schema_references,
        """WITH s AS (SELECT p_partkey AS k, '' AS v FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'v' FROM part WHERE p_partkey % 2 = 1), g AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0)
SELECT 'part:' || a.k || a.v AS source, 'part:' || b.k || b.v AS target, 'REFERENCES' AS kind FROM s a JOIN s b ON b.k = a.k + 1 WHERE a.k <> b.k OR a.v <> b.v UNION ALL SELECT 'part:' || a.k, 'part:' || b.k, 'REFERENCES' FROM g a JOIN g b ON b.k = a.k + 2""",
    ),
    "module_resolve": (
        module_resolve,
        """WITH w AS (SELECT s_suppkey % 3 AS dir, s_suppkey % 6 AS spec, s_suppkey % 2 = 0 AS typed FROM supplier), r AS (SELECT ['./g', '../d1/g', './none', 'pkg', '@org/lib/x', 'gone'][spec + 1] AS specifier,
CASE spec WHEN 0 THEN CASE dir WHEN 0 THEN CASE WHEN typed THEN 'app/d0/g.ts' ELSE 'app/d0/g.js' END WHEN 1 THEN CASE WHEN typed THEN 'app/d1/g/index.ts' END ELSE 'app/d2/g.json' END WHEN 1 THEN CASE WHEN typed THEN 'app/d1/g/index.ts' END WHEN 3 THEN CASE dir WHEN 0 THEN 'app/d0/node_modules/pkg/lib/main.js' ELSE 'node_modules/pkg/index.js' END WHEN 4 THEN CASE WHEN dir <> 0 THEN 'node_modules/@org/lib/x.mjs' END END AS target, spec FROM w)
SELECT specifier, target, CASE WHEN target IS NULL THEN 'missing' WHEN spec < 2 THEN 'relative' WHEN spec = 3 THEN 'package' ELSE 'bare' END AS reason, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "import_edges": (import_edges, "SELECT CASE WHEN o_custkey % 3 > 0 THEN 'EXACT_RESOLUTION' ELSE 'UNRESOLVED' END AS tier, o_custkey % 3 > 0 AS resolved, count(*) AS n, count(*) FILTER (o_custkey % 3 > 0) AS targets FROM orders GROUP BY 1, 2"),
    "provider_rank_join": (provider_ranks, "SELECT CAST(l_partkey AS VARCHAR) AS id, CASE l_linenumber % 3 WHEN 0 THEN 'file' ELSE 'symbol' END AS kind, CAST(min(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) AS INT) AS rank FROM lineitem WHERE l_linenumber % 3 < 2 AND l_returnflag IN ('A', 'N') GROUP BY 1, 2"),
    "journal_append": (
        journal_append,
        "WITH j AS (SELECT event_id, epoch_ms(CAST(ts AS TIMESTAMP)) AS ms, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'modify' END AS event_kind, 'a/user:' || user_id AS path FROM events) SELECT 1000 + row_number() OVER (ORDER BY ms, event_id) AS seq, 1000 + row_number() OVER (ORDER BY ms, event_id) AS source_clock, event_kind, path FROM j",
    ),
    "delete_by_owner": (
        delete_by_owner,
        "SELECT l_orderkey || '/' || l_linenumber AS id, 'o' || l_orderkey AS path, l_returnflag AS provider FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND (o_orderkey % 4 = 1 OR o_orderkey % 4 = 0 AND l_returnflag = 'N'))",
    ),
    "apply_events_state": (
        apply_events_state,
        """WITH e AS (SELECT *, o_orderkey % 5 < 4 AS has, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS dg, ['modify', 'delete', 'rename', 'repair', 'modify', 'create'][o_orderkey % 6 + 1] AS kind, o_orderkey % 7 AS clock FROM orders),
n AS (SELECT *, has AND dg = o_orderstatus AND kind IN ('modify', 'create') AS noop FROM e), s AS (SELECT 'o' || o_orderkey AS path, o_orderstatus AS digest, 3 AS applied_clock FROM n WHERE has AND o_orderkey % 2 = 1
UNION ALL SELECT 'o' || o_orderkey || CASE WHEN kind = 'rename' THEN 'n' ELSE '' END, dg, CASE WHEN noop THEN greatest(3, clock) ELSE clock END FROM n WHERE o_orderkey % 2 = 0 AND kind <> 'delete') SELECT digest, CAST(applied_clock AS BIGINT) AS applied_clock, count(*) AS n, min(path) AS least FROM s GROUP BY 1, 2""",
    ),
    "apply_events_facts": (
        apply_events_facts,
        """WITH e AS (SELECT o_orderkey AS k, o_orderkey % 5 < 4 AS has, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END = o_orderstatus AS same, ['modify', 'delete', 'rename', 'repair', 'modify', 'create'][o_orderkey % 6 + 1] AS kind FROM orders WHERE o_orderkey % 2 = 0),
w AS (SELECT k, kind FROM e WHERE NOT (has AND same AND kind IN ('modify', 'create'))), p AS (SELECT l_orderkey AS k, l_orderkey || '/' || l_linenumber AS id, l_returnflag AS provider FROM lineitem),
f AS (SELECT 'o' || p.k AS path, id FROM p LEFT JOIN w ON w.k = p.k WHERE w.k IS NULL OR kind NOT IN ('delete', 'rename') AND provider = 'R' UNION ALL SELECT 'o' || p.k || CASE WHEN kind = 'rename' THEN 'n' ELSE '' END, id || '+' FROM p JOIN w ON w.k = p.k WHERE kind <> 'delete' AND provider <> 'R')
SELECT path, count(*) AS n, min(id) AS least, max(id) AS most FROM f GROUP BY path""",
    ),
    "dependent_repair": (
        dependent_repair,
        """WITH u AS (SELECT DISTINCT 'order:' || l_orderkey AS s, 'part:' || l_partkey AS t FROM lineitem UNION SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem), a AS (SELECT DISTINCT s AS id FROM u WHERE t IN ('supplier:1', 'supplier:2')), b AS (SELECT DISTINCT s AS id FROM u WHERE t IN (SELECT id FROM a)),
r AS (SELECT id, 1 AS depth FROM a UNION ALL SELECT id, 2 FROM b WHERE id NOT IN (SELECT id FROM a)), p AS (SELECT *, row_number() OVER (ORDER BY depth, id) - 1 AS place FROM r) SELECT depth, CASE WHEN place < 500 THEN place // 50 END AS batch, count(*) AS n, min(id) AS least FROM p GROUP BY 1, 2""",
    ),
    "merkle_update": (merkle_update, f"WITH {_CHANGED}, {folders_sql('leaf', 3)} SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3"),
    "reconcile": (
        reconcile,
        """WITH d AS (SELECT doc_id AS i FROM documents), t AS (SELECT i, CASE i % 6 WHEN 1 THEN 'create' WHEN 2 THEN 'delete' WHEN 3 THEN 'modify' END AS kind FROM d WHERE i % 6 IN (1, 2, 3)), ren AS (SELECT i FROM d WHERE i % 12 = 2),
k AS (SELECT kind FROM t WHERE NOT (kind = 'delete' AND i IN (SELECT i FROM ren)) AND NOT (kind = 'create' AND i + 1 IN (SELECT i FROM ren))) SELECT kind AS event_kind, count(*) AS n, CAST(0 AS BIGINT) AS renames FROM k GROUP BY kind UNION ALL SELECT 'rename', count(*), count(*) FROM ren HAVING count(*) > 0""",
    ),
    "telemetry_p95": (barrier, "WITH r AS (SELECT greatest(event_id * 7919 % 1009 - 9, 0) AS ms FROM events ORDER BY event_id DESC LIMIT 256), o AS (SELECT ms, row_number() OVER (ORDER BY ms) AS n, count(*) OVER () AS c FROM r) SELECT CAST(min(ms) AS BIGINT) AS p95 FROM o WHERE n >= ceil(0.95 * c)"),
    "adapters": (
        adapter_fanout,
        """WITH n AS (SELECT n_nationkey AS k FROM nation), st AS (SELECT k + 10 AS p, ['modified', 'untracked', 'deleted', 'odd'][k % 4 + 1] AS s FROM n)
SELECT adapter, id, CAST(score AS DOUBLE) AS score FROM (SELECT 'task-anchor' AS adapter, 'task-anchor:' || x AS id, 1.0 AS score FROM (VALUES ('nation/3:1-40'), ('nation/4:2-9#Supplier#000000004')) t(x) UNION ALL SELECT 'task-anchor', 'task-anchor:' || x, -1 FROM (VALUES ('nation/99'), ('../x')) t(x)
UNION ALL SELECT 'dirty-files', 'dirty-files:nation/' || p, CASE WHEN p NOT IN (SELECT k FROM n) AND s <> 'deleted' THEN -1 ELSE CASE s WHEN 'modified' THEN 0.95 WHEN 'untracked' THEN 0.7 WHEN 'deleted' THEN 0.6 ELSE 0.5 END END FROM st
UNION ALL SELECT 'graph-resolve', 'graph-resolve:nation:' || k, 0.9 FROM n WHERE k IN (3, 4) UNION ALL SELECT 'graph-resolve', 'graph-resolve:supplier:' || s_suppkey, CASE s_suppkey WHEN 4 THEN 0.97 ELSE 0.85 END FROM supplier WHERE s_suppkey IN (4, 7)
UNION ALL SELECT 'graph-resolve', 'graph-resolve:file:' || x, -1 FROM (VALUES ('nation/99'), ('../x')) t(x) UNION ALL SELECT 'rules-documents', 'rules-documents:' || x, s FROM (VALUES ('AGENTS.md', 0.85), ('a/AGENTS.md', 0.55), ('.own/rules/nation.md', 0.7)) t(x, s)
UNION ALL SELECT 'live-overlay', 'live-overlay:nation/' || k, CASE WHEN k % 3 = 1 THEN 0.9 ELSE 0.85 END FROM n WHERE k % 3 = 1 OR k % 3 = 0 AND k > 10)""",
    ),
    "trim_to_symbol": (
        trim_to_symbol,
        f"""WITH {SQL_LINES}, t AS (SELECT doc_id, line, CASE WHEN line % 5 = 2 THEN text || ' {{' WHEN line % 7 = 0 THEN text || '; ' ELSE translate(text, '{{}};', '') END AS text FROM l), z AS (SELECT doc_id, max(line) AS most FROM t GROUP BY 1), s AS (SELECT doc_id, least(4, most) AS lo, greatest(least(4, most), least(6, most)) AS hi FROM z),
b AS (SELECT s.doc_id, lo, hi, max(line) FILTER (contains(text, '{{') AND line <= lo) AS o, min(line) FILTER ((contains(text, '}}') OR ends_with(rtrim(text), ';')) AND line >= hi) AS c FROM s JOIN t USING (doc_id) GROUP BY ALL), e AS (SELECT doc_id, coalesce(o, lo) AS f, coalesce(c, hi) AS u FROM b),
k AS (SELECT doc_id, f, u, line, strlen(text) + 1 AS size, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS used FROM e JOIN t USING (doc_id) WHERE line BETWEEN f AND u)
SELECT CAST(doc_id AS VARCHAR) AS path, f::INT AS from_line, u::INT AS to_line, CAST(max(line) FILTER (used <= 400) AS INT) AS kept_to, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(max(used) FILTER (used <= 400), 0) AS BIGINT) AS kept_bytes, coalesce(max(used) FILTER (used <= 400), 0) < sum(size) AS truncated FROM k GROUP BY doc_id, f, u""",
    ),
    "qualify_task": (
        qualify,
        """WITH e AS (SELECT DISTINCT l_orderkey AS task, l_orderkey % 2 = 0 AS sd, 'p' || l_partkey AS path, l_linenumber AS s, l_linenumber + 3 AS e, l_returnflag AS h FROM lineitem), a AS (SELECT DISTINCT task, CASE WHEN s % 2 = 0 THEN path ELSE 'root/' || path END AS path, CASE WHEN s = 3 THEN 1 ELSE s END AS s, e, CASE WHEN s = 4 THEN '?' ELSE h END AS h FROM e WHERE s <> 2),
m AS (SELECT e.*, EXISTS (SELECT 1 FROM a WHERE a.task = e.task AND a.h = e.h AND (a.path = e.path OR a.path = 'root/' || e.path) AND CASE WHEN sd THEN a.s = e.s AND a.e = e.e ELSE a.s <= e.s AND a.e >= e.e END) AS met FROM e), t AS (SELECT task, sd, count(*) FILTER (NOT met) AS missing FROM m GROUP BY 1, 2)
SELECT CASE WHEN sd THEN 'symbol_definition' ELSE 'reference' END AS kind, CASE WHEN missing = 0 THEN 'passed' ELSE 'failed' END AS state, count(*) AS tasks, CAST(sum(missing) AS BIGINT) AS missing FROM t GROUP BY 1, 2""",
    ),
    "vector_upsert": (
        vector_upsert,
        """WITH x AS (SELECT vec_id * 3 + n AS seq, vec_id + 5 * n AS id, CASE WHEN vec_id % 2 = 0 THEN 'm2' ELSE 'unknown' END AS model FROM embeddings, (SELECT unnest([0, 1]) AS n) WHERE vec_id % 11 > 0 AND vec_id % 13 > 0), y AS (SELECT id, arg_max(model, seq) AS model, 60 AS dim FROM x GROUP BY id), z AS (SELECT * FROM y UNION ALL SELECT vec_id, 'm1', len(embedding) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM y))
SELECT model, CAST(dim AS INT) AS dim, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM z GROUP BY 1, 2""",
    ),
    "vector_scan": (vector_scan, "SELECT count(*) AS scanned, count(*) FILTER (vec_id % 7 = 0) AS dim_mismatches FROM embeddings WHERE vec_id % 2 = 0"),
    "text_helpers": (
        text_helpers,
        r"""WITH c AS (SELECT role, turn, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM conversations), k AS (SELECT *, len(list_filter(w, lambda x: x NOT IN ('add', 'build', 'check', 'create', 'fix', 'implement', 'make', 'test', 'update', 'use'))) AS n FROM c)
SELECT role, CAST(sum(CASE WHEN n > 0 THEN n ELSE len(w) END) AS BIGINT) AS words, CAST(sum(contains(lower(text), 'the')::INT + contains(lower(text), 'error')::INT + contains(lower(text), 'license')::INT) AS BIGINT) AS hits, CAST(sum(length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))) AS BIGINT) AS chars,
CAST(count(*) FILTER (turn % 3 = 0) AS BIGINT) AS documents, CAST(count(*) FILTER (turn % 3 = 1) AS BIGINT) AS code, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS prefix, CAST(count(*) FILTER (turn = 1) AS BIGINT) AS glob FROM k GROUP BY role""",
    ),
}
