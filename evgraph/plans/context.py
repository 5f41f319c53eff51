"""Queries of task context and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.operators import context
from evgraph.plans.graph import SQL_EDGES, SQL_NODES
from evgraph.sources import tables


def _code(spark, d):
    """Conversation turns as lines of code, the first words by turns."""
    head = F.element_at(F.array(F.lit("function f"), F.lit("class C"), F.lit("import x"), F.lit("// note"), F.lit("run("), F.lit("plain ")), (F.col("turn") % 6 + 1).cast("int"))
    return tables.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("line"), F.concat(head, F.regexp_replace("text", r"[\n(]", " ")).alias("text"), "role")


def code_lines(spark, d):
    return _code(spark, d).groupBy(context.line_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def diverse_evidence(spark, d):
    """The turns' lines as those of four files; the evidence of each role."""
    place = (F.col("path").cast("long") * 50 + F.col("line")).cast("int")
    code = _code(spark, d).select(F.concat(F.lit("p"), (F.col("path").cast("long") % 4).cast("string")).alias("path"), place.alias("line"), "text", "role")
    rows = context.evidence(code, ["the", "function", "class"]).select("role", "path", "line", "kind", "score")
    return context.diverse(rows, "role", 12)


def chunk_lines(spark, d):
    lines = tables.doc_lines(spark, d).select(F.col("doc_id").cast("string").alias("path"), "line", "text")
    spans = lines.groupBy("path").agg(F.lit(1).alias("start"), F.max("line").alias("end"))
    return context.chunk(lines, spans, 2000).select("path", "end", "kept_end", "bytes", "kept_bytes")


def understanding_queue(spark, d):
    """Suppliers as files: nations' customers name them, and shared parts are the edges that cross."""
    files = tables.nodes(spark, d, ("supplier",)).select(F.col("id").alias("path"))
    refs = tables.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(tables.node_id("supplier", "l_suppkey").alias("path"))
    e = tables.use_edges(spark, d, ("part-supplier",)).select("source", "target")
    return context.anchors(files, refs, e)


def diagnostics(spark, d):
    nodes = tables.nodes(spark, d, ("region", "nation", "customer", "order", "part"))
    return context.diagnose(nodes, tables.edges(spark, d)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def repo_identity(spark, d):
    key = F.col("s_suppkey").cast("string")
    form = F.element_at(F.array(F.concat(F.lit("git@h.org:team/r"), key, F.lit(".git")), F.concat(F.lit("https://h.org/a/b/r"), key), F.concat(F.lit("/local/r"), key), F.concat(F.lit("ssh://git@h.org/team/r"), key, F.lit(".git"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return tables.read(spark, d, "supplier").select("s_suppkey", context.origin(form).alias("o")).select("s_suppkey", "o.host", "o.owner", "o.repo")


def source_fanout(spark, d):
    sources = {
        "anchors": lambda: tables.nodes(spark, d, ("nation",)).select("id", F.lit(1.0).alias("score")),
        "broken": lambda: spark.read.parquet(f"{d}/no-such-table.parquet"),
        "graph": lambda: tables.nodes(spark, d, ("nation", "region")).select("id", F.lit(0.9).alias("score")),
    }
    return context.fan_out(sources, ["id"])[0].select("id", "score", "source")


def retrieval_summary(spark, d):
    """Customers as cases: those with orders have gold, those of a low balance abstain."""
    first = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min((F.col("o_orderkey") % 10) + 1).alias("rank"))
    rows = tables.read(spark, d, "customer").join(first, "c_custkey", "left").withColumn("has_gold", F.col("rank").isNotNull()).withColumn("abstained", F.col("c_acctbal") < 0)
    hit = F.col("has_gold") & ~F.col("abstained") & (F.col("rank") <= 3)
    cases = rows.select("c_mktsegment", "has_gold", "abstained", F.coalesce(hit, F.lit(False)).alias("hit"), F.when(hit, 1 / F.col("rank")).otherwise(0.0).alias("rr"))
    return context.summary(cases, "c_mktsegment")


QUERIES = {
    "classify_code_line": (
        code_lines,
        """WITH k AS (SELECT ['function', 'class', 'reference', NULL, 'call-site', NULL][turn % 6 + 1] AS kind FROM conversations) SELECT kind, count(*) AS n FROM k GROUP BY kind""",
    ),
    "diverse_evidence": (
        diverse_evidence,
        r"""WITH RECURSIVE l AS (SELECT role, 'p' || (conv_id % 4) AS path, CAST(conv_id * 50 + turn + 1 AS INT) AS line, turn % 6 + 1 AS k, ['function f', 'class C', 'import x', '// note', 'run(', 'plain '][turn % 6 + 1] || regexp_replace(text, '[\n(]', ' ', 'g') AS t FROM conversations),
h AS (SELECT *, ['function', 'class', 'reference', NULL, 'call-site', NULL][k] AS kind, lower(t || ' ' || path) AS low, trim(regexp_replace(lower(t || ' ' || path), '[^a-z0-9]+', ' ', 'g')) AS norm, regexp_replace(trim(t), '\s+', ' ', 'g') AS c FROM l),
e AS (SELECT role, path, line, kind, [60, 50, 25, 0, 55, 0][k] + contains(low, 'the')::INT + 3 * contains(low, 'function')::INT + contains(low, 'class')::INT + 8 * contains(norm, 'the function class')::INT + 3 * contains(norm, 'the function')::INT + 3 * contains(norm, 'function class')::INT AS score,
  CASE WHEN length(c) <= 220 THEN c ELSE regexp_replace(substr(c, 1, 217), '\s+\S*$', '') || '...' END AS text FROM h WHERE kind IS NOT NULL AND (contains(low, 'the') OR contains(low, 'function') OR contains(low, 'class'))),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY line) AS n FROM e) WHERE n = 1),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, path, line) AS rn, row_number() OVER (PARTITION BY role, path ORDER BY score DESC, line) AS pn, row_number() OVER (PARTITION BY role, kind ORDER BY score DESC, path, line) AS kn FROM f),
u AS (SELECT role, rn, 1 AS phase, rn AS key FROM s WHERE pn = 1 UNION ALL SELECT role, rn, 2, list_position(['module', 'type', 'class', 'constant', 'function', 'call-site', 'config', 'test', 'reference'], kind) FROM s WHERE kn = 1 UNION ALL SELECT role, rn, 3, rn FROM s),
q AS MATERIALIZED (SELECT u.role, u.phase, s.rn, s.kind, s.path, row_number() OVER (PARTITION BY u.role ORDER BY u.phase, u.key) AS pos FROM u JOIN s ON s.role = u.role AND s.rn = u.rn),
fold(role, pos, ids, kinds, paths) AS (SELECT DISTINCT role, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM s UNION ALL
  SELECT role, pos, CASE WHEN ok THEN list_append(ids, rn) ELSE ids END, CASE WHEN ok THEN list_append(kinds, kind) ELSE kinds END, CASE WHEN ok THEN list_append(paths, path) ELSE paths END FROM (
    SELECT q.role, q.pos, q.rn, q.kind, q.path, f.ids, f.kinds, f.paths, len(f.ids) < 12 AND NOT list_contains(f.ids, q.rn) AND (q.phase < 3 OR len(list_filter(f.kinds, lambda x: x = q.kind)) < 4 AND len(list_filter(f.paths, lambda x: x = q.path)) < 5) AS ok FROM fold f JOIN q ON q.role = f.role AND q.pos = f.pos + 1)),
z AS (SELECT role, arg_max(ids, pos) AS ids FROM fold GROUP BY role) SELECT s.role, s.path, s.line, s.kind, s.score FROM s JOIN z ON z.role = s.role AND list_contains(z.ids, s.rn)""",
    ),
    "chunk_by_syntax": (
        chunk_lines,
        """WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), s AS (SELECT doc_id, line, strlen(t) + 1 AS size, sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS used FROM u)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(max(line) AS INTEGER) AS "end", CAST(max(line) FILTER (used <= 2000) AS INTEGER) AS kept_end, CAST(sum(size) AS BIGINT) AS bytes, CAST(max(used) FILTER (used <= 2000) AS BIGINT) AS kept_bytes FROM s GROUP BY doc_id""",
    ),
    "understanding_queue": (
        understanding_queue,
        """WITH r AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), e AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT 'supplier:' || s_suppkey AS path, coalesce(r.n, 0) AS claim_links, coalesce(e.n, 0) AS degree FROM supplier LEFT JOIN r ON r.l_suppkey = s_suppkey LEFT JOIN e ON e.l_suppkey = s_suppkey ORDER BY claim_links DESC, degree DESC, path LIMIT 15""",
    ),
    "diagnostics": (
        diagnostics,
        f"""WITH {SQL_NODES}, {SQL_EDGES}, n AS (SELECT id FROM nodes WHERE kind <> 'supplier'), p AS (SELECT DISTINCT 'missing_source' AS problem, source AS id FROM edges WHERE source NOT IN (SELECT id FROM n) UNION SELECT 'missing_target', target FROM edges WHERE target NOT IN (SELECT id FROM n)) SELECT problem, count(*) AS n, min(id) AS first FROM p GROUP BY problem""",
    ),
    "repo_identity": (
        repo_identity,
        """SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 2 THEN 'h.org' END AS host, CASE s_suppkey % 4 WHEN 0 THEN 'team' WHEN 1 THEN 'a/b' WHEN 3 THEN 'team' END AS owner, CASE WHEN s_suppkey % 4 <> 2 THEN 'r' || s_suppkey END AS repo FROM supplier""",
    ),
    "source_fanout": (
        source_fanout,
        "SELECT 'nation:' || n_nationkey AS id, CAST(1.0 AS DOUBLE) AS score, 'anchors' AS source FROM nation UNION ALL SELECT 'region:' || r_regionkey, 0.9, 'graph' FROM region",
    ),
    "retrieval_summary": (
        retrieval_summary,
        """WITH o AS (SELECT o_custkey, min(o_orderkey % 10 + 1) AS rank FROM orders GROUP BY 1), c AS (SELECT c_mktsegment, rank IS NOT NULL AS gold, c_acctbal < 0 AS ab, coalesce(rank IS NOT NULL AND c_acctbal >= 0 AND rank <= 3, false) AS hit, rank FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) AS total, round(avg(hit::INT), 6) AS hit_rate, round(avg(CASE WHEN hit THEN 1.0 / rank ELSE 0 END), 6) AS mrr, CAST(count(*) FILTER (ab AND NOT gold) AS BIGINT) AS abstained_rightly, CAST(count(*) FILTER (ab AND gold) AS BIGINT) AS abstained_wrongly, CAST(count(*) FILTER (NOT ab AND NOT gold) AS BIGINT) AS junk FROM c GROUP BY 1""",
    ),
}
