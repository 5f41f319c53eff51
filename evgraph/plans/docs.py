"""Queries of documents, claims and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.functions import text as X
from evgraph.operators import documents, policy, resolve
from evgraph.sources import tables

SQL_LINES = "u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), l AS (SELECT doc_id, CAST(line AS INTEGER) AS line, text FROM u)"
_STATUS = X.STATUS.removeprefix("(?i)")
_LICENSE = r"(?i)licensed under the (.+?)(\.|$)"


def doc_lines(spark, d):
    return tables.doc_lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("text")).alias("longest"), F.sum((F.trim("text") == "").cast("bigint")).alias("blank"))


def structure(spark, d):
    """Fences and headings: here a line of license text stands for a heading, one that begins with a vowel for none."""
    lines = tables.doc_lines(spark, d).withColumn("text", F.when(F.col("text").rlike("(?i)license"), F.concat(F.lit("# "), "text")).when(F.col("text").rlike("^[EI]"), F.concat(F.lit("```"), "text")).otherwise(F.col("text")))
    return documents.structure(lines).groupBy("doc_id").agg(F.sum(F.col("in_fence").cast("bigint")).alias("fenced"), F.max("heading").alias("heading"), F.count("heading").alias("under"))


def claims(spark, d):
    """Lines of license text as claims, with the status their words give."""
    lines = tables.doc_lines(spark, d).where(F.col("text").rlike("(?i)licen[sc]e")).withColumn("text", F.concat("text", F.element_at(F.array(F.lit(" is implemented"), F.lit(" is planned"), F.lit(" is partial"), F.lit(" is stale")), (F.col("doc_id") % 4 + 1).cast("int"))))
    return documents.claims(lines).select("doc_id", "line", "status")


def comment_claims(spark, d):
    mark = F.element_at(F.array(F.lit("TODO(ann): "), F.lit("NOTE: "), F.lit("// owner = "), F.lit("deprecated: "), F.lit("plain ")), (F.col("doc_id") % 5 + 1).cast("int"))
    lines = tables.doc_lines(spark, d).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "line", F.concat(mark, "text").alias("text"))
    return documents.comment_claims(lines).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("owners"))


def doc_code_join(spark, d):
    """Labelled documents as claims; pages whose number they share are the code they name."""
    labels = tables.read(spark, d, "labels").select("doc_id", F.lit(1).alias("line"), F.when(F.col("toxic") == 1, "stale").when(F.col("quality") == 1, "implemented").otherwise("claim").alias("status"), F.lit("current").alias("lifecycle"))
    refs = tables.read(spark, d, "labels").select("doc_id", F.concat(F.lit("page/"), (F.col("doc_id") % 300).cast("string")).alias("path"))
    files = tables.read(spark, d, "pages").where("url like 'https:%'").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.concat(F.lit("file:"), F.col("page_id").cast("string")).alias("node"))
    symbols = tables.read(spark, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("page_id").alias("ordinal"), F.concat(F.lit("symbol:"), F.col("page_id").cast("string")).alias("node"))
    return documents.classify_join(documents.doc_code_join(labels, refs, files, symbols)).select("doc_id", "path", "node", "kind", "confidence")


def claim_slice(spark, d):
    claim = tables.read(spark, d, "labels").select("doc_id", "quality")
    edges = tables.read(spark, d, "conversations").select((F.col("conv_id") % 400).alias("doc_id"), F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("target"), F.col("role").alias("kind"))
    got = documents.claim_slice(claim, edges.distinct(), "doc_id")
    return got.select("doc_id", "quality", F.array_join(F.transform("edges", lambda e: F.concat(e["target"], F.lit("/"), e["kind"])), ",").alias("edges"))


def phase2_plan(spark, d):
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    now = docs.select("id", F.when(F.col("id") % 11 != 0, F.sha2("text", 256)).alias("fingerprint"))
    before = tables.read(spark, d, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("id"), "text").select("id", F.sha2(F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("fingerprint"))
    return documents.verify_plan(now, before)


def resolve_imports(spark, d):
    """Each distinct link of a page to the first of its candidate pages: the path as it is, or in a folder."""
    links = tables.read(spark, d, "pages").select("page_id", F.explode(F.expr(r"""regexp_extract_all(html, 'href="(/[^"]*)"', 1)""")).alias("spec")).distinct()
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(/[^?#]*)", 1)
    files = tables.read(spark, d, "pages").select(F.regexp_replace(path, r"^/[a-z]+", "").alias("path")).where("path <> ''").unionByName(tables.read(spark, d, "part").select(F.concat(F.lit("/"), F.col("p_partkey").cast("string")).alias("path")))
    wanted = links.withColumn("candidates", F.array("spec", F.concat("spec", F.lit("/")), F.concat(F.lit("/"), (F.col("page_id") % 400).cast("string"))))
    return resolve.first_existing(wanted, files, ["page_id", "spec"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count("target").alias("resolved"), F.min("target").alias("least"))


def resolve_calls(spark, d):
    """Part types as call names: parts of a brand and a number are a file, which imports that of the number's first brand."""
    part = tables.read(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("name"), F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 50).cast("string")).alias("path"), (F.col("p_size") % 10 == 0).alias("is_test"), "p_partkey")
    calls = part.select(F.col("id").alias("source"), "path", "name", "is_test")
    brands = part.select("path").distinct()
    imports = brands.select("path", F.concat(F.lit("Brand#"), F.substring("path", 7, 1), F.lit("1/"), F.substring_index("path", "/", -1)).alias("target_path"))
    return resolve.calls(calls, part.select("id", "name", "path"), imports)


def resolve_suffix(spark, d):
    files = tables.nodes(spark, d, ("customer", "part")).select(F.concat(F.lit("root/"), "path").alias("path"))
    wanted = tables.read(spark, d, "supplier").select(F.concat(F.lit("part/"), F.col("s_suppkey").cast("string")).alias("suffix"))
    return resolve.by_suffix(wanted, files)


def augment_union(spark, d):
    base = tables.nodes(spark, d, ("nation", "region")).select("id", "name")
    extra = tables.nodes(spark, d, ("nation", "supplier")).select("id", F.upper("name").alias("name"))
    return resolve.union_layer(base, extra)


def first_wins(spark, d):
    rows = tables.read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return resolve.first_wins(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


def evidence_fresh(spark, d):
    ev = tables.read(spark, d, "orders").select(tables.node_id("customer", "o_custkey").alias("id"), F.col("o_orderstatus").alias("content_hash"), F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("path"))
    files = tables.read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("content_hash")).select(F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("path"), "content_hash")
    return resolve.evidence_fresh(ev, files)


def missing_provider(spark, d):
    return tables.read(spark, d, "customer").join(tables.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def file_metadata(spark, d):
    last = tables.read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("modified"), F.count(F.lit(1)).alias("n"))
    return tables.read(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("modified").cast("date").cast("string").alias("modified"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def membership(spark, d):
    chosen = tables.read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return tables.read(spark, d, "customer").join(chosen, "c_nationkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def call_names(spark, d):
    names = F.array_distinct(F.expr(r"regexp_extract_all(html, '(?:\\.|\\b)(\\w+)\\s*\\(', 1)"))
    return tables.read(spark, d, "pages").select("page_id", F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("pages"))


def findings_left(spark, d):
    """Findings that are neither in the baseline nor covered by a valid exception."""
    found = policy.evaluate(tables.edges(spark, d), policy.RULES)
    base = found.where(F.substring("fingerprint", 1, 1) < "8").select("fingerprint")
    left = policy.suppressed(policy.changed_slice(found, base), [{"rule": "parts-use-few", "scope": "part:1", "owner": "a", "reason": "b", "expires": "2999-01-01"}, {"rule": "no-order-to-customer", "scope": "global", "owner": "a", "reason": "", "expires": "2999-01-01"}], "2026-01-01")
    return left.select("rule", "source", "target")


from evgraph.plans.graph import QUERIES as _GRAPH  # noqa: E402

_RULES_SQL = _GRAPH["rules_violations"][1]

QUERIES = {
    "doc_lines": (doc_lines, f"WITH {SQL_LINES} SELECT doc_id, count(*) AS lines, CAST(max(length(text)) AS INTEGER) AS longest, CAST(count(*) FILTER (trim(text) = '') AS BIGINT) AS blank FROM l GROUP BY doc_id"),
    "doc_structure": (
        structure,
        f"""WITH {SQL_LINES}, m AS (SELECT doc_id, line, CASE WHEN regexp_matches(text, '(?i)license') THEN '# ' || text WHEN regexp_matches(text, '^[EI]') THEN '```' || text ELSE text END AS text FROM l),
f AS (SELECT *, starts_with(trim(text), '```') AS mark, sum(starts_with(trim(text), '```')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM m), g AS (SELECT *, n % 2 = 1 OR mark AS fenced FROM f),
h AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(text, '^#{{1,6}}\\s+\\S') THEN regexp_replace(text, '^#{{1,6}}\\s+', '') END AS hd FROM g),
k AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM h)
SELECT doc_id, CAST(count(*) FILTER (fenced) AS BIGINT) AS fenced, max(heading) AS heading, count(heading) AS under FROM k GROUP BY doc_id""",
    ),
    "classify_status": (
        claims,
        f"""WITH {SQL_LINES}, m AS (SELECT doc_id, line, text || [' is implemented', ' is planned', ' is partial', ' is stale'][doc_id % 4 + 1] AS text FROM l WHERE regexp_matches(text, '(?i)licen[sc]e'))
SELECT doc_id, line, CASE doc_id % 4 WHEN 0 THEN CASE WHEN regexp_matches(lower(text), 'missing|pending|planned|gap') THEN 'planned' WHEN regexp_matches(lower(text), 'partial|drift') THEN 'partial' WHEN regexp_matches(lower(text), 'stale|contradict') THEN 'stale' ELSE 'implemented' END
WHEN 1 THEN 'planned' WHEN 2 THEN CASE WHEN regexp_matches(lower(text), 'missing|pending|planned|gap') THEN 'planned' ELSE 'partial' END ELSE CASE WHEN regexp_matches(lower(text), 'missing|pending|planned|gap') THEN 'planned' WHEN regexp_matches(lower(text), 'partial|drift') THEN 'partial' ELSE 'stale' END END AS status
FROM m WHERE NOT starts_with(trim(text), '>') AND length(trim(text)) >= 12 AND NOT regexp_matches(trim(text), '(?i)^(expected:|run:|assert!?|//|let\\s|const\\s|fn\\s|pub\\s|use\\s|import\\s)')""",
    ),
    "comment_claims": (
        comment_claims,
        f"""WITH {SQL_LINES}, k AS (SELECT doc_id % 5 AS m, trim(text) AS t FROM l WHERE doc_id % 5 = 3 OR trim(text) <> '')
SELECT 'TODO' AS kind, count(*) AS n, CAST(1 AS BIGINT) AS owners FROM k WHERE m = 0 UNION ALL SELECT 'NOTE', count(*), CAST(0 AS BIGINT) FROM k WHERE m = 1
UNION ALL SELECT 'OWNER', count(*), count(DISTINCT t) FROM k WHERE m = 2 UNION ALL SELECT 'DEPRECATED', count(*), count(DISTINCT nullif(t, '')) FROM k WHERE m = 3""",
    ),
    "doc_code_join": (
        doc_code_join,
        """WITH c AS (SELECT doc_id, doc_id % 300 AS p, CASE WHEN toxic = 1 THEN 'contradicts' WHEN quality = 1 THEN 'supports' END AS kind FROM labels), x AS (SELECT doc_id, 'page/' || p AS path, CASE WHEN url LIKE 'https:%' THEN 'file:' || page_id WHEN page_id IS NOT NULL THEN 'symbol:' || page_id END AS node, kind FROM c LEFT JOIN pages ON page_id = p)
SELECT *, CAST(0.85 AS DOUBLE) AS confidence FROM x WHERE kind = 'contradicts' OR kind = 'supports' AND node IS NOT NULL""",
    ),
    "claim_slice": (
        claim_slice,
        """WITH e AS (SELECT DISTINCT conv_id % 400 AS doc_id, 'turn:' || turn AS target, role AS kind FROM conversations), g AS (SELECT doc_id, string_agg(target || '/' || kind, ',' ORDER BY target, kind) AS edges FROM e GROUP BY doc_id)
SELECT doc_id, quality, coalesce(edges, '') AS edges FROM labels LEFT JOIN g USING (doc_id)""",
    ),
    "phase2_plan": (
        phase2_plan,
        """SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 OR lang = 'fr' OR doc_id % 7 = 0 THEN 'verify' ELSE 'reuse' END AS action,
CASE WHEN doc_id % 11 = 0 THEN 'missing_input' WHEN lang = 'fr' THEN 'cold_start' WHEN doc_id % 7 = 0 THEN 'input_changed' END AS reason FROM documents""",
    ),
    "resolve_imports": (
        resolve_imports,
        r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS spec FROM pages), f AS (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '^/[a-z]+', '') AS path FROM pages UNION SELECT '/' || p_partkey FROM part),
c AS (SELECT page_id, spec, 0 AS pos, spec AS path FROM l UNION ALL SELECT page_id, spec, 1, spec || '/' FROM l UNION ALL SELECT page_id, spec, 2, '/' || (page_id % 400) FROM l),
h AS (SELECT page_id, spec, arg_min(path, pos) AS target FROM c WHERE path <> '' AND path IN (SELECT path FROM f) GROUP BY 1, 2)
SELECT page_id, count(*) AS links, count(target) AS resolved, min(target) AS least FROM l LEFT JOIN h USING (page_id, spec) GROUP BY page_id""",
    ),
    "resolve_calls": (
        resolve_calls,
        """WITH p AS (SELECT 'part:' || p_partkey AS id, p_type AS name, p_brand || '/' || (p_partkey % 50) AS path, p_size % 10 = 0 AS is_test, p_partkey FROM part),
c AS (SELECT a.id AS source, a.name, a.is_test, b.id AS target, CASE WHEN a.path = b.path THEN 0 WHEN b.path = 'Brand#' || substr(a.path, 7, 1) || '1/' || split_part(a.path, '/', 2) THEN 1 ELSE 2 END AS level FROM p a JOIN p b ON a.name = b.name AND a.id <> b.id),
w AS (SELECT *, min(level) OVER x AS best, count(*) OVER x AS n FROM c WINDOW x AS (PARTITION BY source, name)),
r AS (SELECT DISTINCT source, name, CASE WHEN best < 2 OR n = 1 THEN target END AS target, CASE WHEN is_test THEN 'TESTS' ELSE 'CALLS' END AS kind, CASE WHEN best = 0 THEN 'SAME_FILE_LEXICAL' WHEN best = 1 OR n = 1 THEN 'CROSS_FILE_HEURISTIC' ELSE 'UNRESOLVED' END AS tier FROM w WHERE level = best)
SELECT source, name, target, kind, tier FROM r""",
    ),
    "resolve_suffix": (resolve_suffix, "SELECT DISTINCT 'part/' || s_suppkey AS suffix, CASE WHEN p_partkey IS NOT NULL THEN 'root/part/' || p_partkey END AS target FROM supplier LEFT JOIN part ON p_partkey = s_suppkey"),
    "augment_union": (
        augment_union,
        "SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region UNION ALL SELECT 'supplier:' || s_suppkey, upper(s_name) FROM supplier",
    ),
    "dedupe_first_wins": (
        first_wins,
        "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    ),
    "evidence_fresh": (evidence_fresh, "SELECT 'customer:' || o_custkey AS id, min(o_orderstatus) = max(o_orderstatus) AS fresh FROM orders GROUP BY o_custkey"),
    "missing_provider": (missing_provider, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "file_metadata_join": (file_metadata, "SELECT c_custkey, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS modified, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "membership_semi": (membership, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1"),
    "call_names": (call_names, r"WITH n AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?:\.|\b)(\w+)\s*\(', 1)) AS name FROM pages) SELECT name, count(*) AS pages FROM n GROUP BY name"),
    "findings_left": (
        findings_left,
        f"SELECT rule, source, target FROM ({_RULES_SQL}) WHERE substr(fingerprint, 1, 1) >= '8' AND NOT (rule = 'parts-use-few' AND starts_with(source, 'part:1'))",
    ),
}
