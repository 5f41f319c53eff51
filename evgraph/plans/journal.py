"""Queries of the journal, ledgers, deltas and generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.operators import policy
from evgraph.plans.graph import SQL_EDGES
from evgraph.sources import tables
from evgraph.sources.store import dense_ordinals, federate
from evgraph.streaming import journal as J

SQL_J = "j AS (SELECT event_id AS seq, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS observed_ms, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'modify' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' END AS event_kind, 'user:' || user_id AS path FROM events)"


SQL_FOLDER = "sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part || ':' || digest))"


def folders_sql(leaves: str, levels: int) -> str:
    """CTEs f1 ... of folders (path, digest), from ``leaves`` (path, digest), a level at a time."""
    out, below = [], leaves
    for i in range(1, levels + 1):
        up = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
        out.append(f"k{i} AS (SELECT {up} AS parent, substr(sha256(split_part(path, '/', -1)), 1, 2) AS part, split_part(path, '/', -1) || ':' || digest AS child FROM {below})")
        out.append(f"p{i} AS (SELECT parent, part, sha256(string_agg(child, chr(10) ORDER BY child)) AS digest FROM k{i} GROUP BY 1, 2)")
        out.append(f"f{i} AS MATERIALIZED (SELECT parent AS path, {SQL_FOLDER} AS digest FROM p{i} GROUP BY 1)")
        below = f"f{i}"
    return ", ".join(out)


def _before_after(spark, d):
    docs = tables.read(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), "lang", "n_chars")
    before = docs.where("lang <> 'fr'").select("path", F.when(F.col("lang") == "de", F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    now = docs.where("lang <> 'es'").select("path", "digest")
    return before, now


def metadata_diff(spark, d):
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"), "lang")
    before = docs.where("lang <> 'fr'").withColumn("size", F.when(F.col("lang") == "de", F.col("size") + 1).otherwise(F.col("size")))
    return J.metadata_diff(before, docs.where("lang <> 'es'")).groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"))


def rename_pairs(spark, d):
    rows = tables.journal(spark, d).withColumn("name", F.substring_index("path", ":", -1))
    return J.rename_pairs(rows, 86_400_000).select("name", "deleted", "created")


def merkle_root(spark, d):
    leaves = tables.read(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"))
    return J.merkle(leaves, 3)


def apply_delta(spark, d):
    """Orders of one priority change: their facts are replaced, all others stay."""
    facts = tables.read(spark, d, "orders").select(F.col("o_orderpriority").alias("path"), "o_orderkey", "o_orderstatus")
    changed = facts.select("path").where("path like '1%'").distinct()
    new = facts.where("path like '1%' and o_orderstatus <> 'F'").withColumn("o_orderstatus", F.lit("N"))
    return J.apply_delta(facts, new, changed).groupBy("path", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def unresolve(spark, d):
    gone = tables.nodes(spark, d, ("nation",)).where("name like '%A'").select("id")
    return J.unresolve(tables.edges(spark, d), gone).groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("targets"))


def freshness_ladder(spark, d):
    kinds = tables.read(spark, d, "events").groupBy("user_id").agg(F.max((F.col("event_type") == "signup").cast("int")).alias("w"), F.max((F.col("event_type") == "error").cast("int")).alias("g"), F.sum((F.col("event_type") == "purchase").cast("bigint")).alias("pending"))
    state = kinds.select(F.col("user_id").alias("repo"), (F.col("w") == 1).alias("watched"), (F.col("g") == 1).alias("gap"), "pending")
    return J.freshness(state).groupBy("freshness").agg(F.count(F.lit(1)).alias("n"))


def federated(spark, d):
    rows = tables.read(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    parts = {f: rows.where(F.col("l_returnflag") == f).withColumn("generation_id", F.lit(f"g{f}")) for f in ("A", "N", "R")}
    return federate(parts).groupBy("repo", "generation_id").agg(F.count(F.lit(1)).alias("n"))


def run_ledger(spark, d):
    """Conversations as chains of runs: each turn names the digest of the one before; where that is so."""
    rows = tables.read(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.sha2(F.concat_ws("|", "conv_id", "turn", "text"), 256).alias("digest"))
    before = rows.select("conv_id", (F.col("seq") + 1).alias("seq"), F.col("digest").alias("previous"))
    links = rows.join(before, ["conv_id", "seq"], "left")
    return policy.chain_ok(links, ["conv_id"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("links"), F.bool_and("ok").alias("ok"))


def ordinals(spark, d):
    n = tables.nodes(spark, d, ("region", "nation", "supplier", "customer")).withColumn("provider", F.when(F.col("kind") == "customer", "treesitter").otherwise("lexical"))
    ranks = spark.createDataFrame([("lexical", 0), ("treesitter", 1)], "provider string, rank int")
    return dense_ordinals(n, ranks).select("id", F.col("ordinal").cast("bigint").alias("ordinal"))


def stream_coalesce(spark, d):
    """The journal drained as a stream; what is left is the last event of each path."""
    import uuid

    from evgraph.session import cut

    cut(spark.range(1))  # so that the shared folder is known
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/journal-{uuid.uuid4().hex}"
    rows = tables.journal(spark, d)
    rows.write.parquet(f"{base}/in")
    J.drain(J.stream(spark, f"{base}/in", rows.schema), f"{base}/store", f"{base}/state")
    return J.drained(spark, f"{base}/store").select("path", "seq", "event_kind")


_LAST = f"WITH {SQL_J}, w AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n FROM j)"
QUERIES = {
    "latest_per_path": (lambda s, d: J.latest_per_path(tables.journal(s, d)).select("seq", "path", "applied"), f"{_LAST} SELECT seq, path, CASE WHEN n = 1 THEN 1 ELSE 2 END AS applied FROM w"),
    "journal_coalesce": (
        lambda s, d: J.coalesce(tables.journal(s, d)).select("path", "seq", "event_kind", "events"),
        f"WITH {SQL_J} SELECT path, max(seq) AS seq, arg_max(event_kind, seq) AS event_kind, count(*) AS events FROM j GROUP BY path",
    ),
    "stream_coalesce": (stream_coalesce, f"WITH {SQL_J} SELECT path, max(seq) AS seq, arg_max(event_kind, seq) AS event_kind FROM j GROUP BY path"),
    "journal_backlog": (
        lambda s, d: J.latest_per_path(tables.journal(s, d)).where("applied = 1").groupBy("event_kind").agg(F.min("observed_ms").alias("oldest"), F.count(F.lit(1)).alias("n")),
        f"{_LAST} SELECT event_kind, min(observed_ms) AS oldest, count(*) AS n FROM w WHERE n = 1 GROUP BY event_kind",
    ),
    "rename_pairs": (
        rename_pairs,
        f"""WITH {SQL_J}, r AS (SELECT *, split_part(path, ':', 2) AS name FROM j WHERE event_kind IN ('create', 'delete')), w AS (SELECT name, seq, event_kind, observed_ms, lead(event_kind) OVER x AS k, lead(observed_ms) OVER x AS m, lead(seq) OVER x AS s FROM r WINDOW x AS (PARTITION BY name ORDER BY observed_ms, seq))
SELECT name, seq AS deleted, s AS created FROM w WHERE event_kind = 'delete' AND k = 'create' AND m - observed_ms <= 86400000""",
    ),
    "ledger_diff": (
        lambda s, d: J.ledger_diff(*_before_after(s, d)),
        "SELECT source || '/' || lang || '/' || doc_id AS path, CASE lang WHEN 'fr' THEN 'added' WHEN 'es' THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE lang IN ('fr', 'es', 'de')",
    ),
    "metadata_diff": (metadata_diff, "SELECT CASE lang WHEN 'fr' THEN 'create' WHEN 'es' THEN 'delete' ELSE 'modify' END AS event_kind, count(*) AS n FROM documents WHERE lang IN ('fr', 'es', 'de') GROUP BY 1"),
    "merkle_root": (
        merkle_root,
        f"WITH t AS (SELECT source || '/' || lang || '/' || doc_id AS path, sha256(text) AS digest FROM documents), {folders_sql('t', 3)} SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3",
    ),
    "apply_delta": (
        apply_delta,
        "SELECT o_orderpriority AS path, CASE WHEN o_orderpriority LIKE '1%' THEN 'N' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderstatus = 'F') GROUP BY 1, 2",
    ),
    "delete_unresolves": (
        unresolve,
        f"""WITH {SQL_EDGES}, g AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_name LIKE '%A')
SELECT kind, CASE WHEN target IN (SELECT id FROM g) THEN 'UNRESOLVED' ELSE tier END AS tier, count(*) AS n, count(*) FILTER (target NOT IN (SELECT id FROM g)) AS targets FROM edges GROUP BY 1, 2""",
    ),
    "freshness_ladder": (
        freshness_ladder,
        """WITH k AS (SELECT user_id, bool_or(event_type = 'signup') AS w, bool_or(event_type = 'error') AS g, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
SELECT CASE WHEN NOT w THEN 'unwatched' WHEN g THEN 'degraded' WHEN p > 0 THEN 'stale' ELSE 'current' END AS freshness, count(*) AS n FROM k GROUP BY 1""",
    ),
    "federated_concat": (federated, "SELECT l_returnflag AS repo, 'g' || l_returnflag AS generation_id, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "run_ledger_chain": (run_ledger, "WITH w AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, count(*) AS links, bool_and(p IS NULL OR p = turn - 1) AS ok FROM w GROUP BY conv_id"),
    "dense_ordinals": (
        ordinals,
        """WITH n AS (SELECT 'region:' || r_regionkey AS id, 'region/' || r_regionkey AS path, 0 AS rank FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation/' || n_nationkey, 0 FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier/' || s_suppkey, 0 FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer/' || c_custkey, 1 FROM customer)
SELECT id, row_number() OVER (ORDER BY rank, path, id) - 1 AS ordinal FROM n""",
    ),
}
