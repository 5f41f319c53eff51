"""Queries of retrieval and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import text as X
from evgraph.operators import nearest, ranking
from evgraph.plans.graph import SQL_NODES
from evgraph.session import cut
from evgraph.sources import tables


def _parts(spark, d) -> DataFrame:
    return tables.nodes(spark, d, ("part",))


def _vectors(spark, d) -> DataFrame:
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _query_vector(spark, d) -> list[float]:
    row = tables.read(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()  # one vector: the query
    return list(row[0]) if row else []


def lexical_search(spark, d):
    return ranking.lexical_search(_parts(spark, d), ["part", "1", "2"], 20)


def token_index(spark, d):
    return ranking.token_index(tables.nodes(spark, d, ("part", "nation")))


def term_search(spark, d):
    return ranking.term_search(ranking.token_index(tables.nodes(spark, d, ("nation", "region"))), ["zzz", "america", "asia"])


def cosine_topk(spark, d):
    return ranking.vector_search(_vectors(spark, d), _query_vector(spark, d), 10).select("id", F.round("score", 6).alias("score"))


def cosine_min_score(spark, d):
    got = ranking.vector_search(_vectors(spark, d), _query_vector(spark, d), None, 0.1)
    return got.select("id", F.round("score", 6).alias("score"))


SQL_COS = "q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS score FROM embeddings, q)"


def hybrid(spark, d):
    sem = ranking.vector_search(_vectors(spark, d), _query_vector(spark, d), None)
    cand = _vectors(spark, d).select("id", (F.col("label") / 10.0).alias("centrality"), F.lit(0.5).alias("lexical_score"), (F.col("id") % 3).cast("double").alias("budget_cost"))
    return ranking.hybrid_rank(cand, sem).select("id", F.round("score", 6).alias("score"))


def _ranked_queries(spark, d) -> DataFrame:
    """Every hundredth vector against all others: (q, id, rank of the ten nearest, same label)."""
    v = _vectors(spark, d)
    return nearest.nearest(v, v.where("id % 100 = 0").select(F.col("id").alias("q"), "v", "label"), 10, 9)


def recall_mrr(spark, d):
    got = cut(_ranked_queries(spark, d))
    gold = got.where("right").select("q", "id")
    scored = ranking.score_cases(got.select("q", "id", "rank"), gold)
    all_q = got.select("q").distinct()
    return all_q.join(scored, "q", "left").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.coalesce(F.col("hit").cast("bigint"), F.lit(0))).alias("hits"), F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"))


def abstain(spark, d):
    """Queries without any relevant seed are kept, and say so."""
    asked = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("q"), F.lower("n_name").alias("term"))
    seeds = tables.read(spark, d, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("q")).agg(F.count(F.lit(1)).alias("seeds"))
    return asked.join(seeds, "q", "left").select("q", "term", F.col("seeds").isNull().alias("abstained"), F.when(F.col("seeds").isNull(), "no_relevant_seed").alias("reason"))


def candidate_set(spark, d):
    """At most 40 candidates a source, within 8000 tokens, in order: what is admitted and why not."""
    rows = tables.read(spark, d, "documents").select("source", "doc_id", X.json_tokens(F.col("n_chars")).alias("cost"))
    w = Window.partitionBy("source").orderBy("doc_id")
    got = rows.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return got.select("source", "doc_id", F.when(F.col("place") > 40, "ceiling").when((F.col("used") > 8000) & (F.col("place") > 1), "budget").otherwise("admitted").alias("outcome"))


def budget_prefix(spark, d):
    rows = tables.read(spark, d, "documents").select("source", "doc_id", X.json_tokens(F.col("n_chars")).alias("cost"))
    return ranking.budget_prefix(rows, "cost", ["doc_id"], 2000, ["source"]).select("source", "doc_id", "used")


def budget_skip(spark, d):
    rows = tables.read(spark, d, "benchmark").select((F.col("item_id") % 4).alias("grp"), "item_id", X.json_tokens(F.length("text")).alias("cost"))
    return ranking.budget_skip(rows, "item_id", "cost", ["item_id"], 150, ["grp"])


def percentile(spark, d):
    return ranking.percentile_nearest(tables.read(spark, d, "events").where("value is not null"), "value", 0.95, ["event_type"])


def diverse_claims(spark, d):
    rows = tables.read(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ranking.capped(rows, [F.desc("n_chars"), "doc_id"], "source", 8, 30).select("doc_id", "source", "n_chars")


def query_terms(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", F.array_join(X.query_terms(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ").alias("terms"))


def text_scores(spark, d):
    body = F.col("text")
    return tables.read(spark, d, "documents").select("doc_id", X.term_score(body, ["the", "license"]).alias("terms"), X.text_score(body, ["the", "license"]).alias("weighted"), X.ordered_term_score(body, ["of", "the"]).alias("ordered"))


def token_proxies(spark, d):
    n = F.length("text")
    return tables.read(spark, d, "documents").select("doc_id", X.json_tokens(n).alias("quarter"), X.byte_tokens(n).alias("bytes"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


def slugs(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", X.slug(F.concat_ws("  ", "p_name", "p_brand")).alias("slug"), X.truncate(F.concat_ws(" ", "p_name", "p_type"), 18).alias("short"))


def content_hash(spark, d):
    """Equal documents by content hash: the first of each, and how many."""
    rows = tables.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))


def page_paths(spark, d):
    """The path of each url, its folder, extension and normal form."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return tables.read(spark, d, "pages").select("page_id", X.normal_path(path).alias("path"), X.dirname(X.normal_path(path)).alias("folder"), X.extension(path).alias("extension"))


def redact(spark, d):
    rows = tables.doc_lines(spark, d).where(F.col("text").rlike(X.SECRET_VALUE))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length(X.redact(F.col("text")))).alias("left"))


_SECRET = "(?i)(api[_-]?key|secret|token|password|passwd|authorization)(\\s*[:=]\\s*)(\\S+)"


def glob_match(spark, d):
    return tables.nodes(spark, d).select("id", X.glob_match(F.col("path"), "part/*").alias("one"), X.glob_match(F.col("path"), "**1").alias("deep"), X.glob_match(F.col("path"), "order/?", True).alias("single"))


QUERIES = {
    "lexical_search": (
        lexical_search,
        f"WITH {SQL_NODES}, h AS (SELECT id, lower(kind || ' ' || name || ' ' || path) AS t FROM nodes WHERE kind = 'part'), s AS (SELECT id, contains(t, 'part')::INT + contains(t, '1')::INT + contains(t, '2')::INT AS score FROM h) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 60",
    ),
    "token_index": (
        token_index,
        f"""WITH {SQL_NODES}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9_]+'), lambda t: len(t) > 0) AS ws FROM nodes WHERE kind IN ('part', 'nation')),
t AS (SELECT id, unnest(ws) AS token FROM w UNION SELECT id, unnest(flatten(list_transform(ws, lambda x: string_split(x, '_')))) FROM w UNION SELECT id, '*' FROM w) SELECT DISTINCT token, id FROM t WHERE len(token) BETWEEN 1 AND 64""",
    ),
    "term_search": (
        term_search,
        f"""WITH {SQL_NODES}, t AS (SELECT DISTINCT id, unnest(list_append(regexp_split_to_array(lower(name), '[^a-z0-9_]+'), '*')) AS token FROM nodes WHERE kind IN ('nation', 'region')),
h AS (SELECT id, token, CASE token WHEN 'america' THEN 0 WHEN 'asia' THEN 2 WHEN 'zzz' THEN 1 ELSE 3 END AS p FROM t WHERE token IN ('america', 'asia', 'zzz', '*')) SELECT id, token FROM h WHERE p = (SELECT min(CASE token WHEN 'america' THEN 0 WHEN 'zzz' THEN 2 WHEN 'asia' THEN 1 ELSE 3 END) FROM h) OR (p = 3 AND (SELECT min(p) FROM h) = 3) ORDER BY id LIMIT 20""",
    ),
    "cosine_topk": (cosine_topk, f"WITH {SQL_COS} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10"),
    "cosine_min_score": (cosine_min_score, f"WITH {SQL_COS} SELECT id, round(score, 6) AS score FROM s WHERE s.score >= 0.1"),
    "hybrid_rank": (hybrid, f"WITH {SQL_COS} SELECT id, round(score + label / 10.0 + 0.5 + id % 3, 6) AS score FROM s JOIN embeddings ON vec_id = id"),
    "recall_mrr": (
        recall_mrr,
        """WITH p AS (SELECT b.vec_id AS q, a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s, a.label = b.label AS ok FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM p), t AS (SELECT q, min(rank) FILTER (ok) AS first FROM r WHERE rank <= 10 GROUP BY q)
SELECT count(*) AS cases, CAST(count(first) AS BIGINT) AS hits, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM t""",
    ),
    "abstain": (
        abstain,
        "WITH s AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 8000) SELECT n_nationkey AS q, lower(n_name) AS term, s_nationkey IS NULL AS abstained, CASE WHEN s_nationkey IS NULL THEN 'no_relevant_seed' END AS reason FROM nation LEFT JOIN s ON n_nationkey = s_nationkey",
    ),
    "candidate_set": (
        candidate_set,
        """WITH c AS (SELECT source, doc_id, greatest(1, CAST(ceil(n_chars / 4) AS BIGINT)) AS cost FROM documents), w AS (SELECT *, row_number() OVER x AS place, sum(cost) OVER x AS used FROM c WINDOW x AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, CASE WHEN place > 40 THEN 'ceiling' WHEN used > 8000 AND place > 1 THEN 'budget' ELSE 'admitted' END AS outcome FROM w""",
    ),
    "budget_prefix": (
        budget_prefix,
        """WITH c AS (SELECT source, doc_id, greatest(1, CAST(ceil(n_chars / 4) AS BIGINT)) AS cost FROM documents), w AS (SELECT *, row_number() OVER x AS place, CAST(sum(cost) OVER x AS BIGINT) AS used FROM c WINDOW x AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, used FROM w WHERE used <= 2000 OR place = 1""",
    ),
    "budget_skip": (
        budget_skip,
        """WITH RECURSIVE c AS (SELECT item_id % 4 AS grp, item_id, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS cost, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS n FROM benchmark),
f AS (SELECT grp, item_id, n, CASE WHEN cost <= 150 THEN cost ELSE 0 END AS used, cost <= 150 AS taken FROM c WHERE n = 1 UNION ALL
SELECT c.grp, c.item_id, c.n, f.used + CASE WHEN f.used + c.cost <= 150 THEN c.cost ELSE 0 END, f.used + c.cost <= 150 FROM f JOIN c ON c.grp = f.grp AND c.n = f.n + 1) SELECT grp, item_id, taken FROM f""",
    ),
    "percentile_nearest_rank": (percentile, "SELECT event_type, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS INT)] AS value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "diverse_claims": (
        diverse_claims,
        "WITH w AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) SELECT doc_id, source, n_chars FROM w WHERE place <= 8 ORDER BY n_chars DESC, doc_id LIMIT 30",
    ),
    "query_terms": (
        query_terms,
        """WITH t AS (SELECT p_partkey, regexp_split_to_array(lower(regexp_replace(p_name || ' ' || p_type || ' ' || p_brand, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9_]+') AS ts FROM part),
f AS (SELECT p_partkey, list_filter(ts, lambda x: len(x) > 1 AND x NOT IN ('a', 'an', 'and', 'for', 'in', 'of', 'the', 'to', 'where')) AS ts FROM t)
SELECT p_partkey, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), ' ') AS terms FROM f""",
    ),
    "text_scores": (
        text_scores,
        """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, contains(t, 'the')::INT + contains(t, 'license')::INT AS terms, contains(t, 'the')::INT + contains(t, 'license')::INT * 3 AS weighted,
CASE WHEN contains(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), 'of the') THEN 11 ELSE 0 END AS ordered FROM t""",
    ),
    "token_proxies": (
        token_proxies,
        "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS quarter, greatest(1, CAST(round(length(text) / 3.5) AS BIGINT)) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents",
    ),
    "slugs": (
        slugs,
        """WITH t AS (SELECT p_partkey, lower(p_name || '  ' || p_brand) AS a, p_name || ' ' || p_type AS b FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(a, '[^a-z0-9]+', '-', 'g'), '(^-+)|(-+$)', '', 'g') AS slug, CASE WHEN length(b) <= 18 THEN b ELSE regexp_replace(substr(b, 1, 15), '\\s+\\S*$', '') || '...' END AS short FROM t""",
    ),
    "content_hash": (content_hash, "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1"),
    "page_paths": (
        page_paths,
        r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS raw FROM pages), n AS (SELECT page_id, raw, list_reduce(list_prepend('', list_filter(string_split(replace(raw, '\', '/'), '/'), lambda x: x <> '' AND x <> '.')), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '(^|/)[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END) AS path FROM p)
SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, lower(regexp_extract(raw, '(\.[^./]+)$', 1)) AS extension FROM n""",
    ),
    "redact": (
        redact,
        f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT doc_id, count(*) AS lines, CAST(sum(length(regexp_replace(t, '{_SECRET}', '\\1\\2[REDACTED]', 'g'))) AS BIGINT) AS \"left\" FROM l WHERE regexp_matches(t, '{_SECRET}') GROUP BY doc_id",
    ),
    "glob_match": (
        glob_match,
        f"WITH {SQL_NODES} SELECT id, regexp_full_match(path, 'part/[^/]*') AS one, regexp_full_match(path, '.*1') AS deep, regexp_full_match(path, 'order/[^/]') AS single FROM nodes",
    ),
}
