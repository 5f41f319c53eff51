"""URL filters: a Bloom filter cascade, built and probed with DataFrame functions only.

A listed key is ``host`` + ``path prefix``. The universe is every key that a url of the corpus could match: each of its
host's suffixes joined to each of its path's prefixes, of the numbers of labels and characters that some listed key has.
Level 1 encodes the listed keys; level 2 the other keys of the universe that pass level 1; level 3 the listed keys that
pass level 2; and so on, until nothing passes wrongly. A key of the universe is listed if the first level that it fails is
of even number (or if it passes all and their number is odd): exact membership, and probing joins nothing. Levels are
sized for few bits altogether: level 1 lets a share of |listed| / (1.4 |others|) of the others pass, later ones a half.

The bits of all levels are literals of the plan. Lists whose first level would take more than ``MAX_BYTES`` are parted by a
hash of the key into as many cascades as need be, probed one after the other over the written rows: each key belongs to
one of them, so membership stays exact. Keys that pass wrongly, not the universe, are what a shuffle sees.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MAX_BYTES = 8 << 20

#: (host, path, verdict) of the query's rules (fixed values).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = rest.substr(F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"^([^?#]*)", 1)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """All keys that the url could match, of the ``shapes`` (labels of the host, characters of the path), the longest first;
    equal lengths: the longer host first."""
    parts = F.split(host, r"\.")
    keys = []
    for n, k in shapes:
        suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
        ok = (F.size(parts) >= n) & (F.length(path) >= k) & (host != "")
        keys.append(F.when(ok, F.struct((F.length(suffix) + k).alias("n"), F.length(suffix).alias("h"), F.concat(suffix, path.substr(1, k)).alias("key"))))
    found = F.sort_array(F.filter(F.array(*keys), lambda x: x.isNotNull()), asc=False)
    return F.transform(found, lambda x: x["key"])


def _bits(key: Column, size: int, hashes: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(k), key), F.lit(size)) for k in range(hashes)]


class Cascade:
    """Levels of (bits, number of hashes, 64-bit words); made by :func:`build`."""

    def __init__(self, levels: list[tuple[int, int, list[int]]], listed: int):
        self.levels, self.listed = levels, listed

    def contains(self, key: Column) -> Column:
        """Whether ``key``, of the universe, is listed. Null is not."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(self._passes(key, i), out).otherwise(i % 2 == 0)
        return F.coalesce(key.isNotNull() & out, F.lit(False))

    def _passes(self, key: Column, level: int) -> Column:
        size, hashes, words = self.levels[level - 1]
        held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to a literal
        tests = [F.get(held, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))) != 0 for p in _bits(key, size, hashes, level)]
        return reduce(lambda a, b: a & b, tests)


def _bytes(n: int, rate: float) -> int:
    """Of a Bloom filter of ``n`` keys that lets ``rate`` of the others pass."""
    return max(8, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 8)


def _rate(n: int, others: int) -> float:
    """What level 1 lets pass."""
    return min(0.5, max(1e-9, n / (1.42 * max(1, others))))


def _encode(keys: DataFrame, n: int, rate: float, level: int) -> tuple[int, int, list[int]]:
    """A Bloom filter of ``n`` keys: its size in bits, number of hashes, and words."""
    size = _bytes(n, rate) * 8
    hashes = min(12, max(1, round(size / max(1, n) * math.log(2))))
    at = keys.select(F.explode(F.array(*_bits(F.col("key"), size, hashes, level))).alias("p"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("p"), F.lit(64)).cast("int"))).alias("b")).collect()
    words = [0] * (size // 64)
    for r in rows:  # at most size / 64 rows
        words[r.w] = r.b
    return size, hashes, words


def build(universe: DataFrame, listed: DataFrame, others: int | None = None) -> Cascade:
    """The cascade of the keys ``listed`` (column key) within ``universe`` (column key; repeats are no matter), which has
    about ``others`` different keys (counted unless given). The lists that :func:`judge` hands in are of bounded size."""
    inside = listed.where("key is not null").distinct()
    n = inside.count()
    if not n:
        return Cascade([], 0)
    if others is None:
        others = universe.agg(F.approx_count_distinct("key", 0.05)).first()[0]
    levels = [_encode(inside, n, _rate(n, others), 1)]
    passed = lambda df, level: df.where(Cascade(levels, n)._passes(F.col("key"), level))
    outside = written(passed(universe.where("key is not null"), 1).distinct().join(inside, "key", "left_anti"), "wrongly-passed")
    while m := outside.count():
        levels.append(_encode(outside, m, 0.5, len(levels) + 1))
        inside = passed(inside, len(levels))
        if not (n_in := inside.count()):
            break
        levels.append(_encode(inside, n_in, 0.5, len(levels) + 1))
        outside = passed(outside, len(levels))
    return Cascade(levels, n)


def _table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list of rules as a table of literals: no Python runs for it. Long lists are handed in as tables."""
    rows = [F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules or [("", "", "")]]
    return spark.range(1 if rules else 0).select(F.inline(F.array(*rows)))


def _hit(cascades: list[Cascade], here: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Whether a key is of this part and one of its cascades lists it."""
    return lambda k: here(k) & reduce(lambda a, b: a | b, [c.contains(k) for c in cascades])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key``, host, path, rule and verdict of every row.

    ``rules``: (host, path, verdict). One cascade lists the keys that block, one those that allow; the longest candidate
    key that either lists is the rule (a key listed as both blocks). A url that fits none gets the method's own verdict:
    it is in no list, so ``default``. Null, empty and odd urls have an empty host and fit no rule. Repeated rows are judged
    alike; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    rules = rules if isinstance(rules, DataFrame) else _table(spark, rules)
    listed = rules.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size"), "verdict")
    shapes = sorted((r.labels, r.size) for r in listed.select("labels", "size").distinct().collect())  # of a host's labels and a path's lengths
    if not shapes:
        return rows.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    others = rows.select(F.explode("keys").alias("key")).agg(F.approx_count_distinct("key", 0.05)).first()[0]
    counts = {r.verdict: r.n for r in listed.groupBy("verdict").agg(F.count_distinct("key").alias("n")).collect()}
    parts = max(-(-_bytes(n, _rate(n, others)) // MAX_BYTES) for n in counts.values())
    if parts > 1:  # a tenth to spare, as parts differ
        parts = parts + -(-parts // 10)
        rows = written(rows.withColumn("best", F.lit(None).cast("int")).withColumn("blocks", F.lit(None).cast("boolean")), "urls")
    here = lambda k, p: F.pmod(F.xxhash64(k), F.lit(parts)) == p if parts > 1 else F.lit(True)
    for p in range(parts):
        universe = rows.select(F.explode("keys").alias("key")).where(here(F.col("key"), p))
        both = [build(universe, listed.where((F.col("verdict") == v) & here(F.col("key"), p)), max(1, others // parts)) for v in ("block", "allow")]
        hit = _hit(both, partial(here, p=p))
        if parts == 1:
            rule = F.get(F.filter("keys", hit), F.lit(0))
            rows = rows.withColumn("rule", rule)
            return rows.select(F.col("_key").alias(key), "host", "path", "rule", F.when(F.col("rule").isNull(), F.lit(default)).when(both[0].contains(F.col("rule")), F.lit("block")).otherwise("allow").alias("verdict"))
        at = F.array_position(F.transform("keys", hit), True).cast("int")
        rows = rows.withColumn("at", F.when((at > 0) & ((at < F.col("best")) | F.col("best").isNull()), at))
        rows = written(rows.select("_key", "host", "path", "keys", F.coalesce("at", "best").alias("best"), F.when(F.col("at").isNotNull(), both[0].contains(F.get("keys", F.col("at") - 1))).otherwise(F.col("blocks")).alias("blocks")), "urls")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("blocks"), F.lit("block")).otherwise("allow")
    return rows.select(F.col("_key").alias(key), "host", "path", F.get("keys", F.col("best") - 1).alias("rule"), verdict.alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of all pages under RULES."""
    return judge(table(spark, sf_dir, "pages"), list(RULES))


_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE {_CASES} END AS hit FROM c)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule, coalesce(split_part(hit, '|', 2), 'allow') AS verdict FROM d
"""
