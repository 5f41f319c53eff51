"""Architecture rules, exceptions, baselines, and the chain of runs."""

from __future__ import annotations

import hashlib
import hmac
import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import text as X

#: The rules of the registered query (fixed values).
RULES = (
    {"id": "no-order-to-customer", "from": "order:*1", "to": "customer:*", "kinds": ("REFERENCES",)},
    {"id": "parts-use-few", "from": "part:*", "to": "supplier:*7", "kinds": ("USES",)},
)


def parse_rules(text: str) -> list[dict]:
    """Rules from a small YAML subset: a list of maps, with nested maps and lists by indentation."""
    rules: list[dict] = []
    path: list[tuple[int, dict]] = []
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.strip() == "rules:":
            continue
        depth, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- ") and ":" in body:
            rule: dict = {}
            rules.append(rule)
            path, body, depth = [(depth, rule)], body[2:], depth + 2
        while len(path) > 1 and path[-1][0] >= depth:
            path.pop()
        name, _, value = body.partition(":")
        name, value = name.strip(), value.strip()
        if not value:
            inner: dict = {}
            path[-1][1][name] = inner
            path.append((depth, inner))
        elif value.startswith("["):
            path[-1][1][name] = [x.strip().strip("'\"") for x in value.strip("[]").split(",") if x.strip()]
        else:
            path[-1][1][name] = value.strip("'\"")
    return rules


def evaluate(edges: DataFrame, rules) -> DataFrame:
    """A finding (rule, edge columns, fingerprint) for each edge that a rule disallows; of no rules none.

    Rules are a handful of patterns: one scan of the edges gives each the list of the rules it breaks.
    """
    broken = F.array().cast("array<string>")
    if rules:
        hits = []
        for r in rules:
            hit = X.glob_match(F.col("source"), r.get("from", "")) & X.glob_match(F.col("target"), r.get("to", ""))
            if r.get("kinds"):
                hit = hit & F.col("kind").isin(*r["kinds"])
            hits.append(F.when(hit, F.lit(r["id"])))
        broken = F.filter(F.array(*hits), lambda x: x.isNotNull())
    found = edges.where("target is not null").select(F.explode(broken).alias("rule"), *edges.columns)
    mark = F.substring(F.sha2(F.concat_ws("|", "rule", "source", "target", "kind"), 256), 1, 16)
    return found.withColumn("fingerprint", mark)


def changed_slice(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline does not have."""
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti").select(*findings.columns)


def suppressed(findings: DataFrame, exceptions: list[dict], now: str) -> DataFrame:
    """Findings that no valid exception covers: all five fields given, not expired, its scope global or a path prefix."""
    need = ("rule", "scope", "owner", "reason", "expires")
    valid = [e for e in exceptions if all(e.get(k) for k in need) and e["expires"] > now]
    if not valid:
        return findings
    cover = [(F.col("rule") == e["rule"]) & (F.lit(e["scope"] == "global") | F.col("source").startswith(e["scope"])) for e in valid]
    return findings.where(~reduce(lambda a, b: a | b, cover))


def to_sarif(findings: DataFrame, version: str = "1") -> str:
    """Findings as a SARIF log. Findings are few: those of a rule report."""
    rows = findings.orderBy("rule", "source", "target").collect()
    results = [{"ruleId": r["rule"], "message": {"text": f"{r['source']} -> {r['target']}"}, "partialFingerprints": {"primary": r["fingerprint"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["source"]}}}]} for r in rows]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "evgraph", "version": version}}, "results": results}]}, sort_keys=True)


def chain_ok(links: DataFrame, by: list[str]) -> DataFrame:
    """(links' columns, ok): whether each link names the digest of the one before it. (seq, digest, previous)"""
    before = F.lag("digest").over(Window.partitionBy(*by).orderBy("seq"))
    return links.withColumn("ok", F.col("previous").eqNullSafe(before))


def sign(key: bytes, previous: str | None, payload: dict) -> str:
    return hmac.new(key, json.dumps({"previous": previous, "payload": payload}, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def verify_chain(key: bytes, links: list[dict]) -> bool:
    previous = None
    for x in links:
        if x["previous"] != previous or not hmac.compare_digest(x["digest"], sign(key, previous, x["payload"])):
            return False
        previous = x["digest"]
    return True
