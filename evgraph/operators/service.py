"""What serves a single answer: grants and receipts, exports, and the facade over a graph's generation.

All of it works on bounded answers; the tables behind stay DataFrames.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions.text import glob_regex
from evgraph.operators import analytics, neighbourhood, ranking, traverse


# --- grants and receipts --------------------------------------------------------------------------------------------


@dataclass
class Grants:
    """Grants of paths to a task for a generation, signed and of limited life."""

    key: bytes
    held: dict[str, dict] = field(default_factory=dict)

    def _sign(self, grant: dict) -> str:
        body = json.dumps({k: v for k, v in grant.items() if k != "mac"}, sort_keys=True)
        return hmac.new(self.key, body.encode(), hashlib.sha256).hexdigest()

    def issue(self, task: str, generation: str, paths: list[str], minutes: float = 120, now: float | None = None) -> dict:
        grant = {"id": uuid.uuid4().hex, "task": task, "generation": generation, "paths": paths, "expires": (time.time() if now is None else now) + 60 * minutes}
        grant["mac"] = self._sign(grant)
        self.held[task] = grant
        return grant

    def check(self, task: str, generation: str, path: str, now: float | None = None) -> tuple[bool, str]:
        """Whether the task may touch the path, and why not."""
        import re

        grant = self.held.get(task)
        if grant is None:
            return False, "no_grant"
        if not hmac.compare_digest(grant["mac"], self._sign(grant)):
            return False, "bad_signature"
        if grant["generation"] != generation:
            return False, "generation_changed"
        if (time.time() if now is None else now) >= grant["expires"]:
            return False, "expired"
        ok = any(re.match(glob_regex(p, True), path) for p in grant["paths"])
        return ok, "ok" if ok else "outside_scope"


@dataclass
class Admission:
    """Decides whether work may go on: orient first, expand within it, status, revoke."""

    receipts: dict[tuple, dict] = field(default_factory=dict)

    @staticmethod
    def _key(session: str, task: str, repo: str, generation: str) -> tuple:
        return session, task, repo, generation

    def orient(self, session: str, task: str, repo: str, generation: str, fresh: str = "current") -> dict:
        if fresh in ("degraded", "unwatched"):
            return {"decision": "block", "reason": fresh}
        key = self._key(session, task, repo, generation)
        if key in self.receipts and not self.receipts[key]["revoked"]:
            return {"decision": "noop", "receipt": self.receipts[key]["id"]}
        self.receipts[key] = {"id": uuid.uuid4().hex, "revoked": False, "anchors": []}
        return {"decision": "allow", "receipt": self.receipts[key]["id"]}

    def expand(self, session: str, task: str, repo: str, generation: str, anchors: list[str]) -> dict:
        got = self.receipts.get(self._key(session, task, repo, generation))
        if got is None or got["revoked"]:
            return {"decision": "block", "reason": "not_oriented"}
        new = [a for a in anchors if a not in got["anchors"]]
        got["anchors"] += new
        return {"decision": "continue" if new else "noop", "anchors": got["anchors"]}

    def status(self, session: str, task: str, repo: str, generation: str) -> dict:
        got = self.receipts.get(self._key(session, task, repo, generation))
        return {"decision": "allow" if got and not got["revoked"] else "block"}

    def revoke(self, session: str, task: str, repo: str, generation: str) -> dict:
        got = self.receipts.get(self._key(session, task, repo, generation))
        if got is None or got["revoked"]:
            return {"decision": "noop"}
        got["revoked"] = True
        return {"decision": "allow"}


# --- exports --------------------------------------------------------------------------------------------------------


def tabular(rows: DataFrame) -> DataFrame:
    """One tab-separated line a row."""
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, its names in order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("line"))


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 200) -> str:
    """A diagram of a bounded subgraph."""
    n, e = nodes.orderBy("id").limit(most).collect(), edges.where("target is not null").orderBy("source", "target", "kind").limit(most).collect()
    name = {r["id"]: f"n{i}" for i, r in enumerate(n)}
    lines = ["graph LR", *(f'  {name[r["id"]]}["{r["name"]}"]' for r in n)]
    lines += [f"  {name[r['source']]} -->|{r['kind']}| {name[r['target']]}" for r in e if r["source"] in name and r["target"] in name]
    return "\n".join(lines)


def evidence_pack(repo: str, generation: str, results: list[dict], omissions: list[dict]) -> str:
    """Results with their citations, and what was left out, as JSON with a digest."""
    body = {"repo": repo, "generation": generation, "results": results, "omissions": omissions}
    return json.dumps(body | {"digest": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, sort_keys=True)


def evidence_markdown(pack: str) -> str:
    got = json.loads(pack)
    lines = [f"# {got['repo']} at {got['generation']}", ""]
    lines += [f"- `{r.get('path', '')}` {r.get('id', '')}" for r in got["results"]]
    return "\n".join([*lines, "", f"{len(got['omissions'])} left out"])


def digest(algorithm: str, generation: str, params: dict) -> str:
    return hashlib.sha256(json.dumps([algorithm, generation, params], sort_keys=True).encode()).hexdigest()[:16]


def budget_verdict(value: float | None, most: float) -> str:
    return "unproven" if value is None else "passed" if value <= most else "failed"


# --- the facade -----------------------------------------------------------------------------------------------------


@dataclass
class Graph:
    """The graph's questions over tables of one generation: nodes (id, kind, name, path) and edges."""

    nodes: DataFrame
    edges: DataFrame
    generation: str = ""

    def _seed(self, *ids: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")

    def resolve(self, anchor: str) -> str:
        """The id that an id or a name means; several are an error that names them."""
        hits = [r[0] for r in self.nodes.where((F.col("id") == anchor) | (F.col("name") == anchor)).select("id").orderBy("id").limit(20).collect()]
        if anchor in hits:
            return anchor
        if len(hits) != 1:
            raise LookupError(f"{anchor}: " + (", ".join(hits) or "not found"))
        return hits[0]

    def search(self, terms: list[str], limit: int = 20) -> DataFrame:
        return ranking.lexical_search(self.nodes, terms, limit).limit(limit)

    def neighbors(self, anchor: str, depth: int = 1, direction: str = "both", budget: int = 2000) -> DataFrame:
        """Ranked neighbours within a budget of tokens."""
        root = self.resolve(anchor)
        reached = traverse.closure(self._seed(root), self.edges, depth, direction)
        inside = traverse.neighbor_edges(reached, self.edges)
        rows = ranking.rank_nodes(reached, inside, root).join(self.nodes, "id").withColumn("cost", F.greatest(F.lit(1), F.ceil(F.length(F.to_json(F.struct("id", "kind", "path"))) / 4)).cast("long"))
        return ranking.budget_prefix(rows, "cost", ["position"], budget).select("position", "id", "kind", "path", "used").orderBy("position")

    def page(self, anchor: str, depth: int = 1, direction: str = "both", budget: int = 2000, after: tuple[int, int] = (0, 0)) -> tuple[DataFrame, DataFrame, tuple[int, int] | None]:
        """A page of ranked neighbours and of the edges between them, within a budget of tokens; and where the next begins."""
        root = self.resolve(anchor)
        reached = traverse.closure(self._seed(root), self.edges, depth, direction)
        inside = traverse.neighbor_edges(reached, self.edges)
        cost = lambda *cols: F.greatest(F.lit(1), F.ceil(F.length(F.to_json(F.struct(*cols))) / 4)).cast("long").alias("cost")
        nodes = ranking.rank_nodes(reached, inside, root).join(self.nodes, "id").select("position", "id", "kind", "path", cost("id", "kind", "path"))
        edges = ranking.rank_edges(reached, inside).select("position", "source", "target", "kind", "tier", cost("source", "target", "kind", "tier"))
        taken = neighbourhood.page(nodes, edges, budget, after)
        part = lambda rows, phase: rows.join(taken.where(F.col("phase") == phase).select("position"), "position", "left_semi").orderBy("position")
        return part(nodes, "node"), part(edges, "edge"), neighbourhood.cursor(taken, after, nodes.count(), edges.count())

    def impact(self, anchor: str, depth: int = 3) -> DataFrame:
        return traverse.impact(self._seed(self.resolve(anchor)), self.edges, depth)

    def path(self, start: str, goal: str, depth: int = 5) -> DataFrame:
        return traverse.shortest_path(self.resolve(start), self.resolve(goal), self.edges, depth)

    def architecture(self) -> dict[str, DataFrame]:
        return {"kinds": analytics.kind_counts(self.edges), "entries": analytics.entry_points(self.nodes, self.edges), "terminals": analytics.terminals(self.nodes, self.edges), "hotspots": analytics.hotspots(self.edges)}

    def flows(self, entries: DataFrame | None = None) -> DataFrame:
        return traverse.flows(entries if entries is not None else analytics.entry_points(self.nodes, self.edges).select("id"), self.edges)

    def diagram(self, anchor: str, depth: int = 1) -> str:
        reached = traverse.closure(self._seed(self.resolve(anchor)), self.edges, depth, "both")
        return mermaid(self.nodes.join(reached.select("id"), "id", "left_semi"), traverse.neighbor_edges(reached, self.edges))
