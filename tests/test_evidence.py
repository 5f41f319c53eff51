"""Neighbourhoods, ordering, resolution, truth, maintenance and adapters against plain code and known answers."""

from __future__ import annotations

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from evgraph.operators import adapters, analytics, context, extract, neighbourhood, policy, ranking, resolve, traverse, truth
from evgraph.operators.order import positions
from evgraph.session import cut
from evgraph.sources import store
from evgraph.streaming import maintenance


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ordinals_are_dense_whatever_the_size(spark):
    """With the session's own settings and rows wide enough to be cut into many ranges."""
    n = 400_000
    rows = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("dir/"), (F.col("id") % 977).cast("string")).alias("path"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("provider"), F.repeat(F.lit("x"), 40).alias("wide"))
    got = store.dense_ordinals(rows, table(spark, [("a", 1), ("b", 0)], "provider string, rank int"))
    r = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("id").alias("ids")).first()
    assert (r.n, r.d, r.lo, r.hi, r.ids) == (n, n, 0, n - 1, n)
    some = got.where("ordinal in (0, 133332, 266665, 266666, 399999)").orderBy("ordinal").select("provider").collect()
    assert [x.provider for x in some] == ["b", "b", "b", "a", "a"]
    assert positions(rows.where("false"), ["id"]).isEmpty()


def test_pages_follow_each_other(spark):
    rng = random.Random(5)
    nodes = table(spark, [(i + 1, rng.randint(1, 9)) for i in range(30)], "position int, cost int")
    edges = table(spark, [(i + 1, rng.randint(1, 30)) for i in range(20)], "position int, cost int")
    at, seen, pages = (0, 0), [], 0
    while at is not None:
        got = neighbourhood.page(nodes, edges, 25, at)
        rows = got.collect()
        assert sum(r.cost for r in rows) <= 25 or len(rows) == 1
        seen += [(r.phase, r.position) for r in rows]
        at, pages = neighbourhood.cursor(got, at, 30, 20), pages + 1
    assert sorted(seen) == sorted([("node", i + 1) for i in range(30)] + [("edge", i + 1) for i in range(20)]) and len(seen) == 50 and pages > 5


def test_wide_page_rank_is_page_rank(spark):
    rng = random.Random(7)
    rows = [(g, f"v{rng.randrange(12)}", f"v{rng.randrange(12)}", False) for g in ("a", "b") for _ in range(25)] + [(g, f"v{i}", None, i in (0, 3)) for g in ("a", "b") for i in range(14)]
    groups = table(spark, rows, "grp string, source string, target string, anchor boolean")
    one = {(r.grp, r.id): r.score for r in analytics.page_rank(groups).collect()}
    two = {(r.grp, r.id): r.score for r in analytics.page_rank(groups, rounds=20, most=10).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)
    assert abs(sum(v for (g, _), v in one.items() if g == "a") - 1) < 1e-9


@pytest.mark.parametrize("most, cuts", [(25, 4), (1, 7), (17, 8)])
def test_wide_page_rank_of_nodes_that_nothing_enters(spark, monkeypatch, most, cuts):
    """Most nodes are not entered: they are ranked together, however many rounds there are. 25: in one task; 1: by joins; 17: one
    group in a task, one by joins."""
    rng = random.Random(3)
    rows = [("a", f"leaf{i}", rng.choice(["hub", "mid", ""]), i in (4, 9)) for i in range(40)] + [("a", "leaf4", "hub", True)] * 2
    rows += [("a", "mid", "hub", False), ("a", "hub", "hub", False), ("a", "hub", "mid", False), ("a", "", "end", False)]
    rows += [("a", f"alone{i}", None, i == 0) for i in range(6)] + [("a", "hub", None, True)]
    rows += [("b", f"x{i}", f"x{(i * 7 + 1) % 11}", False) for i in range(30)] + [("b", "x3", None, True), ("c", "only", None, True), ("c", "other", None, False)]
    groups = table(spark, rows, "grp string, source string, target string, anchor boolean")
    want = {(r.grp, r.id): r.score for r in analytics.page_rank(groups, rounds=4).collect()}
    made = []
    monkeypatch.setattr(analytics, "cut", lambda df: made.append(1) or cut(df))
    got = [((r.grp, r.id), r.score) for r in analytics.page_rank(groups, rounds=4, most=most).collect()]
    assert len(got) == len(want) and all(abs(want[k] - v) < 1e-12 for k, v in got)
    assert len(made) == cuts


def test_page_rank_of_a_star_is_cut_a_few_times(spark, monkeypatch):
    rows = [("", f"leaf{i}", "hub", i == 7) for i in range(300)]
    groups = table(spark, rows, "grp string, source string, target string, anchor boolean")
    made = []
    monkeypatch.setattr(analytics, "cut", lambda df: made.append(1) or cut(df))
    got = {r.id: r.score for r in analytics.page_rank(groups, most=100).collect()}
    assert len(made) == 4 and len(got) == 301 and abs(sum(got.values()) - 1) < 1e-9
    assert got["hub"] > got["leaf7"] > got["leaf8"] == got["leaf9"]


@pytest.mark.parametrize("seed", range(2))
def test_typed_pack_is_the_pack(spark, seed):
    rng = random.Random(seed)
    kinds = {"ab": "REFERENCES", "bc": "CALLS", "ca": "REFERENCES", "bb": "REFERENCES"}
    pairs = {k: [(rng.randrange(9), rng.randrange(9)) for _ in range(9)] + [(2, None)] for k in kinds}
    relations = [traverse.Relation(k[0], k[1], kinds[k], table(spark, p, "x long, y int"), "x", "y") for k, p in pairs.items()]
    flat = table(spark, [(f"{k[0]}:{x}", None if y is None else f"{k[1]}:{y}", kinds[k]) for k, p in pairs.items() for x, y in p], "source string, target string, kind string")
    nodes = table(spark, [(f"{k}:{i}", 4 + i % 3) for k in "abc" for i in range(8)], "id string, cost long")
    asked = ["a:1", "b:2", "c:77"]
    want = neighbourhood.pack(nodes, flat, table(spark, [(x,) for x in asked], "id string"), 30, 1, 2)
    got = neighbourhood.typed_pack(nodes, relations, asked, 30, 1, 2)
    for a, b in zip(want, got):
        rows = sorted(map(tuple, a.collect()))
        assert rows and rows == sorted(map(tuple, b.select(*a.columns).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_typed_closure_is_the_closure(spark, seed):
    rng = random.Random(seed)
    pairs = {k: [(rng.randrange(8), rng.randrange(8)) for _ in range(12)] for k in ("ab", "bc", "ca", "bb")}
    relations = [traverse.Relation(k[0], k[1], "K" + k, table(spark, [*p, (None, 1), (2, None)], "x long, y long"), "x", "y") for k, p in pairs.items()]
    flat = table(spark, [(f"{k[0]}:{x}", f"{k[1]}:{y}", "K" + k) for k, p in pairs.items() for x, y in p], "source string, target string, kind string")
    for direction in ("out", "in", "both"):
        for depth, kinds in ((1, None), (3, None), (5, ("Kab", "Kbb", "Kca"))):
            seeds = ["a:1", "b:2", "z:9"]
            want = {(r.id, r.depth) for r in traverse.closure(table(spark, [(s,) for s in seeds], "id string"), flat, depth, direction, kinds).collect()}
            assert {(r.id, r.depth) for r in traverse.typed_closure(spark, seeds, relations, depth, direction, kinds).collect()} == want
    assert traverse.typed_closure(spark, [], relations, 2).isEmpty()
    for goal in ("c:1", "a:5", "a:1"):
        want = [(r.step, r.id) for r in traverse.shortest_path("a:1", goal, flat, 4).orderBy("step").collect()]
        assert [(r.step, r.id) for r in traverse.typed_shortest_path(spark, "a:1", goal, relations, 4).orderBy("step").collect()] == want


@pytest.mark.parametrize("seed", range(3))
def test_calls_against_plain_code(spark, seed):
    rng = random.Random(seed)
    symbols = [(f"s{i}", rng.choice("fghijk"), f"p{rng.randrange(9)}") for i in range(22)] + [("s1", "f", "p0"), ("lone", "q", "p1")]
    callers = [(i, p) for i, _, p in symbols] + [("outside", "p3")]
    calls = [(i, p, rng.choice("fghijkqz"), i.endswith("2")) for i, p in callers for _ in range(3)]
    imports = [(f"p{rng.randrange(9)}", f"p{rng.randrange(9)}") for _ in range(8)] + [("p1", None)]
    want = set()
    for source, path, name, test in calls:
        others = {(i, p) for i, n, p in symbols if n == name and i != source}
        near = {i for i, p in others if p == path}
        far = {i for i, p in others if (path, p) in imports}
        ids = {i for i, _ in others}
        kind = "TESTS" if test else "CALLS"
        if near:
            want |= {(source, name, t, kind, "SAME_FILE_LEXICAL") for t in near}
        elif far:
            want |= {(source, name, t, kind, "CROSS_FILE_HEURISTIC") for t in far}
        elif len(ids) == 1:
            want.add((source, name, *ids, kind, "CROSS_FILE_HEURISTIC"))
        elif ids:
            want.add((source, name, None, kind, "UNRESOLVED"))
    got = resolve.calls(table(spark, calls, "source string, path string, name string, is_test boolean"), table(spark, symbols, "id string, name string, path string"), table(spark, imports, "path string, target_path string"))
    rows = [tuple(r) for r in got.select("source", "name", "target", "kind", "tier").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_modules_without_packages(spark):
    wanted = table(spark, [("a/b.js", "pkg", False), ("a/b.js", "./c", True), ("a/b.js", "/c", False)], "from_path string, specifier string, typed boolean")
    files = table(spark, [("a/c.tsx",), ("a/c/index.js",)], "path string")
    got = {r.specifier: (r.target, r.reason) for r in resolve.modules(wanted, files, table(spark, [], "folder string, entry string")).collect()}
    assert got == {"pkg": (None, "no_node_modules"), "./c": ("a/c.tsx", "relative"), "/c": ("a/c/index.js", "relative")}


def test_rules(spark):
    edges = table(spark, [("a/x", "b/y", "IMPORTS"), ("a/x", None, "IMPORTS")], "source string, target string, kind string")
    assert policy.evaluate(edges, []).isEmpty()
    both = policy.evaluate(edges, [{"id": "one", "from": "a/**"}, {"id": "two", "to": "b/*"}, {"id": "no", "from": "a/*", "kinds": ("CALLS",)}])
    assert sorted(r.rule for r in both.collect()) == ["one", "two"]


def test_diverse_evidence_against_plain_code(spark):
    rng = random.Random(3)
    kinds = list(context.PRIORITY)
    rows = [("g", f"p{rng.randrange(3)}", i, rng.choice(kinds[:4]), rng.randrange(6)) for i in range(90)] + [("g", f"q{i}", i, "function", 5) for i in range(3)]
    for most in (3, 8, 14):
        by = sorted(rows, key=lambda r: (-r[4], r[1], r[2]))
        want: list = []
        first = [next(r for r in by if r[1] == p) for p in dict.fromkeys(r[1] for r in by)]
        first += [next(r for r in by if r[3] == k) for k in context.KIND_ORDER if any(r[3] == k for r in by)]
        for r in dict.fromkeys(first):
            if len(want) < most:
                want.append(r)
        for r in by:
            if r not in want and len(want) < most and sum(w[3] == r[3] for w in want) < 4 and sum(w[1] == r[1] for w in want) < 5:
                want.append(r)
        df = table(spark, rows, "role string, path string, line int, kind string, score int")
        assert {tuple(r) for r in context.diverse(df, "role", most).collect()} == set(want)


def test_test_lines_and_trimming(spark):
    text = ["#[test]", "", "async fn checks_the_file() {", "  call();", "}", "#[tokio::test]", "// note", "fn file_two() {", "fn file_two() {"]
    lines = table(spark, [("a.rs", i + 1, t) for i, t in enumerate(text)], "path string, line int, text string")
    got = {r.line: r.kind for r in context.evidence(lines, ["file", "call"]).collect()}
    assert got == {3: "test", 4: "call-site", 8: "function"}
    spans = table(spark, [("a.rs", 4, 4), ("a.rs", 99, 120), ("a.rs", -3, 0)], "path string, start int, end int")
    got = {r.start: (r.from_line, r.to_line, r.reason, r.kept_to, r.truncated) for r in context.trim(lines, spans, 40).collect()}
    assert got == {4: (3, 4, "block", 4, False), 99: (9, 9, "open_only", 9, False), -3: (1, 4, "close_only", 3, True)}


def test_seals_and_phases(spark):
    claims = table(spark, [(1, ["a", "b", "a"]), (2, ["b"])], "id int, paths array<string>")
    files = table(spark, [("a", "1"), ("b", "2")], "path string, content_hash string")
    verdicts = table(spark, [(1, "stale"), (2, "supported")], "id int, verdict string")
    sealed = truth.seal(claims, verdicts, files)
    again = truth.seal(table(spark, [(1, ["b", "a"]), (2, ["b"])], "id int, paths array<string>"), verdicts, files)
    marks = {r.id: r.decision_fingerprint for r in sealed.collect()}
    assert marks == {r.id: r.decision_fingerprint for r in again.collect()} and len(set(marks.values())) == 2
    with pytest.raises(ValueError, match="the first is 1"):
        truth.seal(claims, verdicts, files.where("path = 'b'"))
    with pytest.raises(ValueError, match="the first is 2"):
        truth.seal(claims, verdicts.where("id = 1"), files)
    held = truth.decisions_current(sealed, table(spark, [(1, "keep", marks[1])], "id int, decision string, input_fingerprint string"))
    assert {r.id: r.current for r in held.collect()} == {1: True, 2: False}
    good = {"graph_state": "fresh", "manifest": "g", "understanding": "g", "verdicts": "g", "pending": 0, "documents": "g", "workflow": True}
    assert truth.completion("g", good, held) == {"state": "complete", "phases": {"phase1": "complete", "phase2": "complete", "phase3": "complete", "phase4": "complete"}, "reasons": []}
    lost = held.withColumn("current", F.lit(False))
    assert truth.completion("g", good, lost)["reasons"] == ["pending_reconciliation"]
    assert truth.completion("g", good)["phases"]["phase4"] == "not_required"
    bad = truth.completion("g", {"graph_state": "stale", "manifest": "f", "pending": 2, "documents": "g"})
    assert bad["state"] == "incomplete" and bad["reasons"] == ["graph_stale", "stale_manifest", "missing_understanding", "missing_verdicts", "verification_pending", "missing_workflow"]


def test_graph_status(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    files = table(spark, [("a", "1"), ("b", "2")], "path string, content_hash string")
    status = lambda df=files, **k: maintenance.graph_status(spark, root, df, **k)["state"]
    assert status() == "missing"
    store.publish(root, 1, {"files": files}, versions={"lexical": "1"})
    assert status() == "fresh" and status(versions={"lexical": "1"}) == "fresh" and status(versions={"lexical": "2"}) == "stale"
    assert maintenance.graph_status(spark, root, files.where("path = 'a'")) == {"state": "stale", "pending": 1}
    assert status(truncated=True) == "indeterminate"
    store.publish(root, 2, {"nodes": files})
    assert status() == "incomplete"
    (tmp_path / "store/manifests/0000000003.json").write_text("{not json")
    assert status() == "corrupt"
    assert maintenance.source_signature(files) == maintenance.source_signature(files.orderBy(F.desc("path"))) != maintenance.source_signature(files.where("path = 'a'"))


def test_journal_goes_on(spark):
    events = table(spark, [("./a/../b", "update", None, 5, 2), ("c", "rename", "d//e", 4, 1)], "path string, event_kind string, rename_to string, observed_ms long, n int")
    got = [tuple(r) for r in maintenance.append(events, 41, ["n"]).orderBy("seq").collect()]
    assert got == [(42, 4, "rename", "c", "d/e", 42, 0), (43, 5, "modify", "b", None, 43, 0)]
    assert maintenance.high_water(maintenance.append(events, 41, ["n"])) == 43
    assert maintenance.high_water(events.where("false").withColumn("source_clock", F.lit(1))) == 0
    assert maintenance.barrier_p95(table(spark, [], "seq long, ms long")).first().p95 is None


def test_working_tree_and_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for name in ("kept", "gone", "moved", "edited"):
        (tmp_path / name).write_text(name * 20)
    run("add", ".")
    run("-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x")
    (tmp_path / "gone").unlink()
    run("mv", "moved", "there")
    (tmp_path / "edited").write_text("new")
    (tmp_path / "fresh").write_text("new")
    status = adapters.working_tree(spark, str(tmp_path))
    assert {r.path: r.status for r in status.collect()} == {"gone": "deleted", "there": "renamed", "edited": "modified", "fresh": "untracked"}
    there = table(spark, [("kept",), ("there",), ("edited",)], "path string")
    found = adapters.dirty_files(status, there)
    assert {r.path: r.score for r in found.candidates.collect()} == {"gone": 0.6, "there": 0.92, "edited": 0.95}
    assert [r.reason for r in found.omissions.collect()] == ["dirty_missing"]
    head = adapters.git_metadata(spark, str(tmp_path)).candidates.first()
    assert head.id.startswith("git-metadata:main:") and head.score == 0.6
    assert adapters.git_metadata(spark, str(tmp_path / "none")).candidates.isEmpty() and adapters.working_tree(spark, str(tmp_path / "none")).isEmpty()


def test_vector_scan(spark):
    rows = table(spark, [("a", [1.0, 0.0], "m"), ("b", [0.0, 1.0], "m"), ("c", [1.0], "m"), ("d", [1.0, 0.0], "k")], "id string, v array<double>, model string")
    hits, told = ranking.vector_scan(rows, [1.0, 0.0], 5, 0.5, "m")
    assert [r.id for r in hits.collect()] == ["a"] and tuple(told.first()) == (3, 1)
    hits, told = ranking.vector_scan(rows, [0.0, 0.0])
    assert hits.isEmpty() and tuple(told.first()) == (0, 0)


def test_symbols_of_no_text(spark):
    assert extract.symbols(table(spark, [("a.py", None), ("b.js", "")], "path string, text string")).isEmpty()
