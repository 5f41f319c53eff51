"""Files, extraction, generations, the journal as a stream, and the facade."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evgraph.functions import text as X
from evgraph.operators import documents, extract, resolve, service
from evgraph.sources import repository, store
from evgraph.streaming import journal

TS = "import { a } from './lib/a';\nexport class Cart {\n  constructor() {}\n  total(x) {\n    return price(x);\n  }\n}\nexport const add = (x) => x + 1;\nfunction price(v) { return v; }\n"
PY = "import os\nfrom .core import run\n\nclass A:\n    def go(self):\n        return run()\n\ndef main():\n    A().go()\n"


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/cart.ts").write_text(TS)
    (tmp_path / "src/app.py").write_text(PY)
    (tmp_path / "src/zero.bin").write_bytes(b"a\0b")
    (tmp_path / "logo.png").write_bytes(b"\x89PNG\0")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor/x.js").write_text("function v() {}\n")
    return str(tmp_path)


def test_scan(spark, repo):
    files = repository.scan_sources(spark, repo)
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"src/cart.ts", "src/app.py", "logo.png", "vendor/x.js"}
    assert got["logo.png"].content_hash == "size:5" and got["logo.png"].text is None
    assert {r.path for r in repository.ignored(files, ["vendor"]).collect()} == {"src/cart.ts", "src/app.py", "logo.png"}
    with pytest.raises(ValueError):
        repository.ignored(files, ["../x"])
    assert repository.scan_metadata(spark, repo).count() == 5
    assert repository.parse_cache(files, files, 1, 1).isEmpty() and repository.parse_cache(files, files, 2, 1).count() == 4


def test_walk_has_caps(spark, repo):
    files, why = repository.walk_tree(spark, repo)
    assert {r.path for r in files.collect()} == {"src/cart.ts", "src/app.py", "src/zero.bin", "logo.png", "vendor/x.js"} and why == []
    files, why = repository.walk_tree(spark, repo, entries=2)
    assert files.isEmpty() and why == ["directory_entry_limit"]
    files, why = repository.walk_tree(spark, repo, folders=2, most=5)
    assert {r.path for r in files.collect()} == {"logo.png", "src/zero.bin"} and why == ["directory_limit"]


def test_stable_read(repo, monkeypatch):
    raw, digest = repository.stable_read(f"{repo}/src/zero.bin")
    assert raw == b"a\0b" and len(digest) == 64
    read = repository.Path.read_bytes

    def moving(path):
        got = read(path)
        path.write_bytes(got + b"!")
        return got

    monkeypatch.setattr(repository.Path, "read_bytes", moving)
    with pytest.raises(OSError, match="changes while"):
        repository.stable_read(f"{repo}/src/zero.bin")


def test_doc_map_file(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"nodes": [{"id": "doc:a", "kind": "doc", "path": "a.md"}, {"id": "c", "kind": "claim", "text": "x", "status": "stale"}], "edges": [{"from": "doc:a", "to": "c", "type": "contains"}]}')
    got = repository.read_doc_map(spark, f"{tmp_path}/map.json")
    assert {r.id: r.status for r in got["nodes"].collect()} == {"doc:a": None, "c": "stale"} and tuple(got["edges"].first()) == ("doc:a", "c", "contains")
    (tmp_path / "bad.json").write_text("{not json")
    assert repository.read_doc_map(spark, f"{tmp_path}/bad.json") is None and repository.read_doc_map(spark, f"{tmp_path}/none.json") is None


def test_configured_languages(spark, tmp_path):
    (tmp_path / "g.bin").write_bytes(b"grammar")
    (tmp_path / "own.json").write_text('[["Rule", "^rule (\\\\w+)"]]')
    one = lambda **x: "[[languages]]\n" + "".join(f"{k} = {v!r}\n" for k, v in x.items())
    good = one(id="own", extensions=["own"], grammar="g.bin", table="own.json", precision_tier="AST")
    bad = one(extensions=["x"]) + one(id="rust", extensions=["x"], grammar="g.bin") + one(id="a", extensions=["py"], grammar="g.bin") + one(id="b", extensions=["b"], grammar="../g.bin") + one(id="c", extensions=["c"], grammar="none") + one(id="d", extensions=["d"], grammar="g.bin", grammar_sha256="00")
    (tmp_path / "languages.toml").write_text(good + bad)
    languages, wrong = repository.custom_languages(str(tmp_path))
    assert [x["id"] for x in languages] == ["own"] and len(wrong) == 6 and any("another digest" in w for w in wrong)
    files = spark.createDataFrame([("x.own", "rule first\n\nrule second\n"), ("x.other", "rule third")], "path string, text string")
    assert [(r.kind, r.name) for r in extract.symbols(files, languages).orderBy("start_line").collect()] == [("Rule", "first"), ("Rule", "second")]
    assert repository.custom_languages(str(tmp_path / "none")) == ([], [])


def test_symbols(spark, repo):
    files = repository.scan_sources(spark, repo)
    got = {(r.path, r.kind, r.qualified, r.start_line, r.end_line, r.tier) for r in extract.symbols(files).collect()}
    assert ("src/cart.ts", "Class", "Cart", 2, 7, "LEXICAL") in got
    assert ("src/cart.ts", "Method", "Cart.total", 4, 6, "LEXICAL") in got
    assert not any(q == "Cart.constructor" for _, _, q, *_ in got)
    assert ("src/app.py", "Method", "A.go", 5, 6, "AST") in got and ("src/app.py", "Function", "main", 8, 9, "AST") in got
    assert extract.python_symbols("class A:\n  def b(self):\n    x = (\n") == [("Class", "A", "A", 1, 3, "LEXICAL"), ("Method", "b", "A.b", 2, 3, "LEXICAL")]
    assert {(r.path, r.specifier) for r in extract.imports(files).collect()} == {("src/cart.ts", "./lib/a"), ("src/app.py", "os"), ("src/app.py", ".core")}


def test_facts(spark):
    lines = spark.createDataFrame([("Dockerfile", 1, "FROM python:3"), ("Dockerfile", 2, "# EXPOSE 1"), ("Dockerfile", 3, "EXPOSE 80"), ("a.js", 1, "app.get('/x', h)")], "path string, line int, text string")
    assert {(r.kind, r.name) for r in extract.facts(lines.where("path = 'Dockerfile'"), "docker").collect()} == {("USES", "python:3"), ("DEPLOYS", "80")}
    assert [(r.kind, r.name) for r in extract.facts(lines, "http").collect()] == [("ROUTES_TO", "/x")]
    tasks = spark.createDataFrame([("t", "see src/a.ts#run and src/b.py:3-9")], "task string, text string")
    assert {(r.path, r.symbol, r.start, r.end) for r in extract.task_anchors(tasks).collect()} == {("src/a.ts", "run", 0, 0), ("src/b.py", None, 3, 9)}


def test_call_tiers(spark):
    symbols = spark.createDataFrame([("f1:a", "run", "f1"), ("f1:b", "go", "f1"), ("f2:r", "run", "f2"), ("f3:x", "only", "f3"), ("f4:d", "dup", "f4"), ("f5:d", "dup", "f5")], "id string, name string, path string")
    calls = spark.createDataFrame([("f1:b", "f1", "run", False), ("f1:b", "f1", "only", False), ("f1:b", "f1", "dup", False)], "source string, path string, name string, is_test boolean")
    none = spark.createDataFrame([], "path string, target_path string")
    got = {r.name: (r.target, r.tier) for r in resolve.calls(calls, symbols, none).collect()}
    assert got == {"run": ("f1:a", "SAME_FILE_LEXICAL"), "only": ("f3:x", "CROSS_FILE_HEURISTIC"), "dup": (None, "UNRESOLVED")}
    imports = spark.createDataFrame([("f1", "f4")], "path string, target_path string")
    assert {r.name: r.target for r in resolve.calls(calls, symbols, imports).collect()}["dup"] == "f4:d"


def test_text(spark):
    row = spark.range(1).select(X.normal_path(F.lit("a/./b/../c")).alias("p"), X.query_terms(F.lit("findTheUser of user_id")).alias("q"), X.slug(F.lit(" A b! ")).alias("s"), X.redact(F.lit("api_key = abc")).alias("r"), X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c"), X.parents(F.lit("a/b/c")).alias("u"), X.classify_status(F.lit("not implemented yet, partial")).alias("st")).first()
    assert row.p == "a/c" and row.q == ["find", "user", "user_id"] and row.s == "a-b" and row.r == "api_key = [REDACTED]" and row.c is None and row.u == ["a/b", "a", ""] and row.st == "planned"


def test_documents(spark):
    lines = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(["> Superseded by `new.md` on 2025-01-02", "# Head", "The parser is implemented fully", "```", "# not a head", "```", "text", "// TODO(ann): tidy up"])], "doc_id string, line int, text string")
    got = {r.line: (r.in_fence, r.heading) for r in documents.structure(lines).collect()}
    assert got[5] == (True, "Head") and got[7] == (False, "Head") and got[1] == (False, None)
    assert [(r.line, r.status) for r in documents.claims(lines).collect()] == [(3, "implemented")]
    life = documents.lifecycle(lines, spark.createDataFrame([("new.md",)], "path string")).first()
    assert (life.lifecycle, life.target, str(life.on), life.resolved) == ("superseded", "new.md", "2025-01-02", True)
    (c,) = documents.comment_claims(lines.withColumn("path", F.lit("p"))).collect()
    assert (c.kind, c.owner, c.body, c.line) == ("TODO", "ann", "tidy up", 8)


def test_generations(spark, tmp_path):
    root, t = f"file://{tmp_path}/store", spark.range(5).withColumn("x", F.lit("a"))
    assert store.manifest(spark, root) is None
    one = store.publish(root, 1, {"t": t})
    two = store.publish(root, 2, {"t": t.repartition(3)})
    assert one["id"] == two["id"] and store.manifest(spark, root)["number"] == 2
    assert store.publish(root, 3, {"t": t.where("id > 0")})["id"] != one["id"]
    assert store.current(spark, root, "t").count() == 4 and store.current(spark, root, "t", below=3).count() == 5


def test_delta_equals_cold(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    new = spark.createDataFrame([("b", 3)], "path string, v int")
    got = journal.apply_delta(old, new, spark.createDataFrame([("b",), ("c",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 3)]
    leaves = got.select("path", F.col("v").cast("string").alias("digest"))
    assert journal.merkle(leaves, 1).first().digest != journal.merkle(old.select("path", F.col("v").cast("string").alias("digest")), 1).first().digest


def test_renames_batch_and_stream(spark, tmp_path):
    rows = [("x", 1, 1000, "delete"), ("x", 2, 1040, "create"), ("y", 3, 1000, "delete"), ("y", 4, 1090, "create"), ("z", 5, 1000, "create")]
    df = spark.createDataFrame(rows, "name string, seq long, observed_ms long, event_kind string")
    assert [tuple(r) for r in journal.rename_pairs(df).collect()] == [("x", 1, 2)]
    df.withColumn("ts", F.timestamp_millis("observed_ms")).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    q = journal.rename_stream(journal.stream(spark, f"{tmp_path}/in", schema)).writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("pairs").collect()] == [("x", 1, 2)]


def test_barrier():
    assert journal.barrier(5, 5, False, 0) == "caught_up" and journal.barrier(1, 5, True, 0) == "gap_blocked" and journal.barrier(1, 5, False, 2000) == "timeout" and journal.barrier(1, 5, False, 10) == "wait"


def test_service(spark):
    g = service.Grants(b"k")
    g.issue("t", "g1", ["src/**/a?.py"], 1, now=0)
    assert g.check("t", "g1", "src/x/a1.py", now=1) == (True, "ok") and g.check("t", "g1", "src/x/b.py", now=1) == (False, "outside_scope")
    assert g.check("t", "g2", "src/x/a1.py", now=1)[1] == "generation_changed" and g.check("t", "g1", "src/x/a1.py", now=99)[1] == "expired"
    g.held["t"]["paths"] = ["**"]
    assert g.check("t", "g1", "x", now=1)[1] == "bad_signature"
    a = service.Admission()
    assert a.orient("s", "t", "r", "g")["decision"] == "allow" and a.orient("s", "t", "r", "g")["decision"] == "noop" and a.orient("s", "t", "r", "g", "degraded")["decision"] == "block"
    assert a.expand("s", "t", "r", "g", ["x"])["decision"] == "continue" and a.revoke("s", "t", "r", "g")["decision"] == "allow" and a.status("s", "t", "r", "g")["decision"] == "block"
    nodes = spark.createDataFrame([("a", "file", "one", "a.py"), ("b", "file", "two", "b.py"), ("c", "file", "two", "c.py")], "id string, kind string, name string, path string")
    edges = spark.createDataFrame([("a", "b", "IMPORTS", "EXACT_RESOLUTION"), ("b", "c", "IMPORTS", "EXACT_RESOLUTION")], "source string, target string, kind string, tier string")
    graph = service.Graph(nodes, edges)
    assert graph.resolve("one") == "a"
    with pytest.raises(LookupError):
        graph.resolve("two")
    shown, between, at = graph.page("one", 2, budget=1000)
    assert [r.id for r in shown.collect()] == ["a", "b", "c"] and [(r.source, r.target) for r in between.collect()] == [("a", "b"), ("b", "c")] and at is None
    shown, between, at = graph.page("one", 2, budget=12)
    assert [r.id for r in shown.collect()] == ["a"] and between.isEmpty() and at == (1, 0)
    assert [r.id for r in graph.page("one", 2, budget=1000, after=at)[0].collect()] == ["b", "c"]
    assert service.json_lines(nodes.where("id = 'a'")).first().line == '{"id":"a","kind":"file","name":"one","path":"a.py"}'
    assert [r.id for r in graph.neighbors("one").collect()] == ["a", "b"] and {r.id for r in graph.impact("c").collect()} == {"a", "b"}
    assert "n0 -->|IMPORTS| n1" in graph.diagram("one") and service.tabular(nodes).first().line == "a\tfile\tone\ta.py"
    pack = service.evidence_pack("r", "g", [{"id": "a", "path": "a.py"}], [])
    assert "`a.py`" in service.evidence_markdown(pack) and service.budget_verdict(None, 1) == "unproven"
