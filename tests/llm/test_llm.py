"""The corpus operators against brute force, exact round trips and held-out accuracy; odd inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evgraph.llm import ann, common, decontaminate, language_id, near_dup, packing, quality, registry, sentencepiece_scan, substring_dedup, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "alpha beta " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, an extra column with a clashing name."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(40, 70):  # near copies, copies, and passages that others hold
        w = rng.choice(base).split()
        if k % 3 == 0 and len(w) > 40:
            w[rng.randrange(len(w))] = "edit"
        elif k % 3 == 1:
            w = rng.choice(base).split()[:60] + w[:50]
        rows.append((k, " ".join(w).upper() if k % 5 == 0 else "  ".join(w)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, LONG), (104, "é ü 日本"), (105, "one two"), (106, "ONE two"), (107, "a" * 5000), (None, base[0]), (3, base[3])]
    return spark.createDataFrame([(i, t, "key", 1.5) for i, t in rows], "doc_id long, text string, id string, score double")


def collected(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_words_are_those_of_the_pattern():
    texts = [None, "", " a\tb\x0bc  d\n", "é\u00a0x y", "x" * 40, "\n\n", "tail"]
    buf, off = common.utf8(pa.array(texts))
    starts, ends, begins = common.words(buf, off)
    got = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(begins).tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = common.word_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(set(got))


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_substring_dedup(spark, docs):
    rows = [(substring_dedup.LAST if i is None else i, WORD.findall(t or "")) for i, t in collected(docs)]
    first: dict = {}
    for i, w in rows:
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    want = []
    for i, w in rows:
        cover = bytearray(len(w))
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                cover[k : k + 20] = b"\1" * 20
        kept = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        want.append((None if i == substring_dedup.LAST else i, len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 60_000
    assert substring_dedup.dedup(docs.where("false")).isEmpty()


def test_substring_dedup_of_rows_that_share_a_key(spark, sf):
    """Each row loses its own repeats: several null keys, and one key with different texts."""
    rng = random.Random(21)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    said = fill(60)
    texts = [(1, fill(5) + said), (None, fill(40)), (None, fill(12) + said + fill(9)), (None, fill(70)), (None, said[5:40]), (None, fill(90)), (7, fill(90)), (7, fill(3) + said[:30]), (7, said[10:] + fill(2)), (8, fill(30))]
    rows = [(n, i, w) for n, (i, w) in enumerate(texts)]
    rows.append((len(rows), *texts[7]))  # the same row twice
    first: dict = {}
    for _, i, w in rows:
        for k in range(len(w) - 19):
            at = (substring_dedup.LAST if i is None else i, k)
            first[tuple(w[k : k + 20])] = min(first.get(tuple(w[k : k + 20]), at), at)
    want = {}
    for n, i, w in rows:
        cover = bytearray(len(w))
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (substring_dedup.LAST if i is None else i, k):
                cover[k : k + 20] = b"\1" * 20
        want[n] = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
    df = spark.createDataFrame([(i, " ".join(w), len(" ".join(w)), n) for n, i, w in rows], "doc_id long, text string, n_chars long, n int").repartition(3)
    got = [(r.doc_id, r.n_words, r.kept_sha256) for r in substring_dedup.dedup(df).collect()]
    assert sorted(got, key=str) == sorted(((i, len(w), hashlib.sha256(want[n].encode()).hexdigest()) for n, i, w in rows), key=str)
    out = substring_dedup.substring_stage(spark, df, sf)
    assert out.columns == df.columns
    got = [(r.n, r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((n, i, want[n], len(want[n])) for n, i, _ in rows), key=str)
    assert sum(len(want[n].split()) < len(w) for n, _, w in rows) == 5


# --- 2, 7 ------------------------------------------------------------------------------------------------------------


def test_scan_is_optimal_and_exact():
    m = sentencepiece_scan.model(sentencepiece_scan.vocabulary_path())
    value = lambda ids: sum(m.score.get(m.pieces[i], 0.0) for i in ids)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeo  éñ😀\n日") for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["x" * 3000, " lead", "two  gaps", "end "]
    texts += ["aaaa bbbb " * 90, "aaaabbbb" * 40]  # many best paths
    for x in texts:
        brute, best = list(sentencepiece_scan.short(m, " " + x)), [0.0]
        s = " ".join(["", *x.split(" ")]).replace(" ", sentencepiece_scan.SPACE)
        for i in range(1, len(s) + 1):  # by all pieces that end here
            best.append(max(best[j] + (m.score.get(s[j:i], m.unknown if i - j == 1 else -1e18)) for j in range(max(0, i - m.longest), i)))
        unknown = sum(m.unknown for c in s if c not in m.score)
        assert value(brute) + unknown == best[-1]
        for size in (1, 3, 7, 20, 512):  # one rule for ties, wherever the text is cut
            assert sentencepiece_scan.scan(m, " " + x, size) == brute
        assert sentencepiece_scan.encode(m, x) == brute and sentencepiece_scan.decode(m, brute) == x


def test_combination_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, (1, 5, 5)).astype(float) for _ in range(3))
    x = sentencepiece_scan.combine
    assert (x(x(a, b), c) == x(a, x(b, c))).all()


def test_encoded(spark, docs):
    m = sentencepiece_scan.model(sentencepiece_scan.vocabulary_path())
    odd = spark.createDataFrame([(7, "aaaa bbbb " * 9000, "k", 1.0), (7, "aaaa bbbb " * 9000, "k", 1.0), (8, "x" * 70_000, "k", 1.0), (9, "é" * 32_767 + "a" * 3, "k", 1.0)], docs.schema)
    got = sentencepiece_scan.encoded(docs.union(odd), keep=("text",), giant=300).collect()
    assert len(got) == docs.count() + 4 and all(r.decodes and len(r.ids) == r.n_tokens for r in got)
    for r in got:  # the split over tasks gives what one task gives
        assert (r.text or "") == sentencepiece_scan.decode(m, r.ids)
        assert r.ids == sentencepiece_scan.encode(m, r.text)
    assert sentencepiece_scan.encoded(docs.where("false")).isEmpty()


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(100):
        most = rng.choice([5, 8, 16, 33])
        sizes = np.array([rng.randint(1, most) for _ in range(rng.randint(1, 60))])
        free: list[int] = []
        for n in sorted(sizes.tolist(), reverse=True):
            fits = [(f, k) for k, f in enumerate(free) if f >= n]
            if not fits:
                free.append(most)
                fits = [(most, len(free) - 1)]
            free[min(fits)[1]] -= n
        rows = packing.best_fit_decreasing(sizes, most)
        assert len(rows) == len(free) and sorted(sum(rows, [])) == list(range(len(sizes)))
        assert sorted(most - sizes[r].sum() for r in rows) == sorted(free)


def test_packing_loses_nothing(spark, docs, tmp_path):
    packing.write_packed(packing.packed(docs, row=64, load=5000), f"{tmp_path}/packed")
    parts: dict = {}
    for r in packing.read_packed(spark, f"{tmp_path}/packed").collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(r.doc_ids[k], []).append((r.doc_offsets[k], ids[a:b].tolist()))
    packing.write_matrices(packing.packed(docs, row=64, load=5000), f"file://{tmp_path}/raw")
    back = packing.read_matrices(spark, f"file://{tmp_path}/raw").collect()
    assert sorted((bytes(r.ids), r.cu_seqlens, bytes(r.positions)) for r in back) == sorted((bytes(r.ids), r.cu_seqlens, bytes(r.positions)) for r in packing.packed(docs, row=64, load=5000).collect())
    packing.write_matrices(packing.packed(docs.where("false")), f"file://{tmp_path}/none")
    assert packing.read_matrices(spark, f"file://{tmp_path}/none").isEmpty() and packing.packed(docs.where("false")).isEmpty()
    code, end = packing.encoder(packing.vocabulary_path())
    for i, t in collected(docs):
        if i not in (3, None):  # keys of two rows
            assert sum((p for _, p in sorted(parts[i])), []) == [*code.encode_ordinary(t or ""), end]


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 30), i) for i in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_warc(spark, monkeypatch):
    rows = [(1, "http://b.com/x", "<p>é</p>"), (2, "http://a.com/", None), (3, None, ""), (4, "http://b.com/x", "<p>é</p>"), (5, "http://a.com/?q", "y" * 200_000), (6, "bad", "<p>é</p>"), (7, "http://a.com/", "r\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha string").repartition(4)
    monkeypatch.setattr(warc, "FAN_IN", 1)  # merged in several passes
    monkeypatch.setattr(warc, "RANGE_ROWS", 2)
    got = warc.captures(pages).collect()
    for page, _, html in rows:
        (r,) = [x for x in got if x.page_id == page]
        body = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == page else "revisit", None if first == page else first)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
    order = [(r.url_key, r.captured, r.page_id) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert order == sorted(order) and len(got) == len(rows)
    assert all(r.record_type == "response" for r in warc.captures(pages.where("page_id in (2, 3)"), least=1).collect())
    odd = spark.createDataFrame([(None, "u", "<p>é</p>"), (None, "v", "own"), (None, "v", "own"), (1 << 60, "v", "<p>é</p>"), (-(1 << 63), "w", "z"), (-1, "w", "z"), ((1 << 63) - 1, "w", "z"), (5, "w", "q"), (5, "w", "q")], "page_id long, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.captures(odd).collect()]
    low, high = -(1 << 63), (1 << 63) - 1
    want = [(None, 9, "revisit", 1 << 60), (None, 3, "response", None), (None, 3, "response", None), (1 << 60, 9, "response", None), (low, 1, "response", None), (-1, 1, "revisit", low), (high, 1, "revisit", low), (5, 1, "response", None), (5, 1, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.captures(pages.where("false")).isEmpty()


def test_runs_are_read_by_range(tmp_path, monkeypatch):
    """Both levels of a run's index: any range gives its entries, and reads few blocks."""
    monkeypatch.setattr(warc, "STRIDE", 3)
    monkeypatch.setattr(warc, "LEAF", 4)
    rng = random.Random(8)
    entries = sorted((f"k{rng.randrange(60):02d}", f"{rng.randrange(3)}", i, "f", i, 1) for i in range(500))
    fs = warc.pafs.LocalFileSystem()
    n, samples = warc.write_run(fs, f"{tmp_path}/run", iter(entries))
    assert n == 500 and samples == sorted(samples)
    framed, met = warc._framed, []
    monkeypatch.setattr(warc, "_framed", lambda f, at: met.append(at) or framed(f, at))
    for _ in range(60):
        lo, hi = (rng.choice([None, e[:3], (f"k{rng.randrange(70):02d}", "", 0)]) for e in rng.sample(entries, 2))
        assert list(warc.read_run(fs, f"{tmp_path}/run", lo, hi)) == [e for e in entries if (lo is None or e[:3] >= lo) and (hi is None or e[:3] < hi)]
    met.clear()
    assert len(list(warc.read_run(fs, f"{tmp_path}/run", entries[200][:3], entries[203][:3]))) == 3 and len(met) <= 6
    assert warc.write_run(fs, f"{tmp_path}/none", iter(())) == (0, []) and list(warc.read_run(fs, f"{tmp_path}/none")) == []


# --- 4, 9 ------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op4_quality_classifier(spark, d)
    lab = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = got.join(lab, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, LONG), (None, "x")], "doc_id long, text string")
    model = quality.fit(odd, spark.createDataFrame([(1, 1), (2, None), (9, 0)], "doc_id long, quality int"))
    assert {r.quality_score for r in quality.score(odd, model).collect()} == {0.5}
    assert spark.range(1).select(common.bucket_of(F.lit(1), 3).alias("h")).first().h == zlib.crc32(b"1") % 3


def test_quality_fit_is_that_of_the_definition(spark):
    """The model against a plain one: log-count ratios, unit vectors, and a hinge loss that no small step lessens."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("good fine well" .split() if i % 2 else "bad poor ill".split()) if rng.random() < 0.4 else f"w{rng.randrange(30)}" for _ in range(25))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels, buckets=1 << 10)
    xs = list(quality.indicators(pa.array([t for _, t in rows]), 1 << 10))
    p, q = ([quality.ALPHA + sum(b in x for i, x in enumerate(map(set, xs)) if i % 2 == y) for b in range(1 << 10)] for y in (1, 0))
    ratio = np.log(np.array(p) / sum(p)) - np.log(np.array(q) / sum(q))
    assert np.allclose(model["scale"], ratio**2)
    unit = np.zeros((60, 1 << 10))
    for i, x in enumerate(xs):
        unit[i, x] = ratio[x]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    y = np.where(np.arange(60) % 2 == 1, 1.0, -1.0)
    w = np.divide(model["w"], ratio, out=np.zeros(1 << 10), where=ratio != 0)
    loss = lambda w, b: (w @ w + b * b) / 2 + quality.C * np.maximum(0, 1 - y * (unit @ w + b)).sum()
    least, step = loss(w, model["bias"]), np.random.default_rng(0)
    assert all(least <= loss(w + d, model["bias"] + e) + 0.02 * least for d, e in ((0.3 * step.normal(size=1 << 10) / 32, 0.1 * step.normal()) for _ in range(50)))
    assert least < 0.5 * loss(0 * w, 0.0)


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [(i % 20, " ".join(rng.choice(["a", "b", "c", "d", str(i % 2)]) for _ in range(12))) for i in range(60)]  # three texts a key
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    one, two = (quality.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, max_train=12) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert (one["w"] == two["w"]).all() and one["bias"] == two["bias"] and one["w"].any()


def test_language_is_naive_bayes_and_blocks_decide_nothing(spark):
    """Against a plain multinomial naive Bayes over the same buckets; and in blocks of two languages."""
    rng = random.Random(13)
    parts = {x: [f"{x}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(6)] for x in ("ba", "ke", "zu", "mi", "to")}
    rows = [(i, " ".join(rng.choice(parts[x] if rng.random() < 0.7 else parts["ba"]) for _ in range(rng.randint(1, 12))), x) for i, x in enumerate(rng.choices(list(parts), k=80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    n = 1 << 8
    feats = {i: np.concatenate([f for f, _ in language_id._features([t], n)]) for i, t, _ in rows}
    counts = {x: np.bincount(np.concatenate([feats[i] for i, _, y in rows if x == y]), minlength=n) + language_id.ALPHA for x in parts}
    total = {x: sum(y == x for *_, y in rows) for x in parts}
    want = {}
    for i, _, _ in rows:
        z = {x: np.log((total[x] + 1) / (80 + 5)) + np.log(counts[x] / counts[x].sum())[feats[i]].sum() for x in sorted(parts)}
        top = max(z, key=z.get)
        want[i] = (top, 1 / sum(np.exp(v - z[top]) for v in z.values()))
    for block in (512, 2, 1):
        got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs, buckets=n, block=block)).collect()}
        assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
        assert all(abs(got[i][1] - want[i][1]) < 1e-4 for i in want)


def test_language(spark):
    d = "/root/testdata/sf0.01"
    rows = language_id.op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
    assert all(r.held_out == language_id.held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "fr"), (3, "12 !? ½", "fr"), (4, "the the", "en"), (5, "le le", "fr"), (6, LONG, None), (None, "日本", "ja")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, language_id.fit(odd)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "fr" and got[None][0] == "ja"
    none = language_id.fit(odd.where("false"))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}


# --- 5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_wand_finds_all_above_threshold(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    rng = random.Random(4)
    words = [f"t{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(50)]
    index = decontaminate.Index(list(range(50)), items, None)
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(40))
        h, _ = decontaminate.tokens(pa.array([text]))
        terms = np.unique(index.terms(h))
        terms = terms[terms < len(index.vocabulary)].tolist()
        brute = {}
        for t in terms:
            for k, w in zip(*index.postings[t], strict=True):
                brute[int(k)] = brute.get(int(k), 0.0) + w
        got = dict(index.wand(terms, list(range(index.fine.shape[1])), 0.3))
        assert got == pytest.approx({k: v for k, v in brute.items() if v >= 0.3})


def test_decontamination(spark, docs):
    rng = random.Random(6)
    fill = lambda n: " ".join(f"f{rng.randrange(5000)}" for _ in range(n))
    items = [(i, fill(20)) for i in range(6)] + [(6, None), (7, ""), (8, fill(300))]
    planted = [(1000 + i, fill(rng.randint(0, 300)) + " " + (items[i][1].upper().replace(" ", ", ") if i % 2 else items[i][1]) + " " + fill(rng.randint(0, 300))) for i in range(6)]
    planted += [(1010, fill(100) + " " + items[8][1] + " " + fill(50)), (1011, " ".join(items[0][1].split()[:10])), (1012, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(texts, bench).collect()}
    assert got == {(1000 + i, i) for i in range(6)} | {(1010, 8)}
    assert decontaminate.contaminated(texts, bench.where("false")).isEmpty()


def test_a_long_item_changes_nothing_for_the_others(spark):
    """Words of an item strewn over a text are no hit, with or without a long item; pieces of long items are found whole."""
    rng = random.Random(15)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    item, long = fill(20), fill(4000)
    strewn = fill(470)
    for k, w in enumerate(item):
        strewn[k * 23] = w
    texts = [(1, strewn), (2, fill(200) + item + fill(200)), (3, fill(70) + long + fill(70)), (4, long[:1500]), (5, fill(33) + long[:3400])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    short = spark.createDataFrame([(0, " ".join(item)), (0, " ".join(item))], "item_id long, text string")
    both = short.union(spark.createDataFrame([(9, " ".join(long))], short.schema))
    found = lambda bench: sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert found(short) == [(2, 0)] and found(both) == [(2, 0), (3, 9), (5, 9)]


def test_shards_of_a_benchmark_decide_nothing(spark, monkeypatch, tmp_path):
    """Equal scores in one shard and in many; items of a null key are found, and their documents go."""
    rng = random.Random(11)
    fill = lambda n: " ".join(f"f{min(rng.randrange(400), rng.randrange(400))}" for _ in range(n))
    items = [(i if i % 5 else None, fill(rng.randint(8, 40))) for i in range(60)] + [(60, fill(200)), (61, ""), (62, None)]
    texts = [(i, fill(rng.randint(0, 150)) + " " + " ".join(w for w in (t or "").split() if rng.random() > 0.04 * (i % 8)) + " " + fill(rng.randint(0, 150))) for i, (_, t) in enumerate(items)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    found = lambda: sorted(((r.doc_id, r.item_id, round(r.score, 12)) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    one = found()
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 5000)
    assert len(list(decontaminate.indexes(bench))) > 2
    assert found() == one and {d for d, i, _ in one if i is None} >= {0, 40}
    left = {r.doc_id for r in decontaminate.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    assert left == set(range(len(items))) - {d for d, _, _ in one}


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_near_duplicates(spark, docs):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    rng = random.Random(9)
    family, base = [], [f"b{i}" for i in range(200)]
    for k in range(60):  # a large group of near copies, and chains of them
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        family.append((2000 + k, " ".join(w)))
    chain = base[:]
    for k in range(12):
        chain = chain[2:] + [f"c{k}", f"d{k}"]
        family.append((3000 + k, " ".join(chain)))
    texts = docs.select("doc_id", "text").where("doc_id is null or doc_id <> 3").union(spark.createDataFrame(family, "doc_id long, text string"))
    rows = [(r.doc_id, shingles(r.text)) for r in texts.collect()]
    parent = {i: i for i, s in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in rows if s and i is not None]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            both = len(s & t)
            if 100 * both >= 85 * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_dup.classes(texts).collect()}
    assert {i: got[i].component_id for i in parent} == {i: find(i) for i in parent}
    assert all(got[i].n_shingles == len(s) for i, s in rows) and got[None].component_id is None
    assert near_dup.classes(texts.where("false")).isEmpty()


def test_near_duplicates_of_rows_that_share_a_key(spark, sf):
    """Rows of one key are documents of their own: each is linked by its own text."""
    rng = random.Random(31)
    said = {x: [f"{x}{rng.randrange(10**9)}" for _ in range(40)] for x in "wuvz"}
    near = said["u"][:]
    near[20] = "edit"
    rows = [(5, said["w"]), (5, said["u"]), (3, said["w"]), (9, near), (9, near), (7, said["v"]), (None, said["v"]), (11, []), (11, said["z"]), (2, said["z"])]
    df = spark.createDataFrame([(i, " ".join(w), n) for n, (i, w) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.classes(df, 70, 100).collect()]
    want = [(5, 36, 3), (5, 36, 5), (3, 36, 3), (9, 36, 5), (9, 36, 5), (7, 36, 7), (None, 36, None), (11, 0, 11), (11, 36, 2), (2, 36, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)
    tight = [said["w"] * 3, (said["w"] * 3)[:-1] + ["edit"]]
    stage = spark.createDataFrame([(4, " ".join(tight[0]), 0), (4, " ".join(tight[1]), 1), (4, " ".join(said["v"]), 2), (1, " ".join(tight[0]), 3), (None, " ".join(tight[0]), 4), (6, None, 5), (6, "", 6)], "doc_id long, text string, n int")
    assert {r.n for r in near_dup.near_dup_stage(spark, stage, sf).collect()} == {2, 3, 4, 5, 6}


def test_members_of_crowded_keys_lose_no_link(spark, monkeypatch):
    """Many documents that frame one text differently: alike enough to share keys, few alike enough to be linked."""
    rng = random.Random(41)
    common = [f"c{i}" for i in range(150)]
    own = [[f"o{rng.randrange(10**9)}" for _ in range(40)] for _ in range(120)]
    rows = [(i, common + w) for i, w in enumerate(own)]
    rows += [(500 + i, common + own[i][:30] + [f"x{i}"] * 9) for i in range(0, 40, 2)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for crowd in (4, 10**6):
        monkeypatch.setattr(near_dup, "CROWD", crowd)
        got = {r.doc_id: r.component_id for r in near_dup.classes(df).collect()}
        assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(sets)


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 500):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 2**63, n // 7, dtype=np.uint64)])
        (x, cx), (y, cy) = (near_dup.sketches(np.unique(s), np.array([len(s)])) for s in (a, b))
        k = min(len(x), len(y))
        x, y = (s if len(s) == k else s[:k] ^ s[k:] for s in (x, y))
        assert sum(int(v).bit_count() for v in (x ^ y)) <= len(set(a.tolist()) ^ set(b.tolist()))


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_url_filter(spark, duck):
    urls = [None, "", "nothing", "http://", "http://com/en/", "https://A.EXAMPLE.COM/en/7?x", "http://x.example.com/en/6", "http://notexample.com/en/7", "http://example.net/de/88#t", "http://a.b.net/de/", "ftp://u@h.org:80/es/q", "http://h.org/es/q", "http://com./en/", "http://.com/en/x", "a://b://com/en/"] + [f"http://h{i}.example.{'net' if i % 2 else 'com'}/{'de' if i % 3 else 'en'}/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    duck.execute("create or replace temp table odd as select unnest(?) as page_id, unnest(?) as url", [list(range(len(urls))), urls])
    want = duck.execute(url_filter.ORACLE.replace("FROM pages", "FROM odd")).fetchall()
    got = [tuple(r) for r in url_filter.judge(pages, list(url_filter.RULES)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.judge(pages.where("false"), list(url_filter.RULES)).isEmpty()


def test_lists_beyond_one_cascade(spark, monkeypatch):
    """Parted lists judge as one does; rules may be a table; a key listed as both blocks."""
    rules = [(f"h{i}.com", f"/p{i % 5}/", "block" if i % 3 else "allow") for i in range(60)] + [("com", "/p1/x", "allow"), ("h7.com", "/p2/", "allow"), ("h7.com", "/p2/", "block"), ("h8.com", "/", "allow")]
    urls = [f"http://{'w.' * (i % 3)}h{i % 70}.com/p{i % 6}/{'x' * (i % 4)}" for i in range(900)] + [None, "", "x://"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    one = sorted(tuple(r) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    for i, host, path, rule, verdict in one:
        fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)] if host else []
        longest = max((len(k) for k, _ in fit), default=0)
        best = {v for k, v in fit if len(k) == longest}
        assert verdict == ("allow" if not fit else "block" if "block" in best else "allow") and (rule is None) == (not fit) and len(rule or "") == longest
    monkeypatch.setattr(url_filter, "MAX_BYTES", 24)
    assert sorted(tuple(r) for r in url_filter.judge(pages, rules).collect()) == one
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substring(key, -1) = '7'")
    cascade = url_filter.build(universe, listed)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != (F.substring("key", -1, 1) == "7"))
    assert wrong.isEmpty()


# --- 10 --------------------------------------------------------------------------------------------------------------


def nearest(rows, queries, **more):
    books = ann.fit(rows)
    return ann.search(ann.index(rows, books), queries, books, **more)


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[7]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (None, [1.0] * 16), (9080, [1.0] * 3), (9100, []), (9120, [1.0, 2.0]), (9140, [float("inf")] * 16)]
    table = ann.clean(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert table.count() == 1500
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    exact = x.astype(float)
    for metric in ("ip", "l2"):
        got = nearest(table.repartition(3), table.where(F.col("id") % 20 == 0), metric=metric).collect()
        hit, by = 0, {}
        for r in got:
            by.setdefault(r.query_id, {})[r.rank] = r
        for q, ranks in by.items():
            s = exact @ exact[q] if metric == "ip" else -((exact - exact[q]) ** 2).sum(1)
            s[q] = -np.inf
            want = np.lexsort((np.arange(len(s)), -s))[:20]
            mine = [ranks[k].vec_id for k in range(1, 21)]
            assert all(abs(ranks[k].score - s[ranks[k].vec_id]) < 1e-9 for k in ranks)
            assert [ranks[k].score for k in range(1, 21)] == sorted((ranks[k].score for k in range(1, 21)), reverse=True)
            hit += len(set(mine) & set(want.tolist()))
        assert len(by) == 75 and hit >= 0.99 * 20 * 75
        if metric == "l2":
            assert [by[100][k].vec_id for k in range(1, 21)] == [7, *range(101, 120)]
    few = table.where("id < 5")
    assert nearest(few, few.where("id = 0"), k=20).count() == 4  # more asked for than there are
    assert nearest(table.where("false"), table.where("false")).isEmpty()
    assert nearest(few, few.where("false")).isEmpty()


def test_recall_of_a_full_part():
    """With the parameters of the query: one part of PART_ROWS vectors of no structure at all."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(ann.PART_ROWS, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.train(x[: ann.SAMPLE])
    codes = ann.encode(books, x)
    part = {"ids": np.arange(len(x)), "x": x, "codes": codes, "norms": (ann.decode(books, codes) ** 2).sum(1)}
    hit = 0
    for q, (got, _) in enumerate(ann.search_block(books, part, np.arange(100), x[:100], 20, ann.RERANK)):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(got.tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert ann.RERANK < 0.004 * ann.PART_ROWS and hit >= 0.97 * 2000


# --- the registry and the pipeline -----------------------------------------------------------------------------------


def test_registry_names_each_operator_once():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).persist()
        assert set(docs.columns) <= set(out.columns), name
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            kept = {r.doc_id for r in near_dup.classes(docs, 80, 100).where("doc_id = component_id").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        docs = out
    assert docs.where("n_tokens <> size(ids)").isEmpty() and not docs.isEmpty()
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).isEmpty()


def test_stages_let_odd_rows_and_clashing_columns_through(spark, sf):
    """Nulls, repeated keys and rows, ties, a very long text, and columns named as those that the stages make."""
    import corpus_pipeline

    rng = random.Random(17)
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(4)
    texts = [r.text for r in good.collect()]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (None, texts[2]), (None, texts[2]), (2, None), (2, ""), (3, LONG), (4, texts[3]), (4, " ".join(f"u{rng.randrange(10**9)}" for _ in range(60)))]
    own = ["quality_score", "_text_", "_kept", "ids", "n_tokens", "decodes", "_row_", "_id", "_row", "_place", "_starts", "_number", "_gone", "component_id", "id", "n", "key", "c0_", "Doc_Key"]
    fields = ", ".join(f"{c} string" for c in own)
    df = spark.createDataFrame([(i, t, 5, {"a": n}, *([f"v{n}"] * len(own))) for n, (i, t) in enumerate(rows)], f"doc_id long, text string, n_chars long, m map<string,int>, {fields}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        got = out.collect()
        if name == "sentencepiece":
            assert out.columns == [*(c for c in df.columns if c not in ("ids", "n_tokens")), "n_tokens", "ids"] and out.schema["n_tokens"].dataType.simpleString() == "int"
        else:
            assert out.columns == df.columns
            assert all(r[c] == f"v{r.m['a']}" for r in got for c in own), name
        left = [r.m["a"] for r in got]
        assert len(left) == len(set(left))
        if name in ("substring_dedup", "sentencepiece"):
            assert sorted(left) == list(range(len(rows)))
        if name == "near_duplicates":
            assert sorted(left) == [n for n in range(len(rows)) if n != 2] or sorted(left) == [n for n in range(len(rows)) if n != 0]
        assert out.where("false").isEmpty()
