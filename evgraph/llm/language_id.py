"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every training text are summed by Spark, a row per (language, bucket) of each task; the log-probability
matrix (languages x ``buckets``) is broadcast, and batches are scored by sparse sums in numpy. The matrix is a few MB
whatever the corpus; more than ``BLOCK_LANGUAGES`` are scored a block of that many after the other, each block broadcast
by itself, and the texts carry the best language so far.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, frugal, ship, table, text_slices, written

BUCKETS, ORDERS, ALPHA, BLOCK_LANGUAGES = 1 << 15, (1, 2, 3), 0.5, 512
#: Multipliers of the n-gram hash (fixed values).
MUL, ODD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
LETTER = re.compile(r"[^\W\d_]")


def _features(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all n-grams of lower-cased characters, text after text; how many each text has."""
    texts = [x.lower() for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends, acc = np.cumsum(sizes), np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(codes) - n + 1)
        acc = (acc[:m] * MUL + codes[n - 1 :]) * ODD + np.uint32(n)
        if n in ORDERS:
            ok = np.ones(m, bool)
            for k in range(1, n):  # an n-gram may not reach over the end of its text
                edge = ends - k
                ok[edge[(edge >= 0) & (edge < m)]] = False
            h = acc if n == 1 else acc[ok]
            yield (h >> np.uint32(16)).astype(np.int32) % buckets, np.maximum(sizes - n + 1, 0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, alpha: float = ALPHA, block: int = BLOCK_LANGUAGES) -> list[dict]:
    """A model from every row with a text and a language: blocks of at most ``block`` languages, in byte order. A table
    without such a row gives one block of none."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            total = np.zeros((len(names), buckets + 1), np.int64)
            total[:, -1] = np.bincount(code, minlength=len(names))  # the last bucket counts texts
            for lo, hi in text_slices(b.column(0), 1 << 20):
                for f, n in _features(b.column(0).slice(lo, hi - lo).to_pylist(), buckets):
                    at = np.repeat(code[lo:hi].astype(np.int64) * buckets, n) + f
                    total[:, :-1] += np.bincount(at, minlength=len(names) * buckets).reshape(len(names), buckets)
            for name, s in zip(names, total, strict=True):
                sums[name] = sums[name] + s if name in sums else s
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    found = written(rows.mapInArrow(frugal(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    per = {r.lang: r.n for r in found.where(F.col("bucket") == buckets).collect()}  # a row for each language
    names, out = sorted(per, key=lambda x: x.encode("utf-8", "surrogatepass")), []
    for lo in range(0, max(1, len(names)), block):
        some = names[lo : lo + block]
        counts = np.zeros((buckets, len(some)))
        if some:
            mine = found if len(names) <= block else found.where(F.col("lang").isin(some))
            got = mine.where(F.col("bucket") < buckets).toArrow()  # at most block x buckets rows
            place = {x: i for i, x in enumerate(some)}
            counts[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
        prior = np.log((np.array([per[x] for x in some], float) + 1) / (sum(per.values()) + max(1, len(names))))
        logp = np.log((counts + alpha) / (counts.sum(0) + alpha * buckets))
        out.append({"langs": some, "logp": logp.astype(np.float32).copy("F"), "prior": prior, "buckets": buckets})
    return out


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))  # word characters also hold numbers such as fractions


def weigh(block: dict, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """For each text: the best language of the block, its joint log-probability, and the log of the sum of all. A text
    without a letter, or a block without a language: null and minus infinity."""
    langs: list[str | None] = [None] * len(texts)
    top, total = (np.full(len(texts), -np.inf) for _ in range(2))
    ok = [i for i, x in enumerate(texts) if x and has_letter(x)]
    if ok and block["langs"]:
        z = np.tile(block["prior"], (len(ok), 1))
        for f, n in _features([texts[i] for i in ok], block["buckets"]):
            has = np.flatnonzero(n)
            if len(has):
                begins = np.concatenate([[0], np.cumsum(n[has])[:-1]])
                for k, logp in enumerate(block["logp"].T):
                    z[has, k] += np.add.reduceat(logp[f], begins, dtype=np.float64)
        best = z.argmax(1)
        top[ok] = z[np.arange(len(ok)), best]
        total[ok] = top[ok] + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
        for i, k in zip(ok, best, strict=True):
            langs[i] = block["langs"][k]
    return langs, top, total


def predict(docs: DataFrame, model: list[dict], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score (the posterior of the language named) of every row, from its whole text.

    A null, empty or letterless text, or a model of no language, gives ``und`` and 0. Repeated rows are judged alike;
    ties go to the language first in byte order. Further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    shape = f"key {kind}, text string, lang string, top double, total double"
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    for nth, block in enumerate(model):
        held, last = spark.sparkContext.broadcast(block), nth == len(model) - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, first=nth == 0, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi in text_slices(b.column(1), 1 << 20):
                    part = b.slice(lo, hi - lo)
                    langs, top, total = weigh(held.value, part.column(1).to_pylist())
                    if not first:
                        old, was, sums = part.column(2).to_pylist(), part.column(3).to_numpy(), part.column(4).to_numpy()
                        langs = [y if b > a or x is None else x for x, y, a, b in zip(old, langs, was, top, strict=True)]
                        top, total = np.maximum(was, top), np.logaddexp(sums, total)
                    texts = pa.nulls(len(part), pa.string()) if last else part.column(1).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), texts, pa.array(langs, pa.string()), pa.array(top), pa.array(total)], ["key", "text", "lang", "top", "total"])

        out = out.mapInArrow(frugal(run), shape)
    some = F.col("lang").isNotNull()
    return out.select(F.col("key").alias(key), F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(some, F.least(F.exp(F.col("top") - F.col("total")), F.lit(1.0))).otherwise(0.0).alias("score"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents; a null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(bucket_of("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


__all__ = ["fit", "held_out", "op9_language_id", "predict", "weigh"]
