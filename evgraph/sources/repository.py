"""Repositories as tables: files, their metadata, compiler indexes and the parse cache."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 2 << 20
#: Extensions whose contents are not read (fixed values).
OPAQUE = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".woff", ".woff2", ".ttf", ".mp4", ".wasm")


def _relative(root: str):
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + root.rstrip("/") + "/", "")


def scan_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime); contents are pruned, so none is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select(_relative(root).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def scan_sources(spark: SparkSession, root: str, most: int = MAX_BYTES) -> DataFrame:
    """FILE rows of every text file up to ``most`` bytes. Files of opaque kinds are kept by size only, those that hold a
    zero byte are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most)
    path = _relative(root)
    opaque = F.lower(path).rlike("(" + "|".join(x.replace(".", r"\.") for x in OPAQUE) + ")$")
    text = F.when(~opaque, F.decode("content", "UTF-8"))
    digest = F.when(opaque, F.concat(F.lit("size:"), F.col("length").cast("string"))).otherwise(F.sha2("content", 256))
    rows = df.select(path.alias("path"), text.alias("text"), digest.alias("content_hash"), F.col("length").alias("size"))
    return rows.where("text is null or instr(text, char(0)) = 0")


def ignored(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Files under none of the prefixes. Prefixes that are absolute, or climb, are refused."""
    for p in prefixes:
        if p.startswith("/") or ".." in p.split("/"):
            raise ValueError(f"not a relative prefix: {p}")
    out = files
    for p in prefixes:
        out = out.where(~F.col("path").startswith(p.rstrip("/") + "/") & (F.col("path") != p))
    return out


def git_tracked(files: DataFrame, root: str) -> DataFrame:
    """Files that git lists. The list is a table, joined; the join broadcasts it only where it is small."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached"], capture_output=True, check=True)
    names = [x for x in done.stdout.decode().split("\0") if x]
    tracked = files.sparkSession.createDataFrame([(n,) for n in names], "path string")
    return files.join(tracked, "path", "left_semi")


SCIP = T.StructType([T.StructField("documents", T.ArrayType(T.StructType([T.StructField("relativePath", T.StringType()), T.StructField("occurrences", T.ArrayType(T.StructType([T.StructField("symbol", T.StringType()), T.StructField("symbolRoles", T.IntegerType()), T.StructField("range", T.ArrayType(T.IntegerType()))])))])))])


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """(path, symbol, definition, line) of a compiler's index."""
    docs = spark.read.schema(SCIP).option("multiLine", True).json(path).select(F.explode("documents").alias("d"))
    occ = docs.select(F.col("d.relativePath").alias("path"), F.explode("d.occurrences").alias("o"))
    return occ.select("path", F.col("o.symbol").alias("symbol"), (F.col("o.symbolRoles").bitwiseAND(1) == 1).alias("definition"), (F.get("o.range", F.lit(0)) + 1).alias("line"))


def scip_references(occurrences: DataFrame) -> DataFrame:
    """REFERENCES edges from files to the files that define what they name; exact."""
    defs = occurrences.where("definition").select("symbol", F.col("path").alias("to"))
    refs = occurrences.where("not definition").select("symbol", F.col("path").alias("at"))
    return refs.join(defs, "symbol").where(F.col("at") != F.col("to")).select(F.concat(F.lit("file:"), "at").alias("source"), F.concat(F.lit("file:"), "to").alias("target"), F.lit("REFERENCES").alias("kind"), F.lit("EXACT_RESOLUTION").alias("tier")).distinct()


def parse_cache(files: DataFrame, cache: DataFrame | None, version: int, cached: int | None) -> DataFrame:
    """Files that have to be parsed: not in the cache under their hash, or all where its version differs."""
    if cache is None or version != cached:
        return files
    return files.join(cache.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select(*files.columns)


#: How many folders a walk enters, and how many entries of one it takes (fixed values).
MAX_FOLDERS, MAX_ENTRIES = 50_000, 5_000


def walk_tree(spark: SparkSession, root: str, folders: int = MAX_FOLDERS, entries: int = MAX_ENTRIES, most: int = MAX_BYTES) -> tuple[DataFrame, list[str]]:
    """(path, size) of the files up to ``most`` bytes under a local folder, and why some are missing.

    Folders are entered once, whatever links lead to them, ``folders`` of them (else: directory_limit); one of more than
    ``entries`` entries is left out (directory_entry_limit). Trees in stores are listed by :func:`scan_metadata`.
    """
    todo, seen, rows, why = [root], set(), [], set()
    while todo:
        folder = todo.pop()
        real = os.path.realpath(folder)
        if real in seen:
            continue
        if len(seen) >= folders:
            why.add("directory_limit")
            break
        seen.add(real)
        try:
            with os.scandir(folder) as listed:
                found = [e for _, e in zip(range(entries + 1), listed, strict=False)]
        except OSError:
            continue
        if len(found) > entries:
            why.add("directory_entry_limit")
            continue
        for e in sorted(found, key=lambda e: e.name, reverse=True):
            if e.is_dir() and e.name != ".git":
                todo.append(e.path)
            elif e.is_file() and e.stat().st_size <= most:
                rows.append((os.path.relpath(e.path, root).replace(os.sep, "/"), e.stat().st_size))
    return spark.createDataFrame(rows, "path string, size long"), sorted(why)


def stable_read(path: str, tries: int = 2) -> tuple[bytes, str]:
    """A file's bytes and their digest, read while it did not change: size, time and identity are the same before and after.
    One that changes under every try is an error."""
    for _ in range(tries):
        before = os.stat(path)
        raw = Path(path).read_bytes()
        after = os.stat(path)
        if all(getattr(before, x) == getattr(after, x) for x in ("st_size", "st_mtime_ns", "st_dev", "st_ino")) and len(raw) == after.st_size:
            return raw, hashlib.sha256(raw).hexdigest()
    raise OSError(f"{path} changes while it is read")


_MAP = T.StructType([T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "kind", "path", "text", "status")]))), T.StructField("edges", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("from", "to", "type")])))])


def read_doc_map(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The nodes and edges of a document map, a JSON file; None where it is not there or is no JSON."""
    try:
        rows = spark.read.schema(_MAP).option("multiLine", True).option("mode", "FAILFAST").json(path)
        out = {k: rows.select(F.explode(k).alias("x")).select("x.*") for k in ("nodes", "edges")}
        out["nodes"].head(1)
    except Exception:  # noqa: BLE001 - whatever a reader says of a missing or broken file
        return None
    return out


def custom_languages(root: str, config: str = "languages.toml") -> tuple[list[dict], list[str]]:
    """The languages that a repository's configuration adds (id, extensions, patterns, grammar, tier), and what is wrong
    with the others: an id or extension that is built in, a grammar outside the repository, missing, or of another digest.

    ``table`` names a JSON list of (kind, pattern): with no parser at hand, symbols are found by these.
    """
    from evgraph.operators.extract import EXTENSIONS, SYMBOLS

    file = Path(root, config)
    if not file.exists():
        return [], []
    try:
        given = tomllib.loads(file.read_text()).get("languages", [])
    except tomllib.TOMLDecodeError as error:
        return [], [f"{config}: {error}"]
    out, wrong = [], []
    for x in given:
        name, ends, grammar = str(x.get("id", "")), [str(e).lstrip(".") for e in x.get("extensions", [])], str(x.get("grammar", ""))
        outside = "://" in grammar or Path(grammar).is_absolute() or ".." in Path(grammar).parts
        there = not outside and Path(root, grammar).is_file()
        digest = hashlib.sha256(Path(root, grammar).read_bytes()).hexdigest() if there else ""
        problems = {
            "a language without an id": not name,
            f"{name}: built in": name in SYMBOLS,
            f"{name}: an extension of a built-in language": any(f".{e}" in EXTENSIONS for e in ends),
            f"{name}: {grammar} is outside the repository": outside,
            f"{name}: {grammar} is missing": not there,
            f"{name}: {grammar} has another digest": x.get("grammar_sha256", digest) != digest,
        }
        if problem := next((text for text, bad in problems.items() if bad), None):
            wrong.append(problem)
            continue
        table = Path(root, str(x["table"])) if x.get("table") else None
        patterns = json.loads(table.read_text()) if table and table.is_file() and ".." not in table.parts else []
        out.append({"id": name, "extensions": ends, "grammar": grammar, "tier": str(x.get("precision_tier", "AST")), "patterns": patterns})
    return out, wrong
