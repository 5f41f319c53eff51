"""Resolution of names and specifiers to targets, by equi-joins with ordered preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import text as X
from evgraph.session import cut


def first_existing(wanted: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """wanted (by..., candidates: array of paths in order) with target: the first candidate that is a file, else null."""
    rows = wanted.select(*by, F.posexplode_outer("candidates").alias("pos", "path"))
    hit = rows.join(files.select("path").distinct(), "path").groupBy(*by).agg(F.min_by("path", "pos").alias("target"))
    return wanted.drop("candidates").join(hit, by, "left")


def by_suffix(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(suffix, target): the least path that ends with the suffix at a folder's border; joined on the last part."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    a, b = wanted.select("suffix", last("suffix").alias("last")).distinct(), files.select("path", last("path").alias("last"))
    hit = b.join(a, "last").where((F.col("path") == F.col("suffix")) | F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("suffix")))).groupBy("suffix").agg(F.min("path").alias("target"))
    return wanted.select("suffix").distinct().join(hit, "suffix", "left")


def calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, name, target, kind, tier): what each call name of a symbol resolves to.

    calls: (source, path, name, is_test); symbols: (id, name, path); imports: (path, target_path). Of the candidates but
    the caller itself: those of its file; else those of files that it imports; else the only one there is; else one
    unresolved edge, kept without a target. All of the best kind are given.

    Which of these holds is read off the least and the greatest id of each name, of each name in a file, and of each name
    in a file's imports: some candidate is not the caller unless both are. So no pairs are made but the edges themselves,
    and these are not shuffled where each call has one path and each symbol one file, as no edge can then come up twice.
    """
    asked = calls.select("source", "path", "name", "is_test").distinct()
    known = symbols.select(F.col("id").alias("target"), "name", F.col("path").alias("to_path")).distinct()
    ends = lambda lo, hi: (F.min("target").alias(lo), F.max("target").alias(hi))
    by_file = known.groupBy("name", F.col("to_path").alias("path")).agg(*ends("f_lo", "f_hi"))
    by_name = known.groupBy("name").agg(*ends("n_lo", "n_hi"), F.count_distinct("target").alias("n"))
    links = imports.select("path", F.col("target_path").alias("to_path")).where("path is not null and to_path is not null").distinct()
    other = lambda lo, hi: F.coalesce((F.col(lo) != F.col("source")) | (F.col(hi) != F.col("source")), F.lit(False))
    rows = asked.join(by_file, ["name", "path"], "left").withColumn("same", other("f_lo", "f_hi"))
    far = rows.where("not same").select("path", "name").distinct().join(links, "path")
    by_import = far.join(by_file.withColumnRenamed("path", "to_path"), ["name", "to_path"]).groupBy("path", "name").agg(F.min("f_lo").alias("i_lo"), F.max("f_hi").alias("i_hi"))
    rows = rows.join(by_import, ["path", "name"], "left").join(by_name, "name")
    only = F.when(F.col("n") == 1, F.col("n_lo")).when((F.col("n") == 2) & (F.col("source") == F.col("n_lo")), F.col("n_hi")).when((F.col("n") == 2) & (F.col("source") == F.col("n_hi")), F.col("n_lo"))
    level = F.when(F.col("same"), 0).when(other("i_lo", "i_hi"), 1).when(only.isNotNull(), 2).otherwise(3)
    rows = cut(rows.where(other("n_lo", "n_hi")).select("source", "path", "name", "is_test", only.alias("only"), level.alias("level")))
    near = rows.where("level = 0").join(known.withColumnRenamed("to_path", "path"), ["name", "path"])
    told = rows.where("level = 1").join(links, "path").join(known, ["name", "to_path"])
    cols = ("source", "name", "target", "is_test", "level")
    found = near.select(*cols).unionByName(told.select(*cols)).where("source <> target")
    found = found.unionByName(rows.where("level > 1").select("source", "name", F.col("only").alias("target"), "is_test", "level"))
    tier = F.when(F.col("level") == 0, "SAME_FILE_LEXICAL").when(F.col("level") < 3, "CROSS_FILE_HEURISTIC").otherwise("UNRESOLVED")
    out = found.select("source", "name", "target", F.when(F.col("is_test"), "TESTS").otherwise("CALLS").alias("kind"), tier.alias("tier"))
    kind = F.coalesce("is_test", F.lit(False)).alias("kind")  # what is not known to be a test is a call
    twice = lambda df, *by: not df.groupBy(*by).count().where("count > 1").isEmpty()
    return out.distinct() if twice(asked, "source", "name", kind) or twice(known, "target", "name") else out


def union_layer(base: DataFrame, extra: DataFrame, key: str = "id") -> DataFrame:
    """``base`` and those rows of ``extra`` whose key it has not."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti").select(*base.columns))


def first_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evidence_fresh(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(id, fresh): whether every piece of evidence has its file's present hash. evidence: (id, path, content_hash)."""
    rows = evidence.join(files.select("path", F.col("content_hash").alias("now")), "path", "left")
    return rows.groupBy("id").agg(F.bool_and(F.coalesce(F.col("content_hash") == F.col("now"), F.lit(False))).alias("fresh"))


def config_edges(constants: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, kind, tier): CONFIGURES edges from constants (id, path, line_text) to the files (path, id) whose
    paths their lines hold as strings; a match of texts only, so heuristic."""
    found = F.regexp_extract_all("line_text", F.lit(r"[\"']([^\"']+\.(?:json|yaml|yml|toml|sqlite|db))[\"']"), F.lit(1))
    named = constants.select(F.col("id").alias("source"), F.explode(F.array_distinct(F.transform(found, X.normal_path))).alias("path"))
    return named.join(files.select("path", F.col("id").alias("target")), "path").select("source", "target", F.lit("CONFIGURES").alias("kind"), F.lit("CROSS_FILE_HEURISTIC").alias("tier"))


def schema_references(symbols: DataFrame) -> DataFrame:
    """(source, target, kind): REFERENCES edges between schema symbols (id, family, name, body) of one family.

    A graphql body references the names that are words of it, its own head apart; an sql body those that follow REFERENCES.
    Bodies are cut into words once and joined on them, so symbols are never compared with each other.
    """
    words = F.regexp_extract_all(F.regexp_replace("body", r"^\s*(?:extend\s+)?\w+\s+\w+", ""), F.lit(r"(\w+)"), F.lit(1))
    after = F.transform(F.regexp_extract_all("body", F.lit(r"(?i)\bREFERENCES\s+(?:[A-Za-z_]\w*\.)?[\"\[]?(\w+)"), F.lit(1)), F.lower)
    key = lambda c: F.when(F.col("family") == "sql", F.lower(c)).otherwise(c)
    used = symbols.select(F.col("id").alias("source"), "family", F.explode(F.array_distinct(F.when(F.col("family") == "sql", after).otherwise(words))).alias("word"))
    return used.join(symbols.select(F.col("id").alias("target"), "family", key(F.col("name")).alias("word")), ["family", "word"]).where("source <> target").select("source", "target", F.lit("REFERENCES").alias("kind")).distinct()


#: Extensions that a module's path may leave out, in the order they are tried (fixed values).
SCRIPT = (".js", ".mjs", ".cjs", ".json")
TYPED = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json")


def _spellings(base: Column, extensions: tuple[str, ...]) -> Column:
    """The paths that ``base`` may stand for: itself, with each extension, and the index files in it."""
    return F.array(base, *(F.concat(base, F.lit(e)) for e in extensions), *(F.concat(base, F.lit(f"/index{e}")) for e in extensions))


def modules(wanted: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(from_path, specifier, target, reason): the file that each module specifier (from_path, specifier, typed) means.

    Relative ones are looked up beside the file, typed ones with more extensions. Bare ones mean the package of the nearest
    node_modules folder above the file: its entry (packages: (folder, entry), the entry null for index.js), else a file of
    that name. Null targets say why: missing, or no_node_modules. Candidates are exploded with their place and joined with
    files (path) once; the first that is there counts.
    """
    asked = wanted.select("from_path", "specifier", "typed").distinct()
    relative = F.col("specifier").rlike(r"^[./]")
    beside = X.normal_path(F.concat(X.dirname(F.col("from_path")), F.lit("/"), "specifier"))
    own = asked.where(relative).select("from_path", "specifier", "typed", F.when(F.col("typed"), _spellings(beside, TYPED)).otherwise(_spellings(beside, SCRIPT)).alias("candidates"))
    # bare: the nearest folder above that has a node_modules folder
    has = files.where(F.contains("path", F.lit("node_modules/"))).select(F.regexp_extract("path", r"^((?:.*/)?node_modules)/", 1).alias("modules")).distinct()
    above = asked.where(~relative).select("from_path", "specifier", "typed", F.posexplode(X.parents(F.col("from_path"))).alias("far", "at"))
    above = above.withColumn("modules", F.when(F.col("at") == "", "node_modules").otherwise(F.concat("at", F.lit("/node_modules"))))
    near = above.join(has, "modules").groupBy("from_path", "specifier", "typed").agg(F.min_by("modules", "far").alias("modules"))
    name = F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    near = near.withColumn("dir", F.concat("modules", F.lit("/"), name)).join(packages.select(F.col("folder").alias("dir"), F.coalesce("entry", F.lit("index.js")).alias("entry"), F.lit(True).alias("known")), "dir", "left")
    entry = F.when(F.col("known"), _spellings(X.normal_path(F.concat("dir", F.lit("/"), "entry")), SCRIPT)).otherwise(F.array().cast("array<string>"))
    plain = _spellings(F.concat("modules", F.lit("/"), "specifier"), SCRIPT)
    bare = asked.where(~relative).join(near.select("from_path", "specifier", "typed", F.concat(entry, plain).alias("candidates"), F.size(entry).alias("entries")), ["from_path", "specifier", "typed"], "left")
    rows = own.select("from_path", "specifier", "typed", "candidates", F.lit(0).alias("entries")).unionByName(bare.select("from_path", "specifier", "typed", "candidates", "entries"))
    tried = rows.select("from_path", "specifier", "typed", F.posexplode("candidates").alias("pos", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy("from_path", "specifier", "typed").agg(F.min(F.struct("pos", "path")).alias("m"))
    out = rows.join(hit, ["from_path", "specifier", "typed"], "left")
    reason = F.when(F.col("m").isNotNull() & relative, "relative").when(F.col("m").isNotNull() & (F.col("m.pos") < F.col("entries")), "package").when(F.col("m").isNotNull(), "bare").when(F.col("candidates").isNull(), "no_node_modules").otherwise("missing")
    return out.select("from_path", "specifier", F.col("m.path").alias("target"), reason.alias("reason"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """(source, target, kind, specifier, tier, resolved): IMPORTS edges of (path, specifier, target); those that found no
    file are kept without a target, of the least tier, with what they asked for."""
    found = F.col("target").isNotNull()
    return resolved.select(F.concat(F.lit("file:"), "path").alias("source"), F.when(found, F.concat(F.lit("file:"), "target")).alias("target"), F.lit("IMPORTS").alias("kind"), "specifier", F.when(found, "EXACT_RESOLUTION").otherwise("UNRESOLVED").alias("tier"), found.alias("resolved"))


def provider_ranks(owners: DataFrame, ranks: DataFrame, known: tuple[str, ...] = ("file", "symbol", "document")) -> DataFrame:
    """(id, kind, rank): the rank of each fact's provider. owners: (id, kind, provider); facts of other kinds, or of a
    provider without a rank, are left out. Ranks are a handful."""
    return owners.where(F.col("kind").isin(*known)).join(ranks.select("provider", "rank"), "provider").groupBy("id", "kind").agg(F.min("rank").alias("rank"))
