"""Text, path and scoring functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no query is about (fixed values).
STOP = ("a", "an", "and", "for", "in", "of", "the", "to", "where")
#: Words that every task may hold and none is about (fixed values).
TASK_STOP = ("add", "build", "check", "create", "fix", "implement", "make", "test", "update", "use")
#: Words of a claim's status (fixed values).
STATUS = r"(?i)\b(done|complete|implemented|partial|pending|planned|stale|drift|contradict|missing|not implemented|not shipped|not built|gap|gotcha|decision|canonical|supersedes)\b"
#: Starts of a line that make it code or a command, not a claim (fixed values).
COMMAND = r"(?i)^(expected:|run:|assert!?|//|let\s|const\s|fn\s|pub\s|use\s|import\s)"
#: Names and values that are redacted (fixed values).
SECRET_VALUE = r"(?i)(api[_-]?key|secret|token|password|passwd|authorization)(\s*[:=]\s*)(\S+)"


def camel_split(x: Column) -> Column:
    return F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")


def query_terms(x: Column) -> Column:
    """Distinct lower-cased terms of two characters or more, without stop words, in their order."""
    parts = F.split(F.lower(camel_split(x)), "[^a-z0-9_]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP)))


def symbol_tokens(x: Column) -> Column:
    """Index tokens of a name: its words, and their parts between underscores, up to 64 characters, and ``*``."""
    words = F.filter(F.split(F.lower(camel_split(x)), "[^a-z0-9_]+"), lambda t: F.length(t) > 0)
    parts = F.flatten(F.transform(words, lambda t: F.split(t, "_")))
    kept = F.filter(F.concat(words, parts), lambda t: (F.length(t) > 0) & (F.length(t) <= 64))
    return F.array_distinct(F.concat(kept, F.array(F.lit("*"))))


def term_score(haystack: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    low = F.lower(haystack)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in terms], F.lit(0))


def text_score(haystack: Column, terms: list[str]) -> Column:
    """The same, a term of more than five characters counting three."""
    low = F.lower(haystack)
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(t)), 3 if len(t) > 5 else 1).otherwise(0) for t in terms], F.lit(0))


def ordered_term_score(haystack: Column, terms: list[str]) -> Column:
    """Eight for the whole phrase, and three for each pair of neighbouring terms found as such, in the text as it is
    searched; of fewer than two terms nothing."""
    if len(terms) < 2:
        return F.lit(0)
    low = search_text(haystack)
    pairs = [F.when(F.contains(low, F.lit(f"{a} {b}")), 3).otherwise(0) for a, b in zip(terms, terms[1:], strict=False)]
    return reduce(lambda a, b: a + b, pairs, F.when(F.contains(low, F.lit(" ".join(terms))), 8).otherwise(0))


def words(x: Column) -> Column:
    """Distinct lower-cased runs of letters and digits of three characters or more, in their order."""
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) > 2))


def task_words(x: Column, stop: tuple[str, ...] = TASK_STOP) -> Column:
    """The words of a task that are no stop words; all of them where none is left."""
    kept = F.filter(words(x), lambda t: ~t.isin(*stop))
    return F.when(F.size(kept) > 0, kept).otherwise(words(x))


def search_text(x: Column) -> Column:
    """Lower-cased, all but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def term_hits(haystack: Column, terms: Column) -> Column:
    """How many of the ``terms`` (an array) the text contains."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(haystack), t)))


def searchable_symbol(kind: Column, name: Column, qualified: Column, path: Column) -> Column:
    """What a symbol is searched by."""
    return F.lower(F.concat_ws(" ", kind, name, qualified, path))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "(^-+)|(-+$)", "")


def truncate(x: Column, most: int) -> Column:
    """The text cut to ``most`` characters, at a word's end, with three dots."""
    clipped = F.regexp_replace(F.substring(x, 1, max(0, most - 3)), r"\s+\S*$", "")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(clipped, F.lit("...")))


def clean_claim(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*]\s+", ""), r"\s+", " ")


def strip_code(x: Column) -> Column:
    """Without spans between backticks."""
    return F.regexp_replace(x, "`[^`]*`", "")


def looks_like_claim(x: Column) -> Column:
    line = F.trim(x)
    plain = strip_code(line)
    return ~F.startswith(line, F.lit(">")) & (F.length(plain) >= 12) & plain.rlike(STATUS) & ~line.rlike(COMMAND)


def classify_status(x: Column) -> Column:
    low = F.lower(strip_code(x))
    return (
        F.when(low.rlike("not implemented|not shipped|not built|missing|pending|planned|gap"), "planned")
        .when(low.rlike("partial|drift"), "partial")
        .when(low.rlike("stale|contradict"), "stale")
        .when(low.rlike("done|complete|implemented"), "implemented")
        .otherwise("claim")
    )


def redact(x: Column) -> Column:
    return F.regexp_replace(x, SECRET_VALUE, "$1$2[REDACTED]")


def normal_path(x: Column) -> Column:
    """Forward slashes, and ``.`` and ``..`` parts resolved."""
    parts = F.filter(F.split(F.translate(x, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def dirname(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("/")), F.regexp_replace(x, "/[^/]*$", "")).otherwise("")


def extension(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"(\.[^./]+)$", 1))


def parents(x: Column) -> Column:
    """All folders above a path, the nearest first, the root (empty) last."""
    parts = F.split(x, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def json_tokens(n: Column) -> Column:
    """Tokens of a text of n characters: a quarter, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(n / 4)).cast("bigint")


def byte_tokens(n: Column) -> Column:
    return F.greatest(F.lit(1), F.round(n / 3.5)).cast("bigint")


def glob_regex(pattern: str, question: bool = False) -> str:
    """A glob as a whole-path regular expression: ``**`` crosses folders, ``*`` does not; empty matches all.

    ``question``: a question mark is one character of a name.
    """
    if not pattern:
        return "^.*$"
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" and question else c if c.isalnum() or c in "/_-" else "\\" + c
        i += 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str, question: bool = False) -> Column:
    return path.rlike(glob_regex(pattern, question))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a length differs or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def cursor(node: Column, edge: Column) -> Column:
    """A page's place as url-safe base64 of its JSON."""
    raw = F.base64(F.encode(F.concat(F.lit('{"node":'), node.cast("string"), F.lit(',"edge":'), edge.cast("string"), F.lit("}")), "UTF-8"))
    return F.rtrim(F.translate(raw, "+/", "-_"), F.lit("="))


#: Extensions of code (fixed values).
CODE = ("rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "java", "rb", "php", "c", "cc", "cpp", "h", "hpp", "cs", "swift", "kt", "kts", "scala", "sh", "ps1", "sql", "vue", "svelte")


def is_document(path: Column) -> Column:
    return path.endswith(".md")


def is_implementation(path: Column) -> Column:
    """Code that is no document."""
    return ~is_document(path) & F.substring(extension(path), 2, 20).isin(*CODE)


def archive_match(path: Column, pattern: str) -> Column:
    """Whether an archive's pattern covers a path: a folder or file as a prefix, or a glob; the empty pattern covers none."""
    pattern = pattern.strip().replace("\\", "/").removeprefix("./")
    path = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    if not pattern:
        return F.lit(False)
    if "*" in pattern:
        return path.rlike(glob_regex(pattern))
    bare = pattern.rstrip("/")
    return (path == bare) | path.startswith(bare + "/")
