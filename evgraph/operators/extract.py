"""Extraction of symbols, imports, calls and facts from source text, by tables of patterns for each language.

A file is one row, so a task holds a batch of files. Languages are a registry; a new one is an entry. Python has a tier
of its own by the standard library's parser; all others are LEXICAL and are labelled so.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language of each extension (fixed values); any other is LEXICAL text without symbols.
EXTENSIONS = {".js": "javascript", ".mjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".rs": "rust", ".swift": "swift", ".c": "native", ".h": "native", ".cpp": "native", ".m": "native", ".java": "native", ".go": "native", ".sh": "script", ".ps1": "script", ".bat": "script", ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".nsi": "nsis"}

_JS = (
    ("Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("Function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"),
    ("Const", r"^\s*(?:export\s+)?const\s+(\w+)\s*="),
    ("Type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"),
    ("Method", r"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(\w+)\s*\([^)]*\)\s*\{"),
    ("Test", r"^\s*(?:test|it)\(\s*[\"'`]([^\"'`]+)"),
)
#: Patterns of each language, tried in order on each line; the first that fits gives the symbol.
SYMBOLS = {
    "javascript": _JS,
    "typescript": _JS,
    "rust": (("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("Struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("Enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("Trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("Impl", r"^\s*impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)")),
    "swift": (("Class", r"^\s*(?:\w+\s+)*class\s+(\w+)"), ("Struct", r"^\s*(?:\w+\s+)*struct\s+(\w+)"), ("Protocol", r"^\s*(?:\w+\s+)*protocol\s+(\w+)"), ("Function", r"^\s*(?:\w+\s+)*func\s+(\w+)")),
    "native": (("Class", r"^\s*(?:\w+\s+)*(?:class|struct|interface)\s+(\w+)"), ("Function", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)"), ("Function", r"^[\w:*&<>\s]+?\b(\w+)\s*\([^;]*\)\s*\{")),
    "script": (("Function", r"^\s*function\s+([\w-]+)"), ("Function", r"^\s*([\w-]+)\s*\(\)\s*\{"), ("Label", r"^:(\w+)\s*$")),
    "sql": (("Table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("View", r"(?i)^\s*create\s+(?:or\s+replace\s+)?view\s+([\w.]+)"), ("Function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+([\w.]+)")),
    "graphql": (("Type", r"^\s*(?:extend\s+)?(?:type|input|enum|interface|scalar|union)\s+(\w+)"),),
    "nsis": (("Function", r"(?i)^\s*function\s+(\S+)"), ("Section", r"(?i)^\s*section\s+\"?([^\"]+)")),
}
#: Words that look like a method's head but are not (fixed values).
NOT_METHODS = {"constructor", "if", "for", "while", "switch", "catch"}
IMPORTS = {
    "javascript": r"(?:import\s+(?:[^'\"]*?\s+from\s+)?|export\s+[^'\"]*?\s+from\s+|require\(\s*|import\(\s*)['\"]([^'\"]+)['\"]",
    "python": r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))",
    "rust": r"(?m)^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)",
    "native": r"(?m)^\s*#\s*(?:include|import)\s+[\"<]([^\">]+)",
    "script": r"(?m)^\s*(?:source|\.)\s+([^\s;]+)",
}
IMPORTS["typescript"] = IMPORTS["javascript"]

SYMBOL = "path string, kind string, name string, qualified string, start_line int, end_line int, tier string"


def language(path: Column, more: dict[str, str] | None = None) -> Column:
    """The language of a path by its extension; ``more`` extensions besides the registry's."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    pairs = [F.lit(x) for kv in (EXTENSIONS | (more or {})).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("lexical"))


def block_end(lines: list[str], start: int, lang: str) -> int:
    """The last line (from 0) of the block that begins at ``start``: by indentation, statement or braces."""
    if lang == "python":
        depth, end = len(lines[start]) - len(lines[start].lstrip()), start
        for i in range(start + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= depth:
                    break
                end = i
        return end
    if lang == "sql":
        return next((i for i in range(start, len(lines)) if ";" in lines[i]), start)
    depth, seen = 0, False
    for i in range(start, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        seen = seen or "{" in lines[i]
        if seen and depth <= 0:
            return i
        if not seen and i > start and lines[i].strip():
            return start
    return len(lines) - 1 if seen else start


def python_symbols(text: str) -> list[tuple]:
    """(kind, name, qualified, start, end, tier) by the parser; by indentation where the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        out, stack, lines = [], [], text.split("\n")
        for i, line in enumerate(lines):
            if m := re.match(r"^(\s*)(class|(?:async\s+)?def)\s+(\w+)", line):
                depth = len(m[1])
                stack = [s for s in stack if s[0] < depth]
                kind = "Class" if m[2] == "class" else "Method" if stack and stack[-1][2] == "Class" else "Function"
                name = ".".join([*(s[1] for s in stack), m[3]])
                out.append((kind, m[3], name, i + 1, block_end(lines, i, "python") + 1, "LEXICAL"))
                stack.append((depth, m[3], kind))
        return out
    out = []

    def walk(node: ast.AST, names: tuple[str, ...], inside: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                own = isinstance(x, ast.ClassDef)
                out.append(("Class" if own else "Method" if inside else "Function", x.name, ".".join((*names, x.name)), x.lineno, x.end_lineno, "AST"))
                walk(x, (*names, x.name), own)
            else:
                walk(x, names, inside)

    walk(tree, (), False)
    return out


def text_symbols(text: str, lang: str, patterns: dict | None = None) -> list[tuple]:
    if lang == "python":
        return python_symbols(text)
    out, lines, owner = [], text.split("\n"), ("", -1)
    for i, line in enumerate(lines):
        for kind, pattern in (patterns or SYMBOLS).get(lang, ()):
            m = re.match(pattern, line)
            if not m or kind == "Method" and (i > owner[1] or m[1] in NOT_METHODS):
                continue
            end = block_end(lines, i, lang)
            name = f"{owner[0]}.{m[1]}" if i <= owner[1] and owner[0] else m[1]
            out.append((kind, m[1], name, i + 1, end + 1, "LEXICAL"))
            if kind in ("Class", "Impl", "Struct", "Trait"):
                owner = (m[1], end)
            break
    return out


def symbols(files: DataFrame, languages: list[dict] | None = None) -> DataFrame:
    """SYMBOL rows of files (path, text); a null text has none. ``languages``: configured ones, those of
    :func:`evgraph.sources.repository.custom_languages`."""
    own = {f".{e}": x["id"] for x in languages or () for e in x["extensions"]}
    known = SYMBOLS | {x["id"]: tuple(map(tuple, x["patterns"])) for x in languages or ()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *s) for p, x, lang in zip(b.path, b.text, b.lang, strict=True) if x for s in text_symbols(x, lang, known)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "qualified", "start_line", "end_line", "tier"])

    return files.select("path", "text", language(F.col("path"), own).alias("lang")).mapInPandas(run, SYMBOL)


def imports(files: DataFrame) -> DataFrame:
    """(path, specifier) of every import, distinct."""
    rows = files.select("path", "text", language(F.col("path")).alias("lang"))
    found = F.array().cast("array<string>")
    for lang, pattern in IMPORTS.items():
        both = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        if lang == "python":
            both = F.concat(both, F.regexp_extract_all("text", F.lit(pattern), F.lit(2)))
        found = F.when(F.col("lang") == lang, both).otherwise(found)
    return rows.select("path", F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("specifier"))


def call_names(bodies: DataFrame) -> DataFrame:
    """(source, name): every name called in a body, distinct."""
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?:\.|\b)(\w+)\s*\("), F.lit(1)))
    return bodies.select("source", F.explode(names).alias("name"))


#: Facts of each profile: kind and pattern, the name in group 1 (fixed values).
FACTS = {
    "http": (("ROUTES_TO", r"\b(?:app|router)\.(?:get|post|put|patch|delete)\(\s*[\"'`]([^\"'`]+)"), ("ROUTES_TO", r"@(?:app|router)\.(?:get|post|put|patch|delete)\(\s*[\"']([^\"']+)"), ("ROUTES_TO", r"\.route\(\s*\"([^\"]+)\"")),
    "events": (("PRODUCES", r"(?i)(?:publish|produce|emit)\(\s*[\"'`]([A-Za-z0-9_.-]+)[\"'`]"), ("CONSUMES", r"(?i)(?:subscribe|consume|onMessage|handler)\(\s*[\"'`]([A-Za-z0-9_.-]+)[\"'`]")),
    "database": (("DEFINES", r"(?i)(?:model|table)\s+([A-Za-z0-9_]+)"), ("READS", r"(?i)\.(find|get|query|select)\("), ("WRITES", r"(?i)\.(insert|create|update|delete|save)\(")),
    "deployment": (("DEPLOYS", r"(?i)^\s*(?:-\s*)?(?:uses|action|step|deploy)\s*:\s*([A-Za-z0-9_.-]+)"), ("CONFIGURES", r"^\s*resource\s+\"([^\"]+)\"")),
    "sql": (("DEFINES", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("DEFINES", r"(?i)\bcreate\s+(?:unique\s+)?index\s+([\w.]+)"), ("WRITES", r"(?i)\b(?:insert\s+into|update|delete\s+from)\s+([\w.]+)"), ("READS", r"(?i)\bfrom\s+([\w.]+)")),
    "docker": (("USES", r"(?i)^\s*from\s+(\S+)"), ("DEPLOYS", r"(?i)^\s*expose\s+(\d+)"), ("HANDLES", r"(?i)^\s*entrypoint\s+(.+)$")),
    "terraform": (("DEPLOYS", r"^\s*resource\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("USES", r"^\s*module\s+\"([^\"]+)\"")),
    "kubernetes": (("DEPLOYS", r"^\s*kind:\s*(\w+)"),),
}


def profile(path: Column) -> Column:
    """Which facts a path can hold."""
    low = F.lower(path)
    return F.when(low.rlike(r"(^|/)dockerfile"), "docker").when(low.endswith(".tf"), "terraform").when(low.rlike(r"\.ya?ml$"), "kubernetes").when(low.endswith(".sql"), "sql").otherwise("http")


def facts(lines: DataFrame, name: str) -> DataFrame:
    """(path, line, kind, name) of a profile's facts in lines (path, line, text); comments do not count."""
    rows = lines.where(~F.trim("text").rlike(r"^(//|#|--)"))
    hits = [F.when(F.col("text").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name"))) for kind, p in FACTS[name]]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return rows.select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.kind", "f.name")


_VERB = r"\.(get|post|put|delete|patch)\(\s*[\"'`]([^\"'`]+)[\"'`]"
#: Stacks of web frameworks: imports that show one is used; patterns of routes (method or none, path) and of handlers
#: (fixed values).
STACKS = {
    "next-express": (("next", "express", "fastify"), (("route", r"(?i)(?:app|router)" + _VERB), ("handler", r"export\s+default\s+async\s+function\s+([A-Za-z0-9_]+)"))),
    "fastapi-django": (("fastapi", "django"), (("route", r"(?i)@app" + _VERB), ("handler", r"^def\s+([A-Za-z0-9_]+)\s*\("))),
    "tauri-axum": (("tauri", "axum"), (("route", r"(?i)\.route\(\s*()[\"'`]([^\"'`]+)[\"'`]"), ("handler", r"async\s+fn\s+([A-Za-z0-9_]+)"))),
}


def routes(lines: DataFrame, imported: DataFrame) -> DataFrame:
    """(path, line, stack, kind, method, name): routes and handlers in lines (path, line, text) of files that import one of
    a stack's frameworks (path, specifier). Comments hold none; a route without a method is for ANY."""
    bare = F.trim("text")
    rows = lines.where(~bare.rlike(r"^(//|#|/\*|\*)")).withColumn("_t", F.trim(F.regexp_replace(F.regexp_replace(bare, "//.*$", ""), "#.*$", "")))
    gate = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("specifier", w)), F.lit(stack)) for stack, (words, _) in STACKS.items()]
    active = imported.select("path", F.explode(F.filter(F.array(*gate), lambda x: x.isNotNull())).alias("stack")).distinct()
    hits = []
    for stack, (_, patterns) in STACKS.items():
        for kind, pattern in patterns:
            verb = F.upper(F.regexp_extract("_t", pattern, 1)) if kind == "route" else F.lit(None).cast("string")
            verb = F.when(verb == "", "ANY").otherwise(verb)
            hits.append(F.when((F.col("stack") == stack) & F.col("_t").rlike(pattern), F.struct(F.lit(kind).alias("kind"), verb.alias("method"), F.regexp_extract("_t", pattern, 2 if kind == "route" else 1).alias("name"))))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return rows.join(active, "path").select("path", "line", "stack", F.explode(found).alias("f")).select("path", "line", "stack", "f.kind", "f.method", "f.name")


def task_anchors(tasks: DataFrame) -> DataFrame:
    """(task, path, symbol, start, end) of paths that a task's text names, with #symbol or a range of lines."""
    pattern = r"([\w./-]+\.\w+(?:#[\w.]+|:\d+(?:-\d+)?)?)"
    rows = tasks.select("task", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("a"))
    part = lambda p: F.regexp_extract("a", p, 1)
    number = lambda c: F.expr("cast(null as int)") if c is None else F.when(c != "", c.cast("int"))
    first = F.regexp_extract("a", r":(\d+)", 1)
    last = F.regexp_extract("a", r":\d+-(\d+)", 1)
    return rows.select("task", part(r"^([^#:]+)").alias("path"), F.nullif(part(r"#([\w.]+)"), F.lit("")).alias("symbol"), number(F.when(first != "", first).otherwise("0")).alias("start"), number(F.when(last != "", last).when(first != "", first).otherwise("0")).alias("end"))
