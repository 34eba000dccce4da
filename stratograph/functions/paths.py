"""Expressions over workspace paths: domain, layer, language, ignore rules, test files."""

from __future__ import annotations

import re
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------
#: File extension -> language.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".vue": "vue", ".svelte": "svelte", ".go": "go", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".swift": "swift", ".php": "php",
    ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp",
}
#: Layer -> words of a path part that mean it, in order of precedence.
LAYERS = {
    "controller": ["controller", "controllers", "api", "apis", "routes", "route", "router", "routers", "endpoint", "endpoints", "view", "views", "presentation"],
    "service": ["service", "services", "usecase", "usecases", "interactor", "interactors", "handler", "handlers", "application"],
    "repository": ["repo", "repos", "repository", "repositories", "dao", "daos", "store", "stores", "db"],
    "model": ["model", "models", "entity", "entities", "domain", "schema", "schemas"],
    "infrastructure": ["infra", "infrastructure", "client", "clients", "external"],
}
#: First path parts that are not a domain by themselves.
ROOTS = ["src", "lib", "app", "packages", "pkg"]
#: What a scan leaves out unless told otherwise.
IGNORED = [".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", "node_modules", "dist", "build", "out", "target", "bin", "obj", "ref",
           "*.min.js", "*.bundle.js", "*.map", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Last extension in lower case with its dot, '' where there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Language by extension, null for files that are not indexed."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def domain(path: Column) -> Column:
    """First path part, the second below a source root, ``root`` for files at the top."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    return (F.when(F.size(parts) <= 1, F.lit("root"))
            .when(first.isin(ROOTS) & (F.size(parts) > 2), F.get(parts, F.lit(1))).otherwise(first))


def layer(path: Column) -> Column:
    """Architectural layer: the stem decides, else the nearest directory with a telling whole word; '' if none."""
    parts = F.reverse(F.split(path, "/"))
    parts = F.transform(parts, lambda p, i: F.lower(F.when(i == 0, F.regexp_replace(p, r"\.[^.]*$", "")).otherwise(p)))

    def of(part: Column) -> Column:
        words = F.split(part, "[^a-z0-9]+")
        chain = None
        for name, keys in LAYERS.items():
            hit = F.arrays_overlap(words, F.array(*[F.lit(k) for k in keys]))
            chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
        return chain

    found = F.filter(F.transform(parts, of), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def glob_regex(pattern: str) -> str:
    """Shell pattern as an anchored regular expression (``*`` and ``?`` do not cross ``/``)."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1:]:
            j = pattern.index("]", i + 1)
            inner = pattern[i + 1:j]
            out.append("[" + ("^" + inner[1:] if inner[:1] in "^!" else inner) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def is_file_pattern(pattern: str) -> bool:
    """A pattern with wildcards, or with a dot that is not its first character, is about files; others about folders."""
    return any(c in pattern for c in "*?[") or "." in pattern[1:]


def _like(pattern: str, part: Column) -> Column:
    return part.rlike(pattern)


def ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether a workspace-relative path is left out: folder patterns match any folder of it, file patterns its base name or all of it."""
    tests = []
    for p in IGNORED if patterns is None else patterns:
        rx = glob_regex(p)
        if is_file_pattern(p):
            tests.append(base_name(path).rlike(rx) | path.rlike(rx))
        else:
            folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
            tests.append(F.exists(folders, partial(_like, rx)) | F.regexp_extract(path, "^(.*)/[^/]*$", 1).rlike(rx))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_test_file(path: Column) -> Column:
    """Test files by suffix, prefix of the base name, or folder; a folder at the very top has no slash before it and does not count."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    suffixes = ["_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js"]
    ends = reduce(lambda a, b: a | b, [F.endswith(p, F.lit(s)) for s in suffixes])
    return ends | F.startswith(base_name(p), F.lit("test_")) | p.contains("/tests/") | p.contains("/test/") | p.contains("__tests__")


def clean(path: Column) -> Column:
    """A relative path without ``.`` and with ``..`` resolved where that stays inside."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.array_join(folded, "/")
