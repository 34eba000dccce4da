"""Modules nobody wrote by hand: generated, minified or bundled, third-party copies, data saved as code.

Every symbol's source is lexed (comments and literals told apart from code) and re-emitted in canonical layout, one
statement or brace a line. Comparing that with the layout as found gives, per language, the size of a hand-laid line, and per module

* the expansion: how many canonical lines its bytes would fill against the lines it has: extreme for minified files;
* the uniformity: how few canonical shapes its symbols have: perfect where a generator wrote one function after another;
* the part of its lines that is laid-out code: next to none where literals or other output dominate.

The tables hold the source of symbols, not of files. What lies outside the symbols of a file can only be measured, so a file that
says it is generated is believed if its lines are not mostly laid-out code, and a data blob is told by its extent against
that of files which mostly are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratograph.session import cut, spread

#: Canonical lines per line found, from which a file counts as minified.
MIN_EXPANSION = 50.0
#: Bytes from which a layout can be judged; a file of one short line is no bundle.
MIN_BYTES = 4000
#: Part of a file's lines that is laid-out code, from which the file counts as source.
MOSTLY_CODE = 0.6
#: How many times as long as the longest files that are mostly code (their quantile) a file without symbols is, from which it is data.
DATA_FACTOR, LONGEST = 20.0, 0.999
#: Symbols from which uniformity is judged, and symbols per canonical shape from which it is perfect.
UNIFORM_SYMBOLS, PER_SHAPE = 8, 8.0

_ATOM = regex.compile(
    r"""(?P<literal>\"{3}.*?\"{3}|'{3}.*?'{3}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|(?<![\w.])\d[\w.]*+)
    |(?P<comment>//[^\n]*+|/\*.*?\*/|(?<![\w$])\#(?![\[!])[^\n]*+)""",
    regex.VERBOSE | regex.DOTALL)
_ROUND, _SPACE, _WORD = regex.compile(r"\([^()\[\]]*+\)|\[[^()\[\]]*+\]"), regex.compile(r"\s+"), regex.compile(r"[\p{L}_$][\w$]*+")
LAYOUT_SCHEMA = "id string, path string, found_lines long, canonical_lines long, code_chars long, literal_chars long, shape long"


def layout(code: str) -> tuple[int, int, int, int, int]:
    """(lines found, canonical lines, characters without space, characters of literals, digest of the canonical shape).

    Comments are no code and left out. Canonical layout: a line ends after ``;``, ``{`` and ``}`` (those inside round or
    square brackets do not end one) or at a line break of the original outside brackets; empty lines vanish. The shape is
    the canonical layout with every word and literal replaced by one sign.
    """
    literal = 0

    def plain(m: regex.Match) -> str:
        nonlocal literal
        if m.lastgroup == "comment":
            return ""
        literal += m.end() - m.start()
        return '"'

    bare = _ATOM.sub(plain, code)
    chars = literal + len(_SPACE.sub("", bare)) - bare.count('"')
    found = sum(1 for x in bare.split("\n") if x.strip())
    again = 1
    while again:  # brackets from the inside out
        bare, again = _ROUND.subn("\x01", bare)
    laid = bare.replace(";", ";\n").replace("{", "{\n").replace("}", "}\n")
    lines = [x for x in laid.split("\n") if x.strip()]
    shape = _SPACE.sub("", "\n".join(_WORD.sub("w", x) for x in lines))
    return found, len(lines), chars, literal, xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass")) - (1 << 63)


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(i, p, *layout(c)) for i, p, c in batch.itertuples(index=False) if c and c.strip()],
                           columns=["id", "path", "found_lines", "canonical_lines", "code_chars", "literal_chars", "shape"])


# Marks that code generators, bundlers and package managers leave.
#: Words that say of a file that a tool made it, in the languages headers are written in.
_SAYS_GENERATED = (
    r"(?i).*(?<![\w])(?:(?:auto-?|machine-|computer-)?generated|machine-(?:written|made)|generiert|erzeugt|(?:auto)?généré|generad[oa]|gerad[oa]|gegenereerd|(?:авто)?сгенерирован[аоы]?)(?![\w]).*"
    r"|.*(?:자동\s?생성|自動生成|自动生成).*|.*(?<![\w])do not (?:edit|modify)(?![\w]).*")
_NAME_GENERATED = (
    r"(?i).*(?:\.pb(?:\.\w+)?\.\w+|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.generated\.\w+|[._-]gen(?:erated)?\.\w+|\.g\.\w+|\.designer\.\w+|\.freezed\.\w+|_autogen\.\w+|[._-]auto[._-]?gen\.\w+|/zz_[^/]*|_deepcopy\.go|\.g4\.\w+|_string\.go|_mock\.go|\.grpc\.\w+|\.swagger\.\w+)")
_DIR_GENERATED = r"(?i)(?:^|.*/)(?:generated|autogen|auto_gen|gen|__generated__|_generated|generated-sources|gen-src|pb)/.*"
_DIR_VENDORED = r"(?i)(?:^|.*/)_?(?:vendor|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|site-packages|dist-packages|jspm_packages|externals?|external[_-]libs|pods|carthage)/.*"
_NAME_MINIFIED = r"(?i).*(?:[.-]min\.\w+|\.packed\.\w+|\.bundle\.\w+|\.[0-9a-f]{6,}\.(?:chunk\.)?\w+|\.chunk\.\w+|-bundle\.\w+|\.umd\.\w+)"
_DIR_BUILT = r"(?i)(?:^|.*/)(?:dist|build|out|bundles?)/.*"


def _at(path: Column, pattern: str) -> Column:
    return F.coalesce(path.rlike(f"^(?:{pattern})$"), F.lit(False))


def module_evidence(modules: DataFrame, symbols: DataFrame, classes: DataFrame, cache_files: DataFrame, vendored: DataFrame) -> DataFrame:
    """One row per module id with everything that speaks for or against a hand: see :func:`unwritten_modules`.

    Duplicate rows of a module are one; where they differ the largest value stands. The size of a file
    is the largest any run saw. Modules without id are left out.
    """
    mods = modules.filter("id IS NOT NULL").groupBy("id").agg(
        F.max("path").alias("path"), F.max("loc").alias("loc"), F.max(F.lower(F.trim("language"))).alias("language"), F.max("docstring").alias("docstring"),
        F.max(F.lower("sha")).alias("sha"), F.max(F.size(F.coalesce("exports", F.array().cast("array<string>")))).alias("exports"))
    mods = mods.withColumn("path", F.coalesce("path", F.regexp_replace("id", "^file:", "")))
    laid = (spread(symbols.select("id", F.col("file_path").alias("path"), "code").filter("id IS NOT NULL AND path IS NOT NULL"))
            .mapInPandas(_layouts, LAYOUT_SCHEMA).groupBy("path", "id")
            .agg(*[F.max(c).alias(c) for c in ("found_lines", "canonical_lines", "code_chars", "literal_chars", "shape")]))
    sums = [F.sum(c).alias(c) for c in ("found_lines", "canonical_lines", "code_chars", "literal_chars")]
    # shapes first: a file with very many symbols of one shape is one row in the second step
    laid = laid.groupBy("path", "shape").agg(F.count("*").alias("n"), *sums).groupBy("path").agg(F.sum("n").alias("symbols"), F.count("*").alias("shapes"), *sums)
    reach = symbols.select(F.col("file_path").alias("path"), "line_end").unionByName(classes.select(F.col("file_path").alias("path"), "line_end")).filter("path IS NOT NULL")
    reach = reach.groupBy("path").agg(F.max("line_end").alias("covered_to"))
    sizes = cache_files.filter("path IS NOT NULL").groupBy("path").agg(F.max("size").alias("bytes"))
    copies = vendored.filter("sha IS NOT NULL").select(F.lower("sha").alias("sha"), F.lit(True).alias("known_copy")).distinct()
    rows = (mods.join(laid, "path", "left").join(reach, "path", "left").join(sizes, "path", "left").join(copies, "sha", "left"))
    lines = F.coalesce("loc", F.lit(0))
    code = F.when(F.col("found_lines").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.col("covered_to"), F.col("found_lines")) / F.nullif(lines, F.lit(0))))
    rows = cut(rows.withColumn("code_share", F.coalesce(code, F.lit(0.0))))  # one row per module; read three times, and lexing is the dear part
    # what a hand-laid line holds in canonical layout, per language and over all: few rows, one per language name
    source = rows.filter((F.col("code_share") >= MOSTLY_CODE) & (F.col("canonical_lines") > 0) & (F.col("bytes") > 0))
    line = F.sum("bytes") / F.sum("loc") * F.sum("found_lines") / F.sum("canonical_lines")
    usual = source.groupBy("language").agg(line.alias("usual_line"))
    over_all = source.agg(line.alias("_line"), (F.percentile_approx("loc", LONGEST, 10000) * DATA_FACTOR).alias("data_lines"))  # one row
    rows = rows.join(usual, "language", "left").join(F.broadcast(over_all))
    usual_line = F.coalesce("usual_line", "_line")
    return rows.select(
        "id", "path", "language", "loc", "bytes", "docstring", "symbols", "shapes", "exports", "covered_to", "code_share", "data_lines",
        F.coalesce("known_copy", F.lit(False)).alias("known_copy"),
        (F.col("bytes") / usual_line / F.when(F.col("loc") > 0, F.col("loc"))).alias("expansion"),
        (F.col("symbols") / F.col("shapes")).alias("per_shape"),
        (F.col("literal_chars") / F.nullif("code_chars", F.lit(0))).alias("literal_share"),
        F.greatest(F.coalesce(F.col("loc"), F.floor(F.col("bytes") / usual_line)) - F.coalesce("covered_to", F.lit(0)), F.lit(0)).alias("bare_lines"))


def unwritten_modules(evidence: DataFrame) -> DataFrame:
    """(id, reason, evidence) of modules no hand wrote; reason is vendored, minified, generated or data, in this order of precedence.

    vendored: the digest is that of a known third-party file, or the path has a package manager's
    folder; layout cannot tell whose hand wrote a file. minified: the expansion is at least ``MIN_EXPANSION`` on ``MIN_BYTES`` or more,
    or, where size or lines are unknown, the name is a bundler's. generated: the symbols are perfectly uniform (``UNIFORM_SYMBOLS`` or more,
    ``PER_SHAPE`` or more per canonical shape), or header, name or folder are a generator's and the file is not mostly laid-out code. data:
    no symbol, and more lines than ``DATA_FACTOR`` times the longest files that mostly are code, or half or more of a file with
    symbols and as many lines is literals. A large file, a telling domain or a header on generators is no evidence. Null
    loc, bytes, docstring and path are unknown and never evidence by themselves.
    """
    path, says = F.col("path"), F.regexp_replace(F.coalesce("docstring", F.lit("")), r"\s+", " ")
    true = lambda c: F.coalesce(c, F.lit(False))
    small = true(F.col("bytes") < MIN_BYTES)
    unlaid = F.col("code_share") < MOSTLY_CODE
    few_lines = F.coalesce(F.col("loc") < 30, F.lit(True))
    literals = (F.coalesce("symbols", F.lit(0)) == 0) | true(F.col("literal_share") >= 0.5)
    tests = [("vendored", "digest", F.col("known_copy")), ("vendored", "folder", _at(path, _DIR_VENDORED)),
             ("minified", "expansion", true(F.col("expansion") >= MIN_EXPANSION) & ~small & F.col("bytes").isNotNull()),
             ("minified", "name", F.col("expansion").isNull() & ~small & few_lines & (_at(path, _NAME_MINIFIED) | _at(path, _DIR_BUILT))),
             ("generated", "uniformity", true((F.col("symbols") >= UNIFORM_SYMBOLS) & (F.col("per_shape") >= PER_SHAPE))),
             ("generated", "header and layout", unlaid & _at(says, _SAYS_GENERATED)), ("generated", "name and layout", unlaid & (_at(path, _NAME_GENERATED) | _at(path, _DIR_GENERATED))),
             ("data", "extent without code", true(F.col("bare_lines") >= F.col("data_lines")) & literals)]
    told = F.coalesce(*[F.when(hit, F.struct(F.lit(reason).alias("reason"), F.lit(by).alias("evidence"))) for reason, by, hit in tests])
    return evidence.select("id", told.alias("_t")).filter("_t IS NOT NULL").select("id", "_t.reason", "_t.evidence")
