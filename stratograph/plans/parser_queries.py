"""Queries that run the parsers over the source of stored symbols, with statements that tell the same by plain text functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratograph.parsing import parse_file
from stratograph.session import spread
from stratograph.sources.tables import latest, table

_BRACED = ("java", "kt", "cs", "swift", "php", "rs", "c", "h", "cc", "cpp", "hpp")


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(table(spark, folder, "symbol_nodes", "id", "name", "file_path", "code", "synced_at", "ingested_at"), "id", "synced_at", "ingested_at")
    return rows.select("id", F.regexp_extract("file_path", r"\.([a-z]+)$", 1).alias("ext"), "code").filter(F.col("code").contains("("))


def x_braced(spark: SparkSession, folder: str) -> DataFrame:
    """(id, declared, complexity): what the reader of brace languages finds as the first function in each symbol's source, where that is whole.

    Source whose braces close before its end, or not at all, is part of a function, whose end no reader can know.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, ext, code in batch.itertuples(index=False):
                found = parse_file(f"x/a.{ext}", code).symbols
                if found and found[0]["line_end"] == code.rstrip().count("\n") + 1 and code.count("{") == code.count("}"):
                    rows.append((id_, found[0]["name"], found[0]["cyclomatic_complexity"]))
            yield pd.DataFrame(rows, columns=["id", "declared", "complexity"])

    rows = _symbols(spark, folder).filter(F.col("ext").isin(*_BRACED))
    return spread(rows).mapInPandas(run, "id string, declared string, complexity long")


QUERIES = {"x_braced": x_braced}

ORACLES = {
    "x_braced": r"""
WITH s AS (SELECT DISTINCT ON (id) id, name, regexp_extract(file_path, '\.([a-z]+)$', 1) AS ext, code FROM symbol_nodes WHERE id IS NOT NULL ORDER BY id, synced_at DESC NULLS LAST, ingested_at DESC NULLS LAST),
 n AS (SELECT id, unnest(range(1, len(string_split(rtrim(code, chr(10) || ' '), chr(10))) + 1)) AS i, unnest(string_split(rtrim(code, chr(10) || ' '), chr(10))) AS line FROM s WHERE contains(code, '(')),
 o AS (SELECT id, i, max(i) OVER (PARTITION BY id) AS last, sum(length(replace(line, '}', '')) - length(replace(line, '{', ''))) OVER (PARTITION BY id ORDER BY i) AS depth, sum(length(line) - length(replace(line, '{', ''))) OVER (PARTITION BY id ORDER BY i) AS opened FROM n),
 broken AS (SELECT DISTINCT id FROM o WHERE i < last AND opened > 0 AND depth <= 0),
 l AS (SELECT id, name, ext, trim(unnest(string_split(code, chr(10)))) AS line FROM s WHERE id NOT IN (SELECT id FROM broken) AND contains(code, '(') AND length(replace(code, '{', '')) = length(replace(code, '}', '')) AND ext IN ('java', 'kt', 'cs', 'swift', 'php', 'rs', 'c', 'h', 'cc', 'cpp', 'hpp')),
 m AS (SELECT id, name, regexp_replace(regexp_replace(line, '"[^"]*"', '""', 'g'), '//.*$', '') AS line, CASE ext
   WHEN 'java' THEN '^(if|for|while|case|catch) ' WHEN 'kt' THEN '^(if|when|for|while|catch) ' WHEN 'cs' THEN '^(if|for|foreach|while|switch|catch) ' WHEN 'swift' THEN '^(if|guard|for|while|switch|catch) '
   WHEN 'php' THEN '^(if|for|foreach|while|switch|catch) ' WHEN 'rs' THEN '^(if|match|for|while) ' ELSE '^(if|for|while|case|catch) ' END AS branch,
   CASE WHEN ext IN ('cs', 'swift', 'php') THEN ' (&&|\|\||\?\?) ' ELSE ' (&&|\|\|) ' END AS joint FROM l WHERE NOT regexp_matches(line, '^(\*|/\*|#)'))
SELECT id, string_split(any_value(name), '.')[-1] AS declared, 1 + sum(CAST(regexp_matches(line, branch) AS INT) + CAST(regexp_matches(line, joint) AS INT))::BIGINT AS complexity FROM m GROUP BY id""",
}
