"""Change impact: from a diff to the symbols it touches and those that depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratograph.functions.paths import is_test_file
from stratograph.graph import CALLS, IMPORTS, REFERENCES, Graph
from stratograph.operators.traverse import union_of
from stratograph.session import cut

DEFAULT_HOPS, MAX_HOPS = 3, 8
DIFF_LINE_SCHEMA = "diff_id string, pos long, line string"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, pos, line) from (diff_id, text); null texts have no lines."""
    return diffs.filter("text IS NOT NULL").select("diff_id", F.posexplode(F.split("text", "\n"))).select("diff_id", F.col("pos").cast("long"), F.col("col").alias("line"))


def diff_spans(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_path, start, end): changed line ranges of the new side.

    A hunk without a count is one line, with a count of 0 one line too. Deleted files (new side
    ``/dev/null``) and files without hunks have none. The file of a hunk is that of the last header above it.
    """
    lines = diff_lines(diffs)
    header = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1)
    file = F.when(F.startswith("line", F.lit("+++ ")), F.trim(header))
    above = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.filter(F.startswith("line", F.lit("+++ ")) | F.startswith("line", F.lit("@@"))).withColumn("file_path", F.last(file, ignorenulls=True).over(above))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = marked.filter(F.col("line").rlike(hunk)).withColumn("start", F.regexp_extract("line", hunk, 1).cast("int"))
    count = F.coalesce(F.nullif(F.regexp_extract("line", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    return rows.filter("file_path IS NOT NULL AND file_path <> '/dev/null'").select("diff_id", "file_path", "start", (F.col("start") + F.greatest(count, F.lit(1)) - 1).alias("end"))


def changed_symbols(graph: Graph, spans: DataFrame) -> DataFrame:
    """Symbols and classes whose line range overlaps a span of their file: an interval join within each file.

    Ranges of 0-0 are unknown and never match; each symbol is one row, whatever number of spans touch it.
    """
    wanted = spans.select("file_path", "start", "end").distinct()
    rows = graph.nodes.filter("level IN ('L2', 'L3') AND line_start > 0 AND line_end > 0")
    hit = rows.join(wanted, "file_path").filter((F.col("start") <= F.col("line_end")) & (F.col("end") >= F.col("line_start")))
    return hit.select("id", "level", "name", "file_path", "kind", "signature", F.concat("line_start", F.lit("-"), "line_end").alias("lines"), "is_public").distinct()


def affected(graph: Graph, changed: DataFrame, max_hops: int = DEFAULT_HOPS, scope: str = "") -> DataFrame:
    """(id, name, file_path, kind, distance, is_test, target_symbol): what depends on the changed symbols.

    Only nodes that exist are expanded. ``target_symbol`` names the changed symbol from which a
    node was reached, the smallest of several. Tests are told by their path; scope ``tests`` or ``symbols``
    keeps one kind.
    """
    hops = DEFAULT_HOPS if max_hops <= 0 else min(max_hops, MAX_HOPS)
    e = graph.edges.filter(F.col("edge_type").isin(CALLS, IMPORTS, REFERENCES)).select("src", "dst")
    known = graph.nodes.select(F.col("id").alias("src"))
    seen = [cut(changed.select("id", F.col("name").alias("origin")).distinct().groupBy("id").agg(F.min("origin").alias("origin")).withColumn("distance", F.lit(0)))]
    for hop in range(1, hops + 1):
        new = seen[-1].select(F.col("id").alias("dst"), "origin").join(e, "dst").select(F.col("src").alias("id"), "origin")
        new = new.join(union_of([h.select("id") for h in seen]), "id", "left_anti").groupBy("id").agg(F.min("origin").alias("origin"))
        new = cut(new.join(known.withColumnRenamed("src", "id"), "id", "left_semi").withColumn("distance", F.lit(hop)))
        if not new.head(1):
            break
        seen.append(new)
    rows = graph.nodes.join(union_of(seen).filter("distance > 0"), "id")
    path = F.when(F.col("file_path") == "", F.col("path")).otherwise(F.col("file_path"))
    out = rows.select("id", "name", path.alias("file_path"), "kind", "distance", F.col("origin").alias("target_symbol")).withColumn("is_test", is_test_file(F.col("file_path")))
    return {"tests": out.filter("is_test"), "symbols": out.filter("NOT is_test")}.get(scope, out)


def change_summary(changed: DataFrame, reached: DataFrame) -> DataFrame:
    """One row: files and symbols changed, symbols and tests affected, score and tier."""
    a = changed.agg(F.count_distinct("file_path").alias("changed_files"), F.count("*").alias("changed_symbols"), F.coalesce(F.max("is_public"), F.lit(False)).alias("_public"))
    b = reached.agg(F.count_if(~F.col("is_test")).alias("affected_symbols"), F.count_if(F.col("is_test")).alias("affected_tests"))
    raw = (F.col("changed_symbols") * 10.0 + F.col("affected_symbols") * 4.0) * F.when(F.col("_public"), F.lit(1.5)).otherwise(F.lit(1.0))
    rows = a.join(F.broadcast(b)).withColumn("blast_score", F.round(F.least(F.lit(100.0), raw)).cast("long"))  # one row each
    s = F.col("blast_score")
    return rows.select("changed_files", "changed_symbols", "affected_symbols", "affected_tests", "blast_score", F.when(s >= 75, "CRITICAL").when(s >= 50, "HIGH").when(s >= 20, "MODERATE").otherwise("LOW").alias("risk_tier"))
