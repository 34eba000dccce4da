"""Structural query: filters over nodes, degrees, order and limit."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratograph.functions.paths import base_name, glob_regex
from stratograph.graph import Graph

LEVELS = ("L0", "L1", "L2", "L3")
DEFAULT_LIMIT, MAX_LIMIT, DOC_CHARS = 25, 100, 100


@dataclass(frozen=True)
class NodeQuery:
    """What to look for. Empty strings, zero complexity bounds and None bounds are inactive; a degree bound of 0 is a bound."""

    level: str = ""
    kind: str = ""
    name: str = ""
    file: str = ""
    min_complexity: int = 0
    max_complexity: int = 0
    is_public: bool | None = None
    min_in: int | None = None
    max_in: int | None = None
    min_out: int | None = None
    max_out: int | None = None
    sort: str = ""
    limit: int = 0


DEAD_CODE = NodeQuery(level="L3", max_in=0, max_out=0)
HOTSPOTS = NodeQuery(level="L3", min_in=5, sort="hotspot")


def name_matches(pattern: str) -> Column:
    """Case-insensitive: a regular expression if it has ``^``, ``$`` or ``.*``, else a substring; an invalid expression filters nothing."""
    name = F.when(F.col("name") == "", F.col("id")).otherwise(F.col("name"))
    if not any(x in pattern for x in ("^", "$", ".*")):
        return F.lower(name).contains(pattern.lower())
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(True)
    return name.rlike(f"(?i){pattern}")


def file_matches(pattern: str) -> Column:
    """Case-insensitive substring of the path, or a shell pattern on its base name."""
    path = F.lower(F.when(F.col("file_path") == "", F.col("path")).otherwise(F.col("file_path")))
    hit = path.contains(pattern.lower())
    return hit | base_name(path).rlike(glob_regex(pattern.lower())) if any(c in pattern for c in "*?[") else hit


def matching(graph: Graph, q: NodeQuery) -> DataFrame:
    """Nodes that pass the filters on their own columns; these reach the scan."""
    out = graph.nodes
    if q.level:
        out = out.filter(F.upper("level") == q.level.upper())
    if q.kind:
        out = out.filter(F.lower("kind") == q.kind.lower())
    if q.name:
        out = out.filter(name_matches(q.name))
    if q.file:
        out = out.filter(file_matches(q.file))
    if q.min_complexity > 0:
        out = out.filter(F.col("cyclomatic_complexity") >= q.min_complexity)
    if q.max_complexity > 0:
        out = out.filter(F.col("cyclomatic_complexity") <= q.max_complexity)
    if q.is_public is not None:
        out = out.filter(F.col("is_public") == q.is_public)
    return out


def with_degrees(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Add in_degree and out_degree over all edges but CONTAINS; nodes without edges have 0."""
    return nodes.join(graph.degrees(), "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("in_degree", "out_degree")})


def query(graph: Graph, q: NodeQuery) -> DataFrame:
    """Rows of the structural query, best first; ties by name and id, so the result is one and the same each time."""
    out = with_degrees(graph, matching(graph, q))
    for column, low, high in (("in_degree", q.min_in, q.max_in), ("out_degree", q.min_out, q.max_out)):
        if low is not None:
            out = out.filter(F.col(column) >= low)
        if high is not None:
            out = out.filter(F.col(column) <= high)
    order = {"complexity": [F.desc("cyclomatic_complexity"), "id"], "in_degree": [F.desc("in_degree"), "id"], "hotspot": [F.desc("in_degree"), "id"],
             "out_degree": [F.desc("out_degree"), "id"]}.get(q.sort.lower(), [F.desc("in_degree"), "name", "id"])
    limit = DEFAULT_LIMIT if q.limit <= 0 else min(q.limit, MAX_LIMIT)
    return out.orderBy(*order).limit(limit).select(*result_columns())


def result_columns() -> list[Column]:
    doc = F.when(F.length("docstring") > DOC_CHARS, F.concat(F.substring("docstring", 1, DOC_CHARS), F.lit("..."))).otherwise(F.col("docstring"))
    lines = F.when((F.col("line_start") > 0) & (F.col("line_end") > 0), F.concat(F.col("line_start"), F.lit("-"), F.col("line_end"))).otherwise(F.lit(""))
    path = F.when(F.col("file_path") == "", F.col("path")).otherwise(F.col("file_path"))
    return [F.col("id"), F.col("level"), F.col("name"), F.col("kind"), path.alias("file_path"), F.col("signature"), lines.alias("lines"), F.col("is_public"),
            F.col("cyclomatic_complexity"), F.col("in_degree"), F.col("out_degree"), doc.alias("docstring")]


def query_counts(graph: Graph, q: NodeQuery) -> DataFrame:
    """One row: nodes scanned (those of the level, if a known one is asked for), nodes matched before the limit."""
    scanned = graph.nodes.filter(F.upper("level") == q.level.upper()) if q.level.upper() in LEVELS else graph.nodes
    out = with_degrees(graph, matching(graph, q))
    for column, low, high in (("in_degree", q.min_in, q.max_in), ("out_degree", q.min_out, q.max_out)):
        out = out.filter((F.col(column) >= low) if low is not None else F.lit(True)).filter((F.col(column) <= high) if high is not None else F.lit(True))
    return scanned.agg(F.count("*").alias("total_scanned")).join(F.broadcast(out.agg(F.count("*").alias("total_matched"))))  # one row each


def narrowed(q: NodeQuery, **changes) -> NodeQuery:
    return replace(q, **changes)
