"""Endpoints: listing, and their place in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratograph.graph import CONTAINS, EXPOSES_ROUTE, HANDLED_BY, Graph, as_edges, as_nodes
from stratograph.operators.resolve import resolve_handlers


def joined_path(prefix: Column, sub: Column) -> Column:
    """A route path from the prefix of its class and its own: one slash between, none at the end, ``/`` for nothing."""
    p = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(prefix, F.lit(""))), "^(?=[^/])", "/"), "/+$", "")
    s = F.trim(F.coalesce(sub, F.lit("")))
    bare = F.regexp_replace(s, "^/+", "")
    alone = F.when(s == "", F.lit("/")).when(F.startswith(s, F.lit("/")), s).otherwise(F.concat(F.lit("/"), s))
    return F.when(F.trim(F.coalesce(prefix, F.lit(""))) == "", alone).when(bare == "", F.when(p == "", F.lit("/")).otherwise(p)).otherwise(F.concat(p, F.lit("/"), bare))


def list_routes(graph: Graph, path_pattern: str = "", method: str = "") -> DataFrame:
    """Routes whose path holds the pattern and whose method is the one asked for or ``ANY``; ``''`` and ``ALL`` mean all methods."""
    rows = graph.nodes.filter("level = 'Route'")
    if path_pattern:
        rows = rows.filter(F.lower("path").contains(path_pattern.lower()))
    if method and method.upper() != "ALL":
        rows = rows.filter(F.upper("method").isin(method.upper(), "ANY"))
    return rows.orderBy("path", "method", "file_path", "id").select("id", "method", "path", "handler_name", F.col("handler_symbol").alias("handler_id"), "file_path", "line", "framework")


def index_routes(graph: Graph, routes: DataFrame) -> Graph:
    """Add routes (id, method, path, handler_name, file_path, line, framework): nodes, three kinds of edges, and a tag on the handler.

    A tag (``METHOD path``) stands once however often a route is indexed. Routes whose handler is not in
    their file have a node and a CONTAINS edge only.
    """
    handlers = resolve_handlers(routes, graph.nodes.filter("level = 'L3'"))
    rows = routes.join(handlers, "id", "left").withColumns({"level": F.lit("Route"), "labels": F.array(F.lit("Route")), "handler_symbol": F.col("handler_id")})
    found = rows.filter("handler_id IS NOT NULL")
    tags = found.groupBy(F.col("handler_id").alias("id")).agg(F.collect_set(F.concat_ws(" ", "method", "path")).alias("_tags"))  # the routes of one function
    tagged = graph.nodes.join(tags, "id").withColumn("routes", F.array_sort(F.array_union("routes", "_tags"))).drop("_tags")
    edges = (as_edges(routes.select(F.concat(F.lit("file:"), "file_path").alias("src"), F.col("id").alias("dst"), F.lit(CONTAINS).alias("edge_type")))
             .unionByName(as_edges(found.select(F.col("id").alias("src"), F.col("handler_id").alias("dst"), F.lit(HANDLED_BY).alias("edge_type"))))
             .unionByName(as_edges(found.select(F.col("handler_id").alias("src"), F.col("id").alias("dst"), F.lit(EXPOSES_ROUTE).alias("edge_type")))))
    return graph.upsert_nodes(as_nodes(rows).unionByName(as_nodes(tagged))).upsert_edges(edges)
