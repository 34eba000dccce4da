"""Traversals: impact of a change on its callers, call trees, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratograph.graph import CALLS, CONTAINS, EXPOSES_ROUTE, HANDLED_BY, IMPORTS, REFERENCES, Graph
from stratograph.session import cut

MAX_HOPS, NODE_CAP, TREE_CAP, PATH_CAP, TREE_DEPTH, MAX_DEPTH = 4, 250, 150, 20, 3, 10
#: Weight of a kind of change; other kinds weigh 1.5.
CHANGE_WEIGHT = {"signature": 2.0, "removal": 2.5, "rename": 2.0, "body": 1.0}


def resolve_target(graph: Graph, target: str, through_classes: bool = False) -> DataFrame:
    """Node ids meant by a target: an exact id; else a file, which stands for its direct symbols (those of its classes too,
    if asked for) or itself if it has none; else all nodes of that full or short name; else the routes of that path, or method and path. The first that gives any counts."""
    nodes = graph.nodes.select("id", "level", "name", "path", "file_path")
    exact = nodes.filter((F.col("id") == target) & (F.col("level") != "L1")).select("id")
    file = nodes.filter((F.col("level") == "L1") & ((F.col("path") == target) | (F.col("id") == target))).select("id")
    inside = graph.of_type(CONTAINS).join(file.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    if through_classes:
        deeper = graph.of_type(CONTAINS).join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        inside = inside.unionByName(deeper)
    symbols = inside.join(nodes.filter("level = 'L3'").select("id"), "id", "left_semi")
    named = nodes.filter((F.col("name") == target) | F.endswith(F.col("name"), F.lit("." + target))).select("id")
    # a route by its path, or by method and path
    routes = graph.nodes.filter("level = 'Route'").filter((F.col("path") == target) | (F.concat_ws(" ", "method", "path") == target)).select("id")
    ranked = [exact, symbols, file, named, routes]
    out = ranked[0].withColumn("_rank", F.lit(0))
    for i, df in enumerate(ranked[1:], 1):
        out = out.unionByName(df.withColumn("_rank", F.lit(i)))
    best = out.agg(F.min("_rank").alias("_best"))
    return out.join(F.broadcast(best), F.col("_rank") == F.col("_best")).select("id").distinct()  # one row


def reverse_hops(edges: DataFrame, targets: DataFrame, max_hops: int, cap: int = 0, known: DataFrame | None = None) -> DataFrame:
    """(id, hop, edge_type, parent): nodes that reach a target against the edges, each at its smallest hop.

    ``edges``: src, dst, edge_type. Where several edges reach a node at that hop, the smallest
    (parent, type) stands. ``cap``: nodes (targets included) after which no further node is expanded; the
    nodes of one that was already begun all count, so a hub may exceed it. ``known``: only these ids
    are expanded further (others are reached but lead nowhere). One join and one anti-join a hop.
    """
    e = edges.select("src", "dst", "edge_type")
    hops = [cut(targets.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit("").alias("edge_type"), F.lit("").alias("parent")))]
    total = hops[0].count() if cap else 0
    for hop in range(1, max_hops + 1):
        if cap and total >= cap:
            break
        start = hops[-1].select(F.col("id").alias("dst"))
        if known is not None:
            start = start.join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
        hits = start.join(e, "dst").select(F.col("src").alias("id"), F.struct(F.col("dst").alias("parent"), "edge_type").alias("by"))
        # every hop is written once; what was seen is the union of the hops as written
        new = hits.join(union_of([h.select("id") for h in hops]), "id", "left_anti").groupBy("id").agg(F.min("by").alias("by")).select("id", F.lit(hop).alias("hop"), "by.edge_type", "by.parent")
        if cap:
            # parents are expanded in the order of their ids: a parent whose predecessors already filled the cap is not; every parent
            # brings a node, so beyond cap parents none has room
            per_parent = new.groupBy("parent").agg(F.count("*").alias("n")).orderBy("parent").limit(cap)
            room = per_parent.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most cap rows
            new = new.join(F.broadcast(room.filter(F.col("before") < cap - total).select("parent")), "parent", "left_semi").select("id", "hop", "edge_type", "parent")  # at most cap rows
        new = cut(new)
        n = new.count() if cap else len(new.head(1))
        if not n:
            break
        hops.append(new)
        total += n
    return union_of(hops)


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blast_radius(graph: Graph, targets: DataFrame, change: str = "signature", max_hops: int = MAX_HOPS, cap: int = NODE_CAP) -> DataFrame:
    """Callers of the targets with their impact: node_id, symbol_name, file_path, domain, level, edge_type, hop_distance, impact_score, line.

    score = 10 * 0.5^(hop-1), times 1.8 if any target is public, times the weight of the change, times
    1.5 for a domain that is not a target's (``root`` never counts as one); rounded to 2. Nodes
    that do not exist are expanded but not reported.
    """
    types = graph.edges.filter(F.col("edge_type").isin(CALLS, IMPORTS, REFERENCES))
    hit = reverse_hops(types, targets, max_hops, cap).filter("hop > 0")
    files = graph.nodes.filter("level = 'L1' AND path <> ''").groupBy("path").agg(F.max("domain").alias("_file_domain"))
    place = graph.nodes.select("id", "name", "level", "is_public", F.when(F.col("file_path") == "", F.col("path")).otherwise(F.col("file_path")).alias("file_path"), "domain", "line_start")
    place = place.join(files.withColumnRenamed("path", "file_path"), "file_path", "left").withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.nullif("_file_domain", F.lit("")), F.lit("root")))
    of_targets = place.join(targets.select("id").distinct(), "id", "left_semi")
    public = of_targets.agg(F.coalesce(F.max("is_public"), F.lit(False)).alias("_public"))
    home = of_targets.select(F.col("domain").alias("_home")).distinct()
    # places are those of the nodes hit, so a domain that holds most files is as large here as the answer
    rows = place.join(hit, "id").join(home, F.col("domain") == F.col("_home"), "left").join(F.broadcast(public))  # one row
    cross = F.when((F.col("domain") != "root") & F.col("_home").isNull(), F.lit(1.5)).otherwise(F.lit(1.0))
    score = F.lit(10.0) * F.pow(F.lit(0.5), F.col("hop") - 1) * F.when(F.col("_public"), F.lit(1.8)).otherwise(F.lit(1.0)) * F.lit(CHANGE_WEIGHT.get(change, 1.5)) * cross
    return rows.select(F.col("id").alias("node_id"), F.col("name").alias("symbol_name"), "file_path", "domain", "level", "edge_type", F.col("hop").alias("hop_distance"), F.round(score, 2).alias("impact_score"), F.col("line_start").alias("line"))


def top_impact(radius: DataFrame, limit: int = 10) -> DataFrame:
    return radius.orderBy(F.desc("impact_score"), "hop_distance", "node_id").limit(limit)


def truncated(found: DataFrame, cap: int, targets: int = 1) -> DataFrame:
    """One row: whether a traversal was ended by its cap; ``targets`` count towards the cap of a blast radius, give 0 for trees and paths."""
    return found.agg((F.count("*") + F.lit(targets) >= F.lit(cap if cap else 2**62)).alias("truncated"))


def trace_metrics(tree: DataFrame, paths: DataFrame | None = None, cap: int = TREE_CAP) -> DataFrame:
    """One row: nodes and edges of a call tree, its depth, nodes that are entered but not left, paths found and the length of the shortest, and whether the cap ended it."""
    ends = tree.select(F.col("to_id").alias("id")).distinct().join(tree.select(F.col("from_id").alias("id")).distinct(), "id", "left_anti").agg(F.count("*").alias("leaves"))
    nodes = tree.select(F.explode(F.array("from_id", "to_id")).alias("id")).agg(F.count_distinct("id").alias("nodes"))
    row = tree.agg(F.count("*").alias("edges"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), (F.count("*") >= F.lit(cap if cap else 2**62)).alias("truncated"))
    found = tree.sparkSession.range(1).select(F.lit(0).cast("long").alias("paths"), F.lit(0).alias("shortest")) if paths is None else paths.agg(F.count("*").alias("paths"), F.coalesce(F.min("hops"), F.lit(0)).alias("shortest"))
    return row.join(F.broadcast(nodes)).join(F.broadcast(ends)).join(F.broadcast(found)).select("nodes", "edges", "leaves", "max_depth", "paths", "shortest", "truncated")  # one row each


def blast_summary(radius: DataFrame) -> DataFrame:
    """One row: score, tier, symbols, files, domains."""
    agg = radius.agg(F.least(F.lit(100), F.floor(F.coalesce(F.sum("impact_score"), F.lit(0.0)) * 1.5)).cast("long").alias("blast_score"), F.count("*").alias("total_affected_symbols"),
                     F.count_distinct(F.nullif("file_path", F.lit(""))).alias("total_affected_files"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("affected_domains"))
    s = F.col("blast_score")
    return agg.select("blast_score", F.when(s >= 75, "CRITICAL").when(s >= 45, "HIGH").when(s >= 20, "MODERATE").otherwise("LOW").alias("risk_tier"), "total_affected_symbols", "total_affected_files", "affected_domains")


def blast_tree(radius: DataFrame, title: str, limit: int = 10) -> str:
    """The first rows as text."""
    lines = [title]
    for r in top_impact(radius, limit).collect():
        lines.append(f"{'  ' * r['hop_distance']}+- [{r['impact_score']:.2f}] {r['symbol_name'] or r['node_id']} ({r['file_path']}:{r['line']}) via {r['edge_type']}")
    return "\n".join(lines)


def directed_edges(graph: Graph, direction: str = "outbound") -> DataFrame:
    """(from_id, to_id, relationship) for outbound (calls and handlers), inbound (the same reversed under other names) or both."""
    e = graph.edges.filter(F.col("edge_type").isin(CALLS, HANDLED_BY))
    out = e.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.col("edge_type").alias("relationship"))
    back = e.select(F.col("dst").alias("from_id"), F.col("src").alias("to_id"), F.when(F.col("edge_type") == CALLS, "CALLED_BY").otherwise(EXPOSES_ROUTE).alias("relationship"))
    return {"outbound": out, "inbound": back}.get(direction, out.unionByName(back))


def call_tree(graph: Graph, sources: DataFrame, direction: str = "outbound", max_depth: int = TREE_DEPTH, cap: int = TREE_CAP) -> DataFrame:
    """(depth, relationship, from_id, to_id, from_name, to_name): every edge from a node within reach, once, at the depth it is first met.

    Ordered by depth, name and ids before the cap, so that the same rows remain each time; 0 for all.
    """
    max_depth = min(max(1, max_depth), MAX_DEPTH)
    e = directed_edges(graph, direction)
    # distance from the sources: reverse hops over reversed edges
    dist = reverse_hops(e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), F.col("relationship").alias("edge_type")), sources, max_depth - 1) if max_depth > 1 else sources.select("id", F.lit(0).alias("hop"))
    rows = e.join(dist.select(F.col("id").alias("from_id"), "hop"), "from_id").select((F.col("hop") + 1).alias("depth"), "relationship", "from_id", "to_id").distinct()
    names = graph.nodes.select("id", F.when(F.col("name") == "", F.col("path")).otherwise(F.col("name")).alias("n"))
    rows = rows.join(names.select(F.col("id").alias("to_id"), F.col("n").alias("to_name")), "to_id").join(names.select(F.col("id").alias("from_id"), F.col("n").alias("from_name")), "from_id")
    rows = rows.select("depth", "relationship", "from_id", "to_id", "from_name", "to_name")
    return rows.orderBy("depth", "to_name", "from_id", "to_id", "relationship").limit(cap) if cap else rows


def call_paths(graph: Graph, sources: DataFrame, targets: DataFrame, direction: str = "outbound", max_depth: int = TREE_DEPTH, cap: int = PATH_CAP) -> DataFrame:
    """(hops, path): simple paths that end at the first target they meet, shortest first; 0 for all.

    Sources that are targets are left out. Only nodes from which a target can be reached in the hops that
    are left are stepped on, so no path is carried that leads nowhere.
    """
    max_depth = min(max(1, max_depth), MAX_DEPTH)
    e = cut(directed_edges(graph, direction).filter("from_id <> to_id").select("from_id", "to_id").distinct())
    goal = cut(targets.select("id").distinct())
    near = reverse_hops(e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("").alias("edge_type")), goal, max_depth).select(F.col("id").alias("to_id"), F.col("hop").alias("left"))
    paths = sources.select("id").distinct().join(goal, "id", "left_anti").select(F.col("id").alias("at"), F.array("id").alias("path"))
    found = None
    for depth in range(1, max_depth + 1):
        step = e.join(near.filter(F.col("left") <= max_depth - depth), "to_id")
        paths = paths.join(step, F.col("at") == F.col("from_id")).filter(~F.array_contains("path", F.col("to_id"))).select(F.col("to_id").alias("at"), F.array_append("path", F.col("to_id")).alias("path"), (F.col("left") == 0).alias("_there"))
        arrived = paths.filter("_there").select(F.lit(depth).alias("hops"), F.array_join("path", " -> ").alias("path"))
        found = arrived if found is None else found.unionByName(arrived)
        paths = paths.filter("NOT _there").drop("_there")
    return found.orderBy("hops", "path").limit(cap) if cap else found
