"""Incremental maintenance: what changed since the manifest, and the graph after it.

A delta is defined by its result: it equals a full rebuild. Nodes of changed and deleted files are
replaced, and edges are resolved again from all specs and calls, since one new symbol can make a
call of an untouched file resolvable or ambiguous; parsing, by far the dearest step, is confined to what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratograph.graph import Graph, as_nodes

MANIFEST_VERSION = "2"
MANIFEST_SCHEMA = "path string, sha string, mtime long, size long, domain string"


def classify(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change) with change added, modified, unchanged or deleted.

    ``scan`` and ``manifest``: path, sha, mtime, size. A file is modified if its mtime or size differ and its
    digest (without regard to case) too; equal digests or equal mtime and size leave it unchanged. Unknown
    (null) mtime or size count as different. Repeated rows of a path count once, the newest.
    """
    newest = Window.partitionBy("path").orderBy(F.desc_nulls_last("mtime"), F.desc_nulls_last("sha"))
    once = lambda df: df.select("path", F.lower("sha").alias("sha"), "mtime", "size").filter("path IS NOT NULL").withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
    s, m = once(scan).alias("s"), once(manifest).alias("m")
    both = s.join(m, F.col("s.path") == F.col("m.path"), "full_outer")
    touched = ~F.coalesce((F.col("s.mtime") == F.col("m.mtime")) & (F.col("s.size") == F.col("m.size")), F.lit(False))
    change = (F.when(F.col("m.path").isNull(), "added").when(F.col("s.path").isNull(), "deleted")
              .when(touched & ~F.col("s.sha").eqNullSafe(F.col("m.sha")), "modified").otherwise("unchanged"))
    return both.select(F.coalesce("s.path", "m.path").alias("path"), change.alias("change"))


def drifted(graph: Graph, manifest: DataFrame, recorded_nodes: int | None = None, recorded_edges: int | None = None) -> bool:
    """Whether the stored graph does not fit what the last sync recorded: then everything is done anew."""
    counts = graph.counts().first()
    if recorded_nodes is not None and counts["total_nodes"] != recorded_nodes or recorded_edges is not None and counts["total_edges"] != recorded_edges:
        return True
    return counts["l1_nodes"] != manifest.select("path").distinct().count()


def last_intents(journal: DataFrame, key: str = "node_id", seq: str = "seq") -> DataFrame:
    """The entry of highest sequence number of each key: replaying these gives the same as replaying all."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(seq)))
    return journal.filter(F.col(key).isNotNull()).withColumn("_r", rank).filter("_r = 1").drop("_r")


def apply_journal(graph: Graph, journal: DataFrame, rows: DataFrame) -> Graph:
    """Deletes take nodes and their edges, upserts bring the row of ``rows`` of that id; only the last intent of a key counts."""
    last = last_intents(journal)
    out = graph.delete_nodes(last.filter("op = 'delete'").select(F.col("node_id").alias("id")))
    return out.upsert_nodes(rows.join(last.filter("op = 'upsert'").select(F.col("node_id").alias("id")), "id", "left_semi"))


def domain_nodes(files: DataFrame) -> DataFrame:
    """One L0 node per domain that has files, with their number. ``files``: path, domain."""
    counted = files.select("path", "domain").distinct().groupBy("domain").agg(F.count("*").cast("int").alias("module_count")).filter("domain IS NOT NULL AND domain <> ''")
    return as_nodes(counted.select(F.concat(F.lit("domain:"), "domain").alias("id"), F.lit("L0").alias("level"), F.col("domain").alias("name"), F.col("domain").alias("path"), "module_count", F.array(F.lit("L0Domain"), F.lit("Domain")).alias("labels")))


def save_mode(ops: int | None, nodes: int, edges: int, forced: bool = False, exists: bool = True) -> str:
    """``full`` if there is no journal, nothing stored, a full save is forced, or more changes than max(2000, a quarter of the graph); else ``delta``."""
    return "full" if forced or not exists or ops is None or ops > max(2000, (nodes + edges) // 4) else "delta"


def owned_only(graph: Graph, files: DataFrame) -> Graph:
    """The graph without nodes of files that are gone and domains without files."""
    paths = files.select("path", "domain").distinct()
    place: Column = F.when(F.col("level") == "L1", F.col("path")).otherwise(F.col("file_path"))
    inner = graph.nodes.filter("level <> 'L0'").withColumn("_p", place)
    stale = inner.join(paths.select(F.col("path").alias("_p")), "_p", "left_anti").select("id")
    idle = graph.nodes.filter("level = 'L0'").join(paths.select(F.col("domain").alias("name")), "name", "left_anti").select("id")
    return graph.delete_nodes(stale.unionByName(idle))
