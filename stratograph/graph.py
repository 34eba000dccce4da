"""The property graph: two DataFrames with fixed schemas and the operators of a store over them."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratograph.session import shared_dir
from stratograph.sources.tables import latest, table


#: Columns of ``nodes`` with the value that stands for "absent": queries never see a null here.
NODE_FIELDS: dict[str, tuple[str, object]] = {
    "id": ("string", None), "level": ("string", ""), "labels": ("array<string>", []), "name": ("string", ""), "path": ("string", ""), "file_path": ("string", ""),
    "kind": ("string", ""), "language": ("string", ""), "domain": ("string", ""), "layer": ("string", ""), "description": ("string", ""), "module_count": ("int", 0),
    "loc": ("int", 0), "sha": ("string", ""), "docstring": ("string", ""), "filename": ("string", ""), "exports": ("array<string>", []), "import_paths": ("array<string>", []),
    "bases": ("array<string>", []), "line_start": ("int", 0), "line_end": ("int", 0), "is_public": ("boolean", False), "method_signatures": ("array<string>", []),
    "field_signatures": ("array<string>", []), "parent_id": ("string", ""), "signature": ("string", ""), "return_type": ("string", ""), "params": ("array<string>", []),
    "code": ("string", ""), "cyclomatic_complexity": ("int", 0), "calls": ("array<string>", []), "references": ("array<string>", []), "method": ("string", ""),
    "handler_name": ("string", ""), "handler_symbol": ("string", ""), "line": ("int", 0), "framework": ("string", ""), "routes": ("array<string>", []),
}
EDGE_SCHEMA = "src string, dst string, edge_type string, imported_names array<string>, spec string"
CONTAINS, IMPORTS, CALLS, REFERENCES, HANDLED_BY, EXPOSES_ROUTE = "CONTAINS", "IMPORTS", "CALLS", "REFERENCES", "HANDLED_BY", "EXPOSES_ROUTE"
#: Type of an edge that came without one.
UNTYPED = "RELATES"


def _zero(kind: str, value: object) -> Column:
    if value == []:
        return F.array().cast(kind)
    return F.lit(value).cast(kind)


def as_nodes(df: DataFrame) -> DataFrame:
    """Bring rows to the node schema: missing columns and nulls become zero values, foreign columns go, null ids are dropped."""
    have = set(df.columns)
    columns = []
    for name, (kind, zero) in NODE_FIELDS.items():
        col = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        columns.append((col if zero is None else F.coalesce(col, _zero(kind, zero))).alias(name))
    return df.select(*columns).filter(F.col("id").isNotNull())


def as_edges(df: DataFrame) -> DataFrame:
    """Bring rows to the edge schema; rows without an end are dropped, a blank type becomes ``RELATES``."""
    have = set(df.columns)
    kind = F.trim(F.coalesce("edge_type", F.lit(""))) if "edge_type" in have else F.lit("")
    return df.select(
        "src", "dst", F.when(kind == "", F.lit(UNTYPED)).otherwise(kind).alias("edge_type"),
        (F.coalesce("imported_names", F.array().cast("array<string>")) if "imported_names" in have else F.array().cast("array<string>")).alias("imported_names"),
        (F.coalesce("spec", F.lit("")) if "spec" in have else F.lit("")).alias("spec")).filter("src IS NOT NULL AND dst IS NOT NULL")


@dataclass(frozen=True)
class Graph:
    """Immutable pair of DataFrames; every operator returns a DataFrame or a new graph."""

    nodes: DataFrame
    edges: DataFrame
    #: Folder of the stored search index of exactly these nodes; '' where there is none.
    index: str = ""

    # ---- building ------------------------------------------------------------------------------
    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """From rows: of several rows with one id, and of several edges with the same ends and type, one is kept."""
        return cls(as_nodes(nodes).dropDuplicates(["id"]), as_edges(edges).dropDuplicates(["src", "edge_type", "dst"]))

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> Graph:
        """The graph of a data folder: newest row per id, edges resolved from the columns that name other nodes."""
        from stratograph.operators import resolve

        nodes = table_nodes(spark, folder)
        return cls(nodes, resolve.table_edges(nodes))

    @classmethod
    def indexed(cls, spark: SparkSession, folder: str, rebuild: bool = False) -> Graph:
        """:meth:`from_tables`, built once per state of the tables and then read from the shared folder.

        The stored graph is keyed by path, length and time of every file it was built from and by the code
        that builds it; the shared folder may outlive the session, and then so does the graph, unless
        ``rebuild`` asks for a new one. It becomes
        visible by a rename: readers see all of it or nothing. Nodes lie by level and edges by
        type, so a query opens only what it filters for, and only the columns it names.
        """
        root = f"{shared_dir(spark)}/graphs/{_state(spark, folder)}"
        fs, path = _files(spark, root)
        if rebuild:
            fs.delete(path(root), True)
        if not fs.exists(path(root)):
            made = f"{root}.{uuid.uuid4().hex}"
            graph = cls.from_tables(spark, folder)
            # one pass over the tables: edges are resolved from the nodes as stored
            graph.nodes.write.partitionBy("level").parquet(f"{made}/nodes")
            from stratograph.operators import resolve, search

            stored = cls._stored_nodes(spark, made)
            resolve.table_edges(stored).write.partitionBy("edge_type").parquet(f"{made}/edges")
            search.store_index(cls(stored, stored), f"{made}/index")
            if not fs.rename(path(made), path(root)) or not fs.exists(path(f"{root}/nodes")):
                fs.delete(path(made), True)  # another run was faster
        return cls(cls._stored_nodes(spark, root), spark.read.schema(EDGE_SCHEMA).parquet(f"{root}/edges"), f"{root}/index")

    @classmethod
    def built(cls, spark: SparkSession, folder: str) -> Graph | None:
        """What :meth:`indexed` has stored for this state of the tables; none if it was not asked yet."""
        root = f"{shared_dir(spark)}/graphs/{_state(spark, folder)}"
        fs, path = _files(spark, root)
        return cls.indexed(spark, folder) if fs.exists(path(root)) else None

    @staticmethod
    def _stored_nodes(spark: SparkSession, root: str) -> DataFrame:
        schema = ", ".join(f"{name} {kind}" for name, (kind, _) in NODE_FIELDS.items())
        return spark.read.schema(schema).parquet(f"{root}/nodes").select(*NODE_FIELDS)

    def published(self) -> Graph:
        """Without edges that lack an end: what a full save stores."""
        ids = self.nodes.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes, edges.select(*self.edges.columns))

    # ---- changes -------------------------------------------------------------------------------
    def upsert_nodes(self, rows: DataFrame) -> Graph:
        """Rows replace nodes of the same id, others are added."""
        new = as_nodes(rows).dropDuplicates(["id"])
        return Graph(self.nodes.join(new.select("id"), "id", "left_anti").unionByName(new), self.edges)

    def upsert_edges(self, rows: DataFrame) -> Graph:
        key = ["src", "edge_type", "dst"]
        new = as_edges(rows).dropDuplicates(key)
        return Graph(self.nodes, self.edges.join(new.select(*key), key, "left_anti").select(*self.edges.columns).unionByName(new))

    def delete_nodes(self, ids: DataFrame) -> Graph:
        """Remove nodes and all their edges; ``ids`` has a column id."""
        ids = ids.select("id").filter("id IS NOT NULL").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.nodes.join(ids, "id", "left_anti").select(*self.nodes.columns), edges.select(*self.edges.columns))

    def delete_file(self, path: str) -> Graph:
        """Remove every node that is the file or lies in it."""
        return self.delete_nodes(self.nodes.filter((F.col("file_path") == path) | (F.col("path") == path)))

    def delete_edges(self, types: list[str] | None = None, source: str | None = None, target: str | None = None) -> Graph:
        """Remove edges by type, source and target; what is not given matches all."""
        hit = F.lit(True)
        if types:
            hit = hit & F.col("edge_type").isin(types)
        if source is not None:
            hit = hit & (F.col("src") == source)
        if target is not None:
            hit = hit & (F.col("dst") == target)
        return Graph(self.nodes, self.edges.filter(~hit))

    def changed_nodes(self, rows: DataFrame) -> DataFrame:
        """Of ``rows`` those that would change a node or add one: equal rows are no change."""
        new = as_nodes(rows).dropDuplicates(["id"])
        same = F.lit(True)
        for c in NODE_FIELDS:
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
        return new.alias("n").join(self.nodes.alias("o"), F.col("n.id") == F.col("o.id"), "left").filter(F.col("o.id").isNull() | ~same).select("n.*")

    # ---- reading -------------------------------------------------------------------------------
    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def has(self, node_id: str) -> bool:
        return bool(self.nodes.filter(F.col("id") == node_id).select("id").head(1))

    def outgoing(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        return self.of_type(edge_type).filter(F.col("src") == node_id)

    def incoming(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        return self.of_type(edge_type).filter(F.col("dst") == node_id)

    def of_type(self, edge_type: str | None = None) -> DataFrame:
        return self.edges.filter(F.col("edge_type") == edge_type) if edge_type else self.edges

    def with_property(self, label: str, key: str, value: object, limit: int = 0) -> DataFrame:
        """Nodes with a label and a property of a value, by id; limit 0 means all."""
        out = self.nodes.filter(F.array_contains("labels", label) & F.col(key).eqNullSafe(F.lit(value)))
        return out.orderBy("id").limit(limit) if limit else out

    def named(self, name: str, file: str | None = None) -> DataFrame:
        """Nodes called ``name``, or ``something.name``; optionally in one file."""
        hit = (F.col("name") == name) | F.endswith(F.col("name"), F.lit("." + name))
        if file:
            hit = hit & (F.col("file_path") == file.replace("\\", "/"))
        return self.nodes.filter(hit)

    def select(self, level: str | None = None, domain: str | None = None, limit: int = 0) -> DataFrame:
        out = self.nodes
        if level:
            out = out.filter(F.upper("level") == level.upper())
        if domain:
            out = out.filter(F.col("domain") == domain)
        return out.orderBy("id").limit(limit) if limit else out

    def counts(self) -> DataFrame:
        """One row: nodes, edges and nodes per level."""
        by_level = self.nodes.agg(F.count("*").alias("total_nodes"), *[F.count_if(F.col("level") == x).alias(f"{x.lower()}_nodes") for x in ("L0", "L1", "L2", "L3")])
        return by_level.join(F.broadcast(self.edges.agg(F.count("*").alias("total_edges"))))  # one row each

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) over all edges but CONTAINS, for nodes that have any: one aggregate."""
        ends = self.edges.filter(F.col("edge_type") != CONTAINS)
        both = ends.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(ends.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        return both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


_TABLES = ("domain_nodes", "module_nodes", "class_nodes", "symbol_nodes", "route_endpoints")


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(at).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _state(spark: SparkSession, folder: str) -> str:
    """Fingerprint of the files of the node tables."""
    from stratograph.operators import resolve, search, skew
    from stratograph.sources import tables

    # a graph stored by other code is another graph
    seen = [hashlib.sha256(Path(m).read_bytes()).hexdigest() for m in (__file__, resolve.__file__, search.__file__, skew.__file__, tables.__file__)]
    for t in _TABLES:
        at = f"{folder.rstrip('/')}/{t}.parquet"
        fs, path = _files(spark, at)
        files = fs.listFiles(path(at), True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def table_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the tables of a data folder: the newest row of each id."""
    read = lambda t: table(spark, folder, t)
    domains = latest(read("domain_nodes"), "id", "name")
    modules = latest(read("module_nodes"), "id", "synced_at").withColumn("language", F.lower(F.trim("language"))).withColumn("name", F.col("filename"))
    classes = latest(read("class_nodes"), "id", "synced_at")
    symbols = latest(read("symbol_nodes"), "id", "synced_at", "ingested_at").withColumnRenamed("refs", "references")
    routes = latest(read("route_endpoints"), "id", "synced_at").withColumn("level", F.lit("Route")).withColumn("handler_symbol", F.col("handler_id")).withColumn("labels", F.array(F.lit("Route")))
    parts = [as_nodes(x) for x in (domains, modules, classes, symbols, routes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
