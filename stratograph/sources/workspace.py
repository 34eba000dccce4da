"""Workspaces: scanning folders, parsing their files, the graph of a workspace and its upkeep."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from stratograph.functions import paths
from stratograph.graph import CALLS, CONTAINS, EDGE_SCHEMA, IMPORTS, NODE_FIELDS, Graph, as_edges, as_nodes
from stratograph.operators import resolve, routes, sync
from stratograph.parsing import parse_file
from stratograph.session import Files, cut

SCAN_SCHEMA = "path string, sha string, mtime long, size long, content string"
_STRINGS = "array<string>"
PARSED_SCHEMA = f"""path string,
  nodes array<struct<id string, level string, labels {_STRINGS}, name string, path string, file_path string, kind string, language string, domain string, layer string, loc int, sha string, docstring string, filename string,
    exports {_STRINGS}, import_paths {_STRINGS}, bases {_STRINGS}, line_start int, line_end int, is_public boolean, method_signatures {_STRINGS}, field_signatures {_STRINGS}, parent_id string, signature string, return_type string,
    params {_STRINGS}, code string, cyclomatic_complexity int, calls {_STRINGS}, references {_STRINGS}>>,
  imports array<struct<source_file string, module_spec string, names {_STRINGS}, is_relative boolean>>,
  calls array<struct<caller_id string, called_name string, line_number int>>,
  routes array<struct<id string, method string, path string, handler_name string, file_path string, line int, framework string>>"""


def read_ignore_file(spark: SparkSession, root: str, name: str = ".ignore") -> list[str]:
    """Further patterns of a workspace: lines of its ignore file without comments and trailing slashes."""
    text = Files(spark, root).read(name) or ""
    return [x.strip().rstrip("/") for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, content: bool = True, only: list[str] | None = None) -> DataFrame:
    """(path, sha, mtime, size, content) of every file of an indexed language that is not ignored; paths are relative to ``root``.

    Listing, reading and hashing are Spark's own file source, so a tree of any size is spread over
    tasks; mtime is in nanoseconds. Texts that are not UTF-8 keep what can be read. Without ``content`` files are listed, not opened, and have
    no sha and content. ``only``: relative paths of the files wanted; those that do not exist are left out.
    """
    reader = spark.read.format("binaryFile")
    if only is None:
        files = reader.option("recursiveFileLookup", "true").load(root)
    else:
        there = [f"{root.rstrip('/')}/{p}" for p in only if Files(spark, root).exists(p)]
        files = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    base = re.sub(r"/+$", "", root if "://" in root else os.path.abspath(root))
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(re.sub(r"^file:/*", "/", base)) + "/", "")
    patterns = [*paths.IGNORED, *(ignore or [])]
    files = files.withColumn("rel", relative).filter(paths.language(F.col("rel")).isNotNull() & ~paths.ignored(F.col("rel"), patterns))
    columns = [F.col("rel").alias("path"), F.sha2("content", 256).alias("sha"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.col("length").alias("size")]
    if not content:
        return files.select(columns[0], F.lit(None).cast("string").alias("sha"), *columns[2:])
    return files.select(*columns, F.decode("content", "UTF-8").alias("content"))


def parse(files: DataFrame) -> DataFrame:
    """One row per file with its nodes, imports, calls and routes: ``files`` has path, content, sha. Null contents parse as empty texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, sha in batch.itertuples(index=False):
                got = parse_file(path, text or "", sha or "")
                if got is None:
                    continue
                nodes = [_padded(x) for x in (got.module, *got.classes, *got.symbols)]
                rows.append((path, nodes, got.imports, got.calls, got.routes))
            yield pd.DataFrame(rows, columns=["path", "nodes", "imports", "calls", "routes"])

    return files.select("path", "content", "sha").mapInPandas(run, PARSED_SCHEMA)




def _padded(row: dict) -> dict:
    """A node row with every field of the parsed schema; what a level does not have is null."""
    return {k: row.get(k) for k in _FIELDS}


_FIELDS = re.findall(r"(\w+) (?:string|int|boolean|array<string>)", PARSED_SCHEMA.split("imports array<struct")[0].split("array<struct<", 1)[1])


def graph_of(parsed: DataFrame, aliases: DataFrame | None = None, go_modules: DataFrame | None = None) -> Graph:
    """The whole graph of parsed files (computed at once, not lazily): nodes, domains, resolved edges, routes. Nodes of one id: the last in the file stands."""
    rows = parsed.select(F.explode("nodes").alias("n")).select("n.*")
    rows = rows.withColumn("name", F.coalesce("name", "filename"))
    nodes = as_nodes(rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct(F.coalesce("line_start", F.lit(0)), F.coalesce("line_end", F.lit(0)))).alias("x")).select("id", "x.*"))
    files = nodes.filter("level = 'L1'").select("path", "domain")
    # each stage is read many times by those after it, so it is written once
    nodes = cut(nodes.unionByName(sync.domain_nodes(files)))
    files = nodes.filter("level = 'L1'").select("path", "domain")
    imports = resolve.resolve_imports(parsed.select(F.explode("imports").alias("i")).select("i.*"), files, aliases, go_modules)
    imports = cut(imports)
    symbols = nodes.filter("level = 'L3'")
    calls = resolve.resolve_calls(parsed.select(F.explode("calls").alias("c")).select("c.*"), symbols, imports)
    file_id = lambda c: F.concat(F.lit("file:"), c)
    contains = (files.select(F.concat(F.lit("domain:"), "domain").alias("src"), file_id(F.col("path")).alias("dst"))
                .unionByName(nodes.filter("level = 'L2'").select(file_id(F.col("file_path")).alias("src"), F.col("id").alias("dst")))
                .unionByName(symbols.select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))))
    edges = (as_edges(contains.withColumn("edge_type", F.lit(CONTAINS)))
             .unionByName(as_edges(imports.select(file_id(F.col("source_file")).alias("src"), file_id(F.col("target")).alias("dst"), F.lit(IMPORTS).alias("edge_type"), "imported_names", "spec")))
             .unionByName(as_edges(calls.withColumn("edge_type", F.lit(CALLS)))))
    found = parsed.select(F.explode("routes").alias("r")).select("r.*").dropDuplicates(["id"])
    graph = Graph(nodes, cut(as_edges(edges).dropDuplicates(["src", "edge_type", "dst"])))
    found = cut(found)
    if found.head(1):
        graph = routes.index_routes(graph, found)
        graph = Graph(cut(graph.nodes), cut(graph.edges))
    return graph.published()


def read_aliases(spark: SparkSession, root: str) -> DataFrame:
    """(prefix, target) of the path mappings of ``tsconfig.json`` or ``jsconfig.json`` at the top of a workspace."""
    rows, files = [], Files(spark, root)
    for name in ("tsconfig.json", "jsconfig.json"):
        text = files.read(name)
        if text is not None:
            try:
                options = json.loads(re.sub(r"^\s*//.*$", "", text, flags=re.M)).get("compilerOptions", {})
            except ValueError:
                continue
            base = options.get("baseUrl", ".").strip("./")
            for alias, targets in options.get("paths", {}).items():
                if targets:
                    to = re.sub(r"^\./", "", targets[0]).removesuffix("*")
                    rows.append((alias.removesuffix("*"), f"{base}/{to}" if base else to))
    return spark.createDataFrame(rows, "prefix string, target string")


def read_go_modules(spark: SparkSession, root: str) -> DataFrame:
    """(module, dir) of every ``go.mod`` of a workspace, found and read by the file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "go.mod").load(root)
    base = re.sub(r"/+$", "", root if "://" in root else os.path.abspath(root))
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(re.sub(r"^file:/*", "/", base)) + "/", "")
    named = files.select(F.regexp_extract(F.decode("content", "UTF-8"), r"(?m)^module\s+(\S+)", 1).alias("module"), F.regexp_replace(relative, "/?go\\.mod$", "").alias("dir"))
    return named.filter("module <> ''")


def git_head(root: str) -> str | None:
    """Commit a workspace is at, from its git folder: a detached head, a loose or a packed ref; null outside git."""
    git = Path(root) / ".git"
    if git.is_file() and (m := re.match(r"gitdir:\s*(.+)", git.read_text().strip())):
        git = (Path(root) / m.group(1)).resolve()
    head = git / "HEAD"
    if not head.is_file():
        return None
    text = head.read_text().strip()
    if not text.startswith("ref:"):
        return text or None
    ref = text[4:].strip()
    common = git / "commondir"
    for place in [git, *([(git / common.read_text().strip()).resolve()] if common.is_file() else [])]:
        if (place / ref).is_file():
            return (place / ref).read_text().strip()
        if (place / "packed-refs").is_file():
            for line in (place / "packed-refs").read_text().splitlines():
                if line.endswith(" " + ref):
                    return line.split()[0]
    return None


def git_diff(root: str, ref: str = "HEAD") -> str:
    """Unified diff without context of a workspace against a commit; without one, against the index; '' where git has none."""
    for args in (["diff", "-U0", ref or "HEAD"], ["diff", "-U0"]):
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
        if got.returncode == 0:
            return got.stdout
    return ""


NODE_SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in NODE_FIELDS.items())
_MANIFEST = sync.MANIFEST_SCHEMA + ", parsed_at string"
_MANIFEST_COLUMNS = [x.split()[0] for x in _MANIFEST.split(", ")]
#: Versions after which the graph is written whole again, and touched files up to which their paths are named to the file source.
COMPACT, NAMED_FILES = 8, 10_000
_PARTS = ("nodes", "edges", "dead_nodes", "dead_edges")


class Workspace:
    """A folder of source files with its stored graph and manifest below ``store``, on any file system.

    Layout: ``v/<n>/{parsed,manifest}`` with ``nodes`` and ``edges``, whole or (see :func:`stratograph.operators.sync.save_mode`) as changes to the
    versions before, and ``commits/<n>.json``, which puts a version in force. A commit is one file that must not exist yet; readers never see
    half a sync, and a sync that dies leaves only a folder that no commit names.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, ignore: list[str] | None = None):
        self.spark, self.root, self.files = spark, root, Files(spark, store)
        self.ignore = [*(ignore or []), *read_ignore_file(spark, root)]

    # ---- versions ------------------------------------------------------------------------------
    def _whole(self, state: dict) -> bool:
        """Whether every folder a commit stands on is complete."""
        wanted = [f"{state['at']}/manifest", *[f"{v}/parsed" for v in state["parsed"]], *[f"{v}/{x}" for v in state["graph"][:1] for x in ("nodes", "edges")], *[f"{v}/{x}" for v in state["graph"][1:] for x in _PARTS]]
        return all(self.files.exists(f"{x}/_SUCCESS") for x in wanted)

    def _state(self) -> dict | None:
        """The newest commit whose folders are whole; broken ones are set aside, so that the one before is in force again."""
        for name in reversed(self.files.names("commits")):
            try:
                state = json.loads(self.files.read(f"commits/{name}") or "")
                if not name.endswith(".json") or state.get("version") != sync.MANIFEST_VERSION:
                    continue
            except (ValueError, Py4JJavaError):  # cut short, or its checksum is wrong
                state = None
            if state is not None and self._whole(state):
                return state
            self.files.rename(f"commits/{name}", f"commits/{name}.broken")
        return None

    def version(self) -> str | None:
        """Name of the version in force."""
        state = self._state()
        return state["at"] if state else None

    def _load(self, state: dict) -> Graph:
        graph = load(self.spark, self.files.at(state["graph"][0]))
        for v in state["graph"][1:]:
            read = lambda part, schema: self.spark.read.schema(schema).parquet(self.files.at(f"{v}/{part}"))  # noqa: E731, B023
            key = ["src", "edge_type", "dst"]
            gone = read("dead_edges", "src string, edge_type string, dst string")
            edges = graph.edges.join(gone, key, "left_anti").select(*graph.edges.columns).unionByName(read("edges", EDGE_SCHEMA))
            nodes = graph.nodes.join(read("dead_nodes", "id string"), "id", "left_anti").select(*NODE_FIELDS).unionByName(read("nodes", NODE_SCHEMA).select(*NODE_FIELDS))
            graph = Graph(nodes, edges)
        return graph

    def _save(self, graph: Graph, state: dict | None, at: str, forced: bool) -> list[str]:
        """Write a graph whole or as changes; returns the versions it is read from."""
        if state is not None and not forced and len(state["graph"]) < COMPACT:
            old, key = self._load(state), ["src", "edge_type", "dst"]
            nodes = cut(old.changed_nodes(graph.nodes).select(*NODE_FIELDS))
            dead = cut(old.nodes.select("id").join(graph.nodes.select("id"), "id", "left_anti"))
            names = sorted(graph.edges.columns)
            edges = cut(graph.edges.select(*names).subtract(old.edges.select(*names)))
            dead_edges = cut(old.edges.select(*key).join(graph.edges.select(*key), key, "left_anti"))
            ops = sum(x.count() for x in (nodes, dead, edges, dead_edges))
            if sync.save_mode(ops, state["nodes"], state["edges"]) == "delta":
                # a changed row takes the place of the one before
                parts = {"nodes": nodes, "edges": edges, "dead_nodes": dead.unionByName(nodes.select("id")), "dead_edges": dead_edges.unionByName(edges.select(*key))}
                for name, part in parts.items():
                    part.coalesce(1).write.parquet(self.files.at(f"{at}/{name}"))  # at most max(2000, a quarter of the graph) rows
                return [*state["graph"], at]
        save(graph, self.files.at(at))
        return [at]

    # ---- sync ----------------------------------------------------------------------------------
    def sync(self, force: bool = False) -> dict:
        """Bring graph and manifest up to date and tell what was done.

        Files are listed first; only those whose time or size is not that of the manifest are read, and only added and modified ones
        parsed. Edges are resolved from all parsed rows, so the result equals a full rebuild. Without a change nothing is written. A missing or
        incomplete store, one of another format, or one that does not fit what was recorded about it is built anew.
        """
        return self._sync(force, None)

    def sync_file(self, path: str) -> dict:
        """:meth:`sync` for one file after an edit: nothing else is looked at. Without a store all files are synced."""
        return self._sync(False, [path.replace("\\", "/")])

    def _sync(self, force: bool, only: list[str] | None) -> dict:
        spark, state = self.spark, self._state()
        read = lambda at: spark.read.parquet(self.files.at(at))
        if state and not force:
            force = sync.drifted(self._load(state), read(f"{state['at']}/manifest"), state["nodes"], state["edges"])
        fresh = force or state is None
        old = spark.createDataFrame([], _MANIFEST) if fresh else read(f"{state['at']}/manifest")
        if fresh:
            listed = dirty = scan(spark, self.root, self.ignore)
        else:
            listed = scan(spark, self.root, self.ignore, content=False, only=only)
            mine = old if only is None else old.filter(F.col("path").isin(only))
            same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("path", "mtime", "size")]
            touched = [r["path"] for r in listed.alias("l").join(mine.alias("o"), same, "left_anti").select("path").limit(NAMED_FILES + 1).collect()]
            dirty = scan(spark, self.root, self.ignore, only=touched if len(touched) <= NAMED_FILES else None)
            # files that were not touched are as the manifest says; the others have been read
            seen = cut(dirty.select("path", "sha", "mtime", "size"))
            listed = listed.select("path").join(seen, "path", "left_anti").join(mine.select("path", "sha", "mtime", "size"), "path").select("path", "sha", "mtime", "size").unionByName(seen)
            old = mine
        changes = cut(sync.classify(listed, old))
        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        stats = {"added": counts.get("added", 0), "modified": counts.get("modified", 0), "deleted": counts.get("deleted", 0), "cached": counts.get("unchanged", 0), "git_commit": git_head(self.root)}
        if not fresh and not (stats["added"] or stats["modified"] or stats["deleted"]):
            return stats | {"nodes": state["nodes"], "edges": state["edges"], "version": state["at"]}
        taken = [int(x) for x in self.files.names("v") if x.isdigit()]
        at = f"v/{max(taken, default=0) + 1}"
        parse(dirty.join(changes.filter("change IN ('added', 'modified')"), "path", "left_semi")).write.parquet(self.files.at(f"{at}/parsed"))
        manifest = listed.select("path", "sha", "mtime", "size", paths.domain(F.col("path")).alias("domain")).join(changes, "path")
        parsed_in = [at]
        if fresh:
            manifest = manifest.select(*_MANIFEST_COLUMNS[:-1], F.lit(at).alias("parsed_at"))
        else:
            whole = read(f"{state['at']}/manifest")
            kept = whole.select("path", F.col("parsed_at").alias("_before"))
            manifest = manifest.join(kept, "path", "left").select(*_MANIFEST_COLUMNS[:-1], F.when(F.col("change") == "unchanged", F.col("_before")).otherwise(F.lit(at)).alias("parsed_at"))
            if only is not None:
                manifest = whole.filter(~F.col("path").isin(only)).unionByName(manifest)
            parsed_in = [*state["parsed"], at]
            if len(parsed_in) > COMPACT:  # versions no file was parsed in last are left out
                used = {r["parsed_at"] for r in manifest.select("parsed_at").distinct().collect()}  # at most as many as versions
                parsed_in = [v for v in parsed_in if v in used]
        manifest.write.parquet(self.files.at(f"{at}/manifest"))
        manifest = read(f"{at}/manifest")
        parsed = spark.read.schema(PARSED_SCHEMA).option("basePath", self.files.at("v")).parquet(*[self.files.at(f"{v}/parsed") for v in parsed_in])
        parsed = parsed.withColumn("parsed_at", F.concat(F.lit("v/"), F.regexp_extract(F.input_file_name(), "/v/([0-9]+)/parsed/", 1)))
        current = parsed.join(manifest.select("path", "parsed_at"), ["path", "parsed_at"], "left_semi").drop("parsed_at")
        graph = graph_of(current, read_aliases(spark, self.root), read_go_modules(spark, self.root))
        graph = sync.owned_only(graph, manifest)
        graph = Graph(cut(graph.nodes), cut(graph.edges))
        versions = self._save(graph, None if fresh else state, at, fresh)
        total = graph.counts().first()
        state = {"at": at, "version": sync.MANIFEST_VERSION, "graph": versions, "parsed": parsed_in, "nodes": total["total_nodes"], "edges": total["total_edges"], "git_commit": stats["git_commit"]}
        self.files.create(f"commits/{int(at[2:]):09d}.json", json.dumps(state))
        return stats | {"nodes": state["nodes"], "edges": state["edges"], "version": at}

    def clean(self) -> int:
        """Remove versions the one in force does not stand on, and their commits; returns how many."""
        state, gone = self._state(), 0
        keep = {state["at"], *state["graph"], *state["parsed"]} if state else set()
        for n in self.files.names("v"):
            if f"v/{n}" not in keep:
                gone += self.files.delete(f"v/{n}")
        for name in self.files.names("commits"):
            if not state or name != f"{int(state['at'][2:]):09d}.json":
                self.files.delete(f"commits/{name}")
        return gone

    def graph(self) -> Graph:
        """The graph in force; a workspace that was never synced is synced first."""
        if self._state() is None:
            self.sync()
        return self._load(self._state())

    def status(self) -> dict:
        state = self._state()
        return {"indexed": state is not None, **(state or {}), "files": scan(self.spark, self.root, self.ignore, content=False).count()}


def save(graph: Graph, at: str) -> None:
    """Write a graph as Parquet, nodes by level and edges by type. Edges that lack an end are left out by :meth:`Graph.published`, not here."""
    graph.nodes.write.mode("overwrite").partitionBy("level").parquet(f"{at}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{at}/edges")


def load(spark: SparkSession, at: str) -> Graph:
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{at}/nodes").select(*NODE_FIELDS)
    return Graph(nodes, spark.read.schema(EDGE_SCHEMA).parquet(f"{at}/edges"))


def load_json(spark: SparkSession, path: str) -> Graph:
    """A graph from documents ``{"nodes": [{id, labels, properties}], "edges": [{source_id, target_id, edge_type, properties}]}``."""
    kinds = ", ".join(f"{n} {k}" for n, (k, _) in NODE_FIELDS.items() if n not in ("id", "labels"))
    schema = f"nodes array<struct<id string, labels array<string>, properties struct<{kinds}>>>, edges array<struct<source_id string, target_id string, edge_type string, properties struct<imported_names array<string>, spec string>>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.id", "n.labels", "n.properties.*")
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.source_id").alias("src"), F.col("e.target_id").alias("dst"), F.col("e.edge_type").alias("edge_type"), "e.properties.*")
    return Graph.of(nodes, edges)


def save_json(graph: Graph, path: str) -> None:
    """Write nodes and edges as JSON lines below ``path``, edges without an end included."""
    props = [c for c in NODE_FIELDS if c not in ("id", "labels")]
    graph.nodes.select("id", "labels", F.struct(*props).alias("properties")).write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "edge_type", F.struct("imported_names", "spec").alias("properties")).write.mode("overwrite").json(f"{path}/edges")
