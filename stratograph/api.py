"""One object with all queries of a graph, for notebooks and services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratograph.graph import Graph
from stratograph.operators import audit, community, impact, query, records, routes, search, traverse, zoom
from stratograph.session import cut
from stratograph.sources.workspace import Workspace, git_diff


class Engine:
    """Queries over a graph, or over a workspace that is synced when first asked.

    Methods that answer with one kind of row return a DataFrame; those that answer with several return a
    dict of DataFrames.
    """

    def __init__(self, spark: SparkSession, graph: Graph | None = None, workspace: Workspace | None = None, adrs: DataFrame | None = None):
        if graph is None and workspace is None:
            raise ValueError("a graph or a workspace is needed")
        self.spark, self.workspace, self._graph, self._given, self._version = spark, workspace, graph, graph is not None, None
        self.adrs = records.empty(spark) if adrs is None else adrs

    @property
    def graph(self) -> Graph:
        """The graph given, or that of the workspace: read anew when another sync has put a newer version in force."""
        if not self._given and (self._graph is None or self.workspace.version() != self._version):
            self._graph = self.workspace.graph()
            self._version = self.workspace.version()
        return self._graph

    # ---- upkeep --------------------------------------------------------------------------------
    def sync_index(self, force: bool = False) -> dict:
        if self.workspace is None:
            raise ValueError("a graph without a workspace has nothing to sync with")
        stats = self.workspace.sync(force)
        self._graph, self._given = None, False
        return stats

    def get_index_status(self) -> dict:
        return self.graph.counts().first().asDict() | ({"files": self.workspace.status()["files"]} if self.workspace else {})

    # ---- drill-down and search -----------------------------------------------------------------
    def zoom_overview(self, domain: str = "") -> dict[str, DataFrame]:
        domains = zoom.overview_domains(self.graph)
        return {"domains": domains.filter(F.col("name") == domain) if domain else domains, "modules": zoom.overview_modules(self.graph, domain), "stats": self.graph.counts()}

    def zoom_module(self, path: str) -> dict[str, DataFrame]:
        """By path or id; all parts are empty if there is no such module."""
        file = self.graph.nodes.filter("level = 'L1'").filter((F.col("path") == path) | (F.col("id") == path)).select("id")
        return {"file": zoom.module_card(self.graph, file), "members": zoom.module_members(self.graph, file), "links": zoom.module_links(self.graph, file)}

    def zoom_symbol(self, name: str, file: str = "") -> dict[str, DataFrame]:
        found = cut(zoom.find_symbol(self.graph, name, file).select("id"))
        return {"symbol": zoom.symbol_card(self.graph, found), "callers": zoom.symbol_callers(self.graph, found)}

    def zoom_search(self, question: str, level: str = "", limit: int = 15) -> DataFrame:
        return search.search(self.graph, question, level, limit)

    def query_graph(self, **filters) -> DataFrame:
        """Filters of :class:`stratograph.operators.query.NodeQuery`."""
        return query.query(self.graph, query.NodeQuery(**filters))

    # ---- architecture --------------------------------------------------------------------------
    def check_layer_violation(self, file: str = "", rules: list[dict] | None = None, rules_file: str | None = None, max_cycle: int = 0) -> dict[str, DataFrame]:
        """Rules given here go before those of a file, those before the defaults. Scoped to a file: its imports, its cycles, its coupling."""
        loaded = audit.load_rules(rules_file)
        file = audit.normalized_path(file.removeprefix("file:"), self.workspace.root if self.workspace else "") if file else ""
        used = rules or loaded["rules"]
        coupled = audit.coupling(self.graph).filter(F.col("path") == file) if file else audit.most_coupled(self.graph)
        out = {"violations": audit.layer_violations(self.graph, used, only=file or None), "coupling": coupled, "verdict": audit.verdict(self.graph, used, loaded["allow_cycles"])}
        if not loaded["allow_cycles"]:
            out["cycles"] = audit.simple_cycles(audit.module_edges(self.graph), max_cycle, through=f"file:{file}" if file else None)
        return out

    def estimate_blast_radius(self, target: str, change: str = "signature", max_hops: int = traverse.MAX_HOPS) -> dict[str, DataFrame]:
        goals = cut(traverse.resolve_target(self.graph, target))
        radius = cut(traverse.blast_radius(self.graph, goals, change, max_hops))
        return {"top": traverse.top_impact(radius), "all": radius, "summary": traverse.blast_summary(radius), "truncated": traverse.truncated(radius, traverse.NODE_CAP, goals.count())}

    def trace_metrics(self, source: str, target: str = "", direction: str = "outbound", max_depth: int = traverse.TREE_DEPTH) -> DataFrame:
        """Size, depth, ends and paths of what :meth:`trace_call_path` gives, and whether a cap ended it."""
        tree = cut(self.trace_call_path(source, "", direction, max_depth))
        return traverse.trace_metrics(tree, cut(self.trace_call_path(source, target, direction, max_depth)) if target else None)

    def trace_call_path(self, source: str, target: str = "", direction: str = "outbound", max_depth: int = traverse.TREE_DEPTH) -> DataFrame:
        """The call tree of a source, or all simple paths from it to a target."""
        start = cut(traverse.resolve_target(self.graph, source, through_classes=True))
        if not target:
            return traverse.call_tree(self.graph, start, direction, max_depth)
        return traverse.call_paths(self.graph, start, cut(traverse.resolve_target(self.graph, target, through_classes=True)), direction, max_depth)

    def detect_changes(self, base_ref: str = "", scope: str = "", max_hops: int = 0, raw_diff: str = "") -> dict[str, DataFrame]:
        """Impact of a diff, by default of the working tree against a commit."""
        text = raw_diff or (git_diff(self.workspace.root, base_ref) if self.workspace else "")
        spans = impact.diff_spans(self.spark.createDataFrame([("diff", text)], "diff_id string, text string"))
        changed = cut(impact.changed_symbols(self.graph, spans))
        hit = cut(impact.affected(self.graph, changed, max_hops))
        shown = {"tests": hit.filter("is_test"), "symbols": hit.filter("NOT is_test")}.get(scope, hit)
        return {"spans": spans, "changed": changed, "affected": shown, "summary": impact.change_summary(changed, hit)}

    def list_routes(self, path_pattern: str = "", method: str = "") -> DataFrame:
        return routes.list_routes(self.graph, path_pattern, method)

    def detect_communities(self, min_size: int = 2) -> dict[str, DataFrame]:
        weights = cut(community.module_weights(self.graph))
        labelled = cut(community.communities(self.graph, weights))
        return {"communities": community.community_report(self.graph, labelled, weights, min_size), "members": labelled, "drift": community.drift_alerts(self.graph, labelled, weights), "score": community.coupling_score(weights, labelled)}

    # ---- decision records ----------------------------------------------------------------------
    def manage_adr(self, action: str, key: str = "", **fields) -> DataFrame:
        """list, get, create, update or delete; the last three change :attr:`adrs` and return it."""
        if action == "list":
            return records.listed(self.adrs, fields.get("status", ""), fields.get("tag", ""))
        if action == "get":
            return records.one(self.adrs, key)
        change = {"create": lambda: records.created(self.adrs, **fields), "update": lambda: records.updated(self.adrs, key, **fields), "delete": lambda: records.deleted(self.adrs, key)}
        if action not in change:
            raise ValueError(f"unknown action {action!r}")
        self.adrs = cut(change[action]())
        return self.adrs
