"""Drill-down: domains, one module, one symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratograph.graph import CALLS, CONTAINS, IMPORTS, Graph

SUMMARY_ABOVE, SAMPLE, MODULES, EXPORTS = 50, 5, 50, 8


def first_line(text: Column, chars: int) -> Column:
    line = F.get(F.split(F.trim(text), "\n"), F.lit(0))
    return F.when(F.length(line) > chars, F.concat(F.substring(line, 1, chars), F.lit("..."))).otherwise(line)


def overview_domains(graph: Graph) -> DataFrame:
    """One row per domain: id, name, description, layer, total_modules (counted, not as stored)."""
    counted = graph.of_type(CONTAINS).filter(F.startswith("src", F.lit("domain:"))).groupBy("src").agg(F.count("*").alias("total_modules"))
    domains = graph.nodes.filter("level = 'L0'").select("id", "name", "description", "layer")
    return domains.join(counted, F.col("id") == F.col("src"), "left").select(F.col("id").alias("domain_id"), "name", "description", "layer", F.coalesce("total_modules", F.lit(0)).alias("total_modules"))


def overview_modules(graph: Graph, domain: str = "", summary: bool | None = None) -> DataFrame:
    """The first modules of each domain by path.

    In summary mode (asked for, or by default without a domain when there are more than 50 modules) five
    per domain with path, language and loc; else up to fifty, with exports and the first line of
    their docstring. Whether the graph is that large is decided inside the plan.
    """
    modules = graph.nodes.filter("level = 'L1'")
    if domain:
        modules = modules.filter(F.col("domain") == domain)
    # the rank within a domain needs no sorted whole domain: a bounded number of best rows per task is kept first
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("path", "id"))
    rows = modules.select("domain", "id", "path", "language", "loc", F.array_join(F.slice("exports", 1, EXPORTS), ",").alias("exports"), first_line(F.col("docstring"), 120).alias("docstring"))
    ranked = rows.withColumn("rank", rank).filter(F.col("rank") <= MODULES)
    if summary is None and domain:
        summary = False
    if summary is None:
        many = graph.nodes.agg((F.count_if(F.col("level") == "L1") > SUMMARY_ABOVE).alias("_many"))
        ranked = ranked.join(F.broadcast(many))  # one row
        short = F.col("_many")
    else:
        short = F.lit(summary)
    shown = ranked.filter(~short | (F.col("rank") <= SAMPLE))
    return shown.select("domain", "rank", "id", "path", "language", "loc", F.when(short, F.lit("")).otherwise(F.col("exports")).alias("exports"), F.when(short, F.lit("")).otherwise(F.col("docstring")).alias("docstring"), short.alias("summary_mode"))


def module_members(graph: Graph, files: DataFrame) -> DataFrame:
    """Classes and direct functions of modules: ``files`` has id. Bodies are not among the columns."""
    inside = graph.of_type(CONTAINS).join(files.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    rows = inside.join(graph.nodes.filter("level IN ('L2', 'L3')"), F.col("dst") == F.col("id"))
    lines = F.when(F.col("line_start") > 0, F.concat(F.col("line_start"), F.lit("-"), F.col("line_end"))).otherwise(F.lit("0-0"))
    return rows.select(F.col("src").alias("file_id"), "id", "level", "name", "kind", F.array_join("bases", ",").alias("bases"), "signature", lines.alias("lines"), first_line(F.col("docstring"), 150).alias("docstring"), "is_public",
                       "cyclomatic_complexity", F.size("method_signatures").alias("methods"), F.size("field_signatures").alias("fields"))


def module_links(graph: Graph, files: DataFrame) -> DataFrame:
    """(file_id, direction, other): what modules import and what imports them."""
    ids = files.select(F.col("id").alias("file_id")).distinct()
    imports = graph.of_type(IMPORTS)
    out = imports.join(ids, F.col("src") == F.col("file_id")).select("file_id", F.lit("imports").alias("direction"), F.col("dst").alias("other"))
    return out.unionByName(imports.join(ids, F.col("dst") == F.col("file_id")).select("file_id", F.lit("imported_by").alias("direction"), F.col("src").alias("other")))


def module_card(graph: Graph, files: DataFrame) -> DataFrame:
    """One row per module: its own columns, its numbers of members, and lists of neighbours."""
    ids = files.select("id").distinct()
    members = module_members(graph, ids).groupBy("file_id").agg(F.count_if(F.col("level") == "L2").alias("classes"), F.count_if(F.col("level") == "L3").alias("functions"))
    links = module_links(graph, ids).groupBy("file_id").agg(F.count_if(F.col("direction") == "imports").alias("dependencies"), F.count_if(F.col("direction") == "imported_by").alias("dependents"))
    rows = graph.nodes.join(ids, "id", "left_semi").join(members, F.col("id") == F.col("file_id"), "left").drop("file_id").join(links, F.col("id") == F.col("file_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", "path", "language", "loc", F.when(F.col("layer") == "", "general").otherwise(F.col("layer")).alias("layer"), first_line(F.col("docstring"), 150).alias("docstring"), F.array_join("exports", ",").alias("exports"), *[zero(c) for c in ("classes", "functions", "dependencies", "dependents")])


def find_symbol(graph: Graph, name: str, file: str = "") -> DataFrame:
    """The symbol meant by a name: exact id, else ``symbol:file:name``, else the smallest id of that full or short name (in the file)."""
    symbols = graph.nodes.filter("level = 'L3'")
    rank = F.when(F.col("id") == name, 0)
    if file:
        rank = rank.when(F.col("id") == f"symbol:{file}:{name}", 1)
    called = (F.col("name") == name) | F.endswith(F.col("name"), F.lit("." + name))
    rank = rank.when(called & ((F.col("file_path") == file) if file else F.lit(True)), 2)
    return symbols.withColumn("_rank", rank).filter("_rank IS NOT NULL").orderBy("_rank", "id").limit(1).drop("_rank")


def symbol_card(graph: Graph, symbol: DataFrame) -> DataFrame:
    """One row per symbol of ``symbol``: its code, the names it calls, and which symbols it reaches and is reached by."""
    ids = symbol.select("id").distinct()
    calls = graph.of_type(CALLS)
    out = calls.join(ids, F.col("src") == F.col("id"), "left_semi").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("resolved_outgoing_calls"))
    into = calls.join(ids, F.col("dst") == F.col("id"), "left_semi").groupBy("dst").agg(F.count("*").alias("callers"))  # a hub has any number of them: they are counted here and listed by symbol_callers
    rows = graph.nodes.join(ids, "id", "left_semi").join(out, F.col("id") == F.col("src"), "left").join(into, F.col("id") == F.col("dst"), "left")
    return rows.select("id", "name", "file_path", "kind", F.concat("line_start", F.lit("-"), "line_end").alias("lines"), "signature", "docstring", "is_public", "cyclomatic_complexity",
                       F.array_join("calls", ",").alias("calls"), F.coalesce("resolved_outgoing_calls", F.lit("")).alias("resolved_outgoing_calls"), F.coalesce("callers", F.lit(0)).alias("callers"), "code")


def symbol_callers(graph: Graph, symbol: DataFrame) -> DataFrame:
    ids = symbol.select(F.col("id").alias("dst")).distinct()
    return graph.of_type(CALLS).join(ids, "dst", "left_semi").select("dst", F.col("src").alias("caller"))
