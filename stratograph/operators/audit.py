"""Architecture audit: layer rules, coupling, strongly connected components, simple cycles."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratograph.graph import IMPORTS, Graph
from stratograph.session import cut

# ---- fixed values -----------------------------------------------------------------------------
DEFAULT_RULES = [
    {"from_layer": "repository", "forbidden_to": ["service", "controller"], "reason": "Repository layer cannot depend on Service or Controller layer"},
    {"from_layer": "service", "forbidden_to": ["controller"], "reason": "Service layer cannot depend on Controller layer"},
    {"from_layer": "domain", "forbidden_to": ["infrastructure", "presentation", "application"], "reason": "Clean Architecture: Domain must be isolated from outer layers"},
]
MAX_CYCLES, TOP_COUPLED = 10, 20
#: Edges up to which components are found in one task.
ONE_TASK_EDGES = 200_000


def load_rules(path: str | None = None) -> dict:
    """Rules from a JSON file over the defaults; an absent or broken file leaves the defaults, ``allow_cycles`` is what the file says or false."""
    out = {"rules": DEFAULT_RULES, "allow_cycles": False}
    if path and Path(path).is_file():
        try:
            given = json.loads(Path(path).read_text())
        except ValueError:
            return out
        out |= {k: v for k, v in given.items() if v}
        out["allow_cycles"] = bool(given.get("allow_cycles", False))
    return out


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """(src_layer, dst_layer, reason): one row per forbidden pair."""
    rows = [(r["from_layer"], to, r.get("reason", "")) for r in rules for to in r["forbidden_to"]]
    return spark.createDataFrame(rows, "src_layer string, dst_layer string, reason string")


def layer_of(layer: Column) -> Column:
    return F.when(F.coalesce(layer, F.lit("")) == "", F.lit("general")).otherwise(layer)


def module_edges(graph: Graph) -> DataFrame:
    """(src, dst) of IMPORTS between modules that exist, as ids."""
    ids = graph.nodes.filter("level = 'L1'").select("id")
    e = graph.of_type(IMPORTS).select("src", "dst").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def layer_violations(graph: Graph, rules: list[dict] | None = None, layer: Column | None = None, only: str | None = None) -> DataFrame:
    """Imports against the rules, one row per matching rule. ``only``: path of the one module to look at as importer."""
    layer = F.col("layer") if layer is None else layer
    modules = graph.nodes.filter("level = 'L1'").select("id", "path", layer_of(layer).alias("layer"))
    e = module_edges(graph)
    src, dst = modules.select(F.col("id").alias("src"), F.col("path").alias("source_file"), F.col("layer").alias("source_layer")), modules.select(F.col("id").alias("dst"), F.col("path").alias("target_file"), F.col("layer").alias("target_layer"))
    if only is not None:
        src = src.filter(F.col("source_file") == only)
    rows = e.join(src, "src").join(dst, "dst").filter("source_layer <> target_layer")
    forbidden = F.broadcast(rules_frame(graph.nodes.sparkSession, DEFAULT_RULES if rules is None else rules))  # a few lines of configuration
    return rows.join(forbidden, (F.col("source_layer") == F.col("src_layer")) & (F.col("target_layer") == F.col("dst_layer"))).select("source_file", "source_layer", "target_file", "target_layer", "reason")


def coupling(graph: Graph) -> DataFrame:
    """Per module: Ca (modules that import it), Ce (modules it imports), instability and how to read it."""
    e = module_edges(graph)
    both = e.select(F.col("dst").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("e")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("e")))
    counted = both.groupBy("id").agg(F.sum("a").alias("ca"), F.sum("e").alias("ce"))
    rows = graph.nodes.filter("level = 'L1'").select("id", "path").join(counted, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ca", "ce")})
    instability = F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 3)).otherwise(F.lit(0.0))
    rows = rows.withColumn("instability", instability)
    return rows.select("path", "ca", "ce", "instability", F.when(F.col("instability") > 0.7, "instable").when(F.col("instability") >= 0.3, "balanced").otherwise("stable").alias("assessment"))


def most_coupled(graph: Graph, limit: int = TOP_COUPLED) -> DataFrame:
    return coupling(graph).orderBy(F.desc(F.col("ca") + F.col("ce")), "path").limit(limit)


def strong_components(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Node -> smallest member of its component, for components of more than one node: depth-first search without recursion."""
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order, low, on, stack, found = {}, {}, set(), [], {}
    for root in sorted(out):
        if root in order:
            continue
        work = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = stack[stack.index(v):] if len(stack) < 64 else stack[len(stack) - 1 - stack[::-1].index(v):]
                    del stack[len(stack) - len(members):]
                    on.difference_update(members)
                    if len(members) > 1:
                        found.update(dict.fromkeys(members, min(members)))
            elif w not in order:
                order[w] = low[w] = len(order)
                stack.append(w)
                on.add(w)
                work.append((w, iter(out[w])))
            elif w in on:
                low[v] = min(low[v], order[w])
    return found


def components(edges: DataFrame, in_one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component) of nodes on cycles: strongly connected components of more than one node, named by their smallest member.

    Nodes without an edge in or out among those left are trimmed, round by round; the rest is coloured:
    each node takes the smallest id that reaches it, and what reaches that id backwards within its
    colour is one component. Components found leave and the loop goes on. Every round is a join of
    fixed-size rows; the lineage is cut each time. Up to ``in_one_task`` edges, which are counted first, one
    task finds the same components by a depth-first search.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    if e.limit(in_one_task + 1).count() <= in_one_task:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(list(strong_components(list(frame[["src", "dst"]].itertuples(index=False, name=None))).items()), columns=["id", "component"])

        return e.groupBy(F.lit(1).alias("one")).applyInPandas(lambda f: run(f), "id string, component string")
    done = None
    while True:
        before = -1
        while True:  # trim
            n = e.count()
            if n == before or n == 0:
                break
            before = n
            ins, outs = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
            e = cut(e.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        if n == 0:
            break
        colour = cut(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct().withColumn("c", F.col("id")))
        while True:
            push = e.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("c").alias("m"))
            new = cut(colour.join(push, F.col("id") == F.col("dst"), "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            colour = new.select("id", "c")
            if not new.filter("moved").head(1):
                break
        inside = e.join(colour.withColumnRenamed("id", "src").withColumnRenamed("c", "a"), "src").join(colour.withColumnRenamed("id", "dst").withColumnRenamed("c", "b"), "dst").filter("a = b").select("src", "dst", "a")
        inside = cut(inside)
        reached = colour.filter("id = c")
        while True:
            step = inside.join(reached, (F.col("dst") == F.col("id")) & (F.col("a") == F.col("c"))).select(F.col("src").alias("id"), F.col("a").alias("c")).distinct().join(reached, ["id", "c"], "left_anti")
            step = cut(step)
            if not step.head(1):
                break
            reached = cut(reached.unionByName(step))
        found = reached.select("id", F.col("c").alias("component"))
        done = found if done is None else done.unionByName(found)
        done = cut(done)
        e = cut(e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return edges.sparkSession.createDataFrame([], "id string, component string")
    size = F.count("*").over(Window.partitionBy("component"))
    return done.withColumn("_n", size).filter("_n > 1").select("id", "component")


def simple_cycles(edges: DataFrame, max_length: int = 0, limit: int = MAX_CYCLES, through: str | None = None) -> DataFrame:
    """(cycle_length, chain): simple cycles of any length, each once, from its smallest member on.

    Only edges within one strongly connected component take part. Paths grow by one join a step from their smallest node, only through
    larger ones that still can get back to it, so cycles come out by length. The first ``limit`` by length and chain are
    reported, 0 for all; once so many are found, longer ones are not looked for. ``max_length``: nodes of the longest cycle wanted, 0
    for no bound. ``through`` then keeps those with that node, after the cap.
    """
    comp = components(edges)
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    e = cut(e.join(comp.withColumnRenamed("id", "src").withColumnRenamed("component", "a"), "src").join(comp.withColumnRenamed("id", "dst").withColumnRenamed("component", "b"), "dst").filter("a = b").select("src", "dst"))
    paths = cut(e.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path")))
    back, step = e.select(F.col("src").alias("at"), F.col("dst").alias("start")), e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    found, number, length = None, 0, 2
    while True:
        closed = paths.join(back, ["at", "start"], "left_semi").select(F.lit(length).alias("cycle_length"), F.array_join(F.concat("path", F.array("start")), " -> ").alias("chain"))
        closed = cut(closed)
        found = closed if found is None else found.unionByName(closed)
        number += closed.count()
        if limit and number >= limit or length == max_length:
            break
        paths = cut(paths.join(step, "at").filter((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path")))
        length += 1
        if not paths.head(1):
            break
    if limit:
        found = found.orderBy("cycle_length", "chain").limit(limit)
    return found.filter(F.array_contains(F.split("chain", " -> "), through)) if through else found


def normalized_path(path: str, root: str = "") -> str:
    """A path as modules are named: forward slashes, relative to ``root`` where it lies below it, without ``./`` and a trailing slash."""
    clean = path.replace("\\", "/")
    if root:
        base = root.replace("\\", "/").rstrip("/")
        clean = clean[len(base):] if clean == base or clean.startswith(base + "/") else clean
        clean = clean.lstrip("/") if path.replace("\\", "/").startswith(base) else clean
    parts: list[str] = []
    for part in clean.split("/"):
        if part == ".." and parts:
            parts.pop()
        elif part not in ("", ".", ".."):
            parts.append(part)
    return "/".join(parts)


def verdict(graph: Graph, rules: list[dict] | None = None, allow_cycles: bool = False, layer: Column | None = None) -> DataFrame:
    """One row: PASSED or FAILED, violations, modules on cycles, modules looked at."""
    out = layer_violations(graph, rules, layer).agg(F.count("*").alias("total_violations"))
    tangled = graph.nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("modules_on_cycles")) if allow_cycles else components(module_edges(graph)).agg(F.count("*").alias("modules_on_cycles"))
    audited = graph.nodes.filter("level = 'L1'").agg(F.count("*").alias("total_modules_audited"))
    row = out.join(F.broadcast(tangled)).join(F.broadcast(audited))  # one row each
    return row.withColumn("status", F.when((F.col("total_violations") == 0) & (F.col("modules_on_cycles") == 0), "PASSED").otherwise("FAILED"))
