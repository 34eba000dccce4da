"""Communities of modules by how strongly they are coupled."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratograph.functions.paths import base_name
from stratograph.graph import CALLS, IMPORTS, Graph, short_name
from stratograph.operators import resolve
from stratograph.operators.rank import with_rank
from stratograph.session import cut, stored

SWEEPS, EPSILON = 20, 1e-12
#: Rounds after which moving by halves ends even if nodes still move; two of them are one sweep.
ROUNDS = 2 * SWEEPS
#: Weighted pairs up to which one task goes through the rounds; beyond it they are joins. The rule and its result are the same.
ONE_TASK_PAIRS = 200_000
#: Nodes, as rows of numbers, up to which the communities of all of them are broadcast in a round; beyond, the same joins are shuffled.
BROADCAST_NODES = 500_000
#: Columns of nodes from which :func:`table_weights` works.
COUPLED = ["id", "level", "name", "path", "file_path", "domain", "import_paths", "parent_id", "calls"]
#: Bits of the number a symbol has within its file; the bits above are the number of the file.
FILE_BITS = 32
#: Words of paths that name nothing.
STOP_WORDS = ["src", "go", "py", "ts", "js", "main", "util", "test"]


def module_weights(graph: Graph) -> DataFrame:
    """(a, b, w), a < b: undirected weights between module paths: 2 per import, 1 per pair of symbols that call across files."""
    modules = graph.nodes.filter("level = 'L1' AND path <> ''").select("id", "path")
    symbols = graph.nodes.filter("level = 'L3'").select("id", F.col("file_path").alias("path")).join(modules.select("path").distinct(), "path", "left_semi").select("id", "path")
    def pairs(edges: DataFrame, of: DataFrame, weight: float) -> DataFrame:
        src, dst = of.select(F.col("id").alias("src"), F.col("path").alias("p")), of.select(F.col("id").alias("dst"), F.col("path").alias("q"))
        return edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst").filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(weight).alias("w"))
    return pairs(graph.of_type(IMPORTS), modules, 2.0).unionByName(pairs(graph.of_type(CALLS), symbols, 1.0)).groupBy("a", "b").agg(F.sum("w").alias("w"))


def table_weights(nodes: DataFrame) -> DataFrame:
    """:func:`module_weights` of table nodes, resolved from the nodes themselves.

    Calls are resolved over numbers: a symbol is its file's number and its own within the file in one long, so the shuffled rows
    are short and the files of a call are read from its ends.
    """
    modules = nodes.filter("level = 'L1'").select("id", "path", "import_paths", "level")
    symbols = nodes.filter("level = 'L3'").select("id", "name", "file_path", "parent_id", "calls")
    files = stored(with_rank(modules.select("path").unionByName(symbols.select(F.col("file_path").alias("path"))).distinct(), "n", F.col("path")))
    number = lambda c, n: files.select(F.col("path").alias(c), F.col("n").alias(n))
    in_file = Window.partitionBy("file_path")
    coded = symbols.join(number("file_path", "f"), "file_path").withColumns({"_i": F.row_number().over(in_file.orderBy("id")), "_c": F.dense_rank().over(in_file.orderBy("parent_id"))})
    parent = F.when(F.startswith("parent_id", F.lit("class:")), F.concat(F.lit("class:"), "_c"))
    coded = stored(coded.select((F.shiftleft("f", FILE_BITS) + F.col("_i")).alias("id"), short_name(F.col("name")).alias("name"), F.col("f").alias("file_path"), parent.alias("parent_id"), "calls"))
    imports = stored(resolve.table_imports(modules).select("source_file", "target"))
    coded_imports = imports.join(number("source_file", "s"), "source_file").join(number("target", "t"), "target").select(F.col("s").alias("source_file"), F.col("t").alias("target"))
    calls = resolve.resolve_calls(coded.select(F.col("id").alias("caller_id"), F.explode("calls").alias("called_name")), coded, coded_imports)
    file_of = lambda c: F.shiftright(c, FILE_BITS)
    across = calls.select(F.least(file_of("src"), file_of("dst")).alias("i"), F.greatest(file_of("src"), file_of("dst")).alias("j")).filter("i <> j").groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))
    known = stored(modules.select("path").filter("path <> ''").distinct().join(files, "path"))
    back = lambda n, p: known.select(F.col("n").alias(n), F.col("path").alias(p))
    called = across.join(back("i", "p"), "i").join(back("j", "q"), "j").select("p", "q", "w")
    file = lambda c, p: modules.filter("path <> ''").select(F.expr("substring(id, 6)").alias(c), F.col("path").alias(p), "id").filter("startswith(id, 'file:')").drop("id")
    imported = imports.join(file("source_file", "p"), "source_file").join(file("target", "q"), "target").filter("p <> q").select("p", "q", F.lit(2.0).alias("w"))
    return called.unionByName(imported).groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("w").alias("w"))


def local_moving(pairs: list[tuple[str, str, float]], nodes: list[str] | None = None, sweeps: int = SWEEPS) -> dict[str, str]:
    """First phase of modularity optimisation: nodes in order of name move to the community of largest gain, until none does.

    Gain of a community: weight to it / 2m - total degree of it * own degree / (2m)^2; a node stays unless
    another is larger by more than 1e-12, and of equal ones the first in order is taken. A community is
    named by the node it began with.
    """
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    order = sorted(set(nodes or []) | set(near))
    degree = {v: sum(near[v].values()) for v in order}
    twice = sum(degree.values())
    home = {v: v for v in order}
    if twice <= 0:
        return home
    total = dict(degree)
    for _ in range(sweeps):
        moved = False
        for v in order:
            links: dict[str, float] = defaultdict(float)
            for u, w in near[v].items():
                links[home[u]] += w
            own = home[v]
            total[own] -= degree[v]
            gain = lambda c: links.get(c, 0.0) / twice - total[c] * degree[v] / twice**2  # noqa: E731, B023
            best, most = own, gain(own)
            for c in sorted(links):
                if (g := gain(c)) > most + EPSILON:
                    best, most = c, g
            home[v] = best
            total[best] += degree[v]
            moved |= best != own
        if not moved:
            break
    return home


def communities(graph: Graph, weights: DataFrame | None = None, method: str = "halves", one_task_pairs: int = ONE_TASK_PAIRS) -> DataFrame:
    """(path, community) of every module.

    ``halves`` (the default, one rule at every size): in each round the nodes of one hash half look at the current communities and all
    move at once to that of largest gain, as in :func:`moved_by_halves`, until no node of either half moves, or for ``ROUNDS`` rounds. Up to
    ``one_task_pairs`` weighted pairs, which are counted first, one task computes this; beyond, joins of fixed-size rows do. ``sequential``:
    :func:`local_moving`, one node after the other by name, which is one task by its nature.
    """
    if method not in ("halves", "sequential"):
        raise ValueError(f"unknown method {method!r}")
    weights = cut(module_weights(graph)) if weights is None else weights
    modules = graph.nodes.filter("level = 'L1' AND path <> ''").select("path").distinct()
    if method == "sequential" or weights.limit(one_task_pairs + 1).count() <= one_task_pairs:
        rounds = ROUNDS
        move = (lambda rows: moved_by_halves(rows, rounds)) if method == "halves" else (lambda rows: local_moving([r[:3] for r in rows]))
        hashed = weights.select("a", "b", "w", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            home = move(list(frame[["a", "b", "w", "ha", "hb"]].itertuples(index=False, name=None)))
            return pd.DataFrame(list(home.items()), columns=["path", "community"])

        labelled = hashed.groupBy(F.lit(1).alias("one")).applyInPandas(lambda f: run(f), "path string, community string")
    else:
        labelled = _by_halves(weights)
    return cut(modules.join(labelled, "path", "left").select("path", F.coalesce("community", "path").alias("community")))


def moved_by_halves(rows: list[tuple[str, str, float, int, int]], rounds: int = ROUNDS) -> dict[str, str]:
    """Communities of nodes given by weighted pairs and the hashes of both ends: the rule of :func:`communities`, in memory.

    The gain of a community is weight to it times 2m minus its degree (without the node) times the node's, which is exact
    for whole weights; a node stays if no other is larger, and of equal ones that of the smallest hash is taken.
    """
    near: dict[str, dict[str, float]] = defaultdict(dict)
    hashes: dict[str, int] = {}
    for a, b, w, ha, hb in rows:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
        hashes[a], hashes[b] = ha, hb
    degree = {v: sum(x.values()) for v, x in near.items()}
    twice, home, still = sum(degree.values()), {v: v for v in near}, 0
    for r in range(rounds):
        total: dict[str, float] = defaultdict(float)
        for v, c in home.items():
            total[c] += degree[v]
        moves = {}
        for v, links in near.items():
            if hashes[v] % 2 != r % 2:
                continue
            to: dict[str, float] = {home[v]: 0.0}
            for u, w in links.items():
                to[home[u]] = to.get(home[u], 0.0) + w
            own = home[v]
            best = max(to, key=lambda c: (to[c] * twice - (total[c] - (degree[v] if c == own else 0.0)) * degree[v], c == own, -hashes[c]))  # noqa: B023
            if best != own:
                moves[v] = best
        home |= moves
        still = 0 if moves else still + 1
        if still == 2:
            break
    return home


def _by_halves(weights: DataFrame) -> DataFrame:
    """:func:`moved_by_halves` by joins of numbers.

    Nodes are numbered by hash, then path, so that the smallest hash is the smallest number. Every node has a link of weight 0
    to itself, which stands for staying; a round answers with the new communities of one half.
    """
    ends = weights.select(F.explode(F.array("a", "b")).alias("path")).distinct().withColumn("h", F.xxhash64("path"))
    nodes = stored(with_rank(ends, "n", F.col("h"), F.col("path")).select("path", "n", F.pmod("h", F.lit(2)).alias("half")))
    small = nodes.count() <= BROADCAST_NODES
    spread_by = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    number = lambda c, n: spread_by(nodes.select(F.col("path").alias(c), F.col("n").alias(n)))
    pairs = stored(weights.join(number("a", "u"), "a").join(number("b", "v"), "b").select("u", "v", "w"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    degree = both.groupBy("u").agg(F.sum("w").alias("k"))
    start = stored(nodes.select(F.col("n").alias("u"), "half").join(degree, "u"))
    linked = both.unionByName(start.select("u", F.col("u").alias("v"), F.lit(0.0).alias("w"))).join(spread_by(start), "u")
    # where communities are broadcast, the links of a node are summed up where they lie
    near = [cut(linked.filter(F.col("half") == half).select("u", "v", "w", "k").repartition("u" if small else "v")) for half in (0, 1)]
    homes = [start.filter(F.col("half") == half).select("u", F.col("u").alias("c"), "k") for half in (0, 1)]
    twice, still = start.agg(F.coalesce(F.sum("k"), F.lit(0.0))).head()[0], 0
    for r in range(ROUNDS):
        moved = cut(_moves(near[r % 2], homes[0].unionByName(homes[1]), twice, small))
        homes[r % 2] = moved.select("u", "c", "k")
        still = 0 if moved.agg(F.max(F.col("c") != F.col("own"))).head()[0] else still + 1
        if still == 2:
            break
    home = homes[0].unionByName(homes[1]).select("u", "c")
    return home.join(number("path", "u"), "u").join(number("community", "c"), "c").select("path", "community")


def _moves(near: DataFrame, home: DataFrame, twice: float, small: bool) -> DataFrame:
    """(u, own, c, k): the old and the new community of the nodes ``u`` of ``near`` (u, v, w, k), as all nodes are at ``home`` (u, c, k).

    ``small``: there are few nodes, and what is joined to links is broadcast.
    """
    spread_by = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    total = home.groupBy("c").agg(F.sum("k").alias("tot"))
    seats = home.select(F.col("u").alias("v"), "c").join(spread_by(total), "c")
    options = near.join(spread_by(seats), "v").groupBy("u", "c").agg(F.sum("w").alias("k_in"), F.max("tot").alias("tot"), F.max("k").alias("k"), F.max(F.col("u") == F.col("v")).alias("stays"))
    gain = F.col("k_in") * F.lit(twice) - (F.col("tot") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)) * F.col("k")
    best = F.max(F.struct(gain.alias("g"), "stays", (-F.col("c")).alias("t")))
    return options.groupBy("u").agg(F.max(F.when(F.col("stays"), F.col("c"))).alias("own"), (-best["t"]).alias("c"), F.max("k").alias("k"))


def coupling_score(weights: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: score = sum over adjacent pairs within a community of (w - k_u k_v / 2m), both directions, / 2m; rounded to 3; 2m; and health.

    Only adjacent pairs count, so this is not the usual modularity, for which see :func:`modularity`.
    """
    both = weights.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(weights.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    k = both.groupBy("u").agg(F.sum("w").alias("k"))
    m2 = k.agg(F.sum("k").alias("m2"))
    lu, lv = labelled.select(F.col("path").alias("u"), F.col("community").alias("cu")), labelled.select(F.col("path").alias("v"), F.col("community").alias("cv"))
    inner = both.join(lu, "u").join(lv, "v").filter("cu = cv").join(k.withColumnRenamed("k", "ku"), "u").join(k.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").join(F.broadcast(m2))  # one row
    score = inner.agg(F.sum(F.col("w") - F.col("ku") * F.col("kv") / F.col("m2")).alias("s"), F.max("m2").alias("_m"))
    row = score.join(F.broadcast(m2)).select(F.round(F.coalesce(F.col("s") / F.col("m2"), F.lit(0.0)), 3).alias("modularity_score"), F.coalesce("m2", F.lit(0.0)).alias("total_weight"))
    s = F.col("modularity_score")
    return row.withColumn("health", F.when(F.col("total_weight") == 0, "INSUFFICIENT_DATA").when(s < 0.2, "HIGHLY_ENTANGLED").when(s < 0.35, "MODERATE_COUPLING").otherwise("EXCELLENT"))


def modularity(weights: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: Newman's modularity of the same communities."""
    both = weights.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(weights.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    lu, lv = labelled.select(F.col("path").alias("u"), F.col("community").alias("c")), labelled.select(F.col("path").alias("v"), F.col("community").alias("cv"))
    rows = both.join(lu, "u").join(lv, "v").groupBy("c").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("c") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    m2 = both.agg(F.sum("w").alias("m2"))
    return rows.join(F.broadcast(m2)).agg(F.round(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), F.lit(2.0))), 3).alias("modularity"))  # one row


def community_report(graph: Graph, labelled: DataFrame, weights: DataFrame, min_size: int = 1) -> DataFrame:
    """One row per community of at least ``min_size`` modules: id by rank, name, size, weights, cohesion, domains."""
    domain = graph.nodes.filter("level = 'L1' AND path <> ''").groupBy("path").agg(F.max(F.when(F.col("domain") == "", "root").otherwise(F.col("domain"))).alias("domain"))
    members = labelled.join(domain, "path", "left")
    la, lb = labelled.select(F.col("path").alias("a"), F.col("community").alias("ca")), labelled.select(F.col("path").alias("b"), F.col("community").alias("cb"))
    w = weights.join(la, "a").join(lb, "b")
    inside = w.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("internal_weight"))
    across = w.filter("ca <> cb")
    outside = across.select(F.col("ca").alias("community"), "w").unionByName(across.select(F.col("cb").alias("community"), "w")).groupBy("community").agg(F.sum("w").alias("external_weight"))
    sizes = members.groupBy("community").agg(F.count("*").alias("size"), F.min("path").alias("first_module"), F.count_distinct("domain").alias("domains"))
    per_domain = members.groupBy("community", "domain").agg(F.count("*").alias("n"))
    top = per_domain.groupBy("community").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("dominant_domain"), F.max("n").alias("dominant_modules"))
    names = community_names(members)
    rows = sizes.join(inside, "community", "left").join(outside, "community", "left").join(top, "community").join(names, "community", "left").filter(F.col("size") >= max(1, min_size))
    i, x = F.coalesce("internal_weight", F.lit(0.0)), F.coalesce("external_weight", F.lit(0.0))
    rows = rows.withColumns({"internal_weight": F.round(i, 2), "external_weight": F.round(x, 2), "cohesion": F.when(i + x > 0, F.round(i / (i + x), 2)).otherwise(F.lit(0.0))})
    rows = with_rank(rows, "_rank", F.desc("size"), F.desc("cohesion"), F.col("first_module"))
    return rows.select(F.concat(F.lit("community_"), "_rank").alias("id"), F.coalesce("suggested_name", F.lit("module-cluster")).alias("suggested_name"), "size", "internal_weight", "external_weight", "cohesion", (F.col("domains") > 1).alias("spans_multiple_dirs"), "dominant_domain", "dominant_modules", "first_module", "community")


def community_names(members: DataFrame) -> DataFrame:
    """(community, suggested_name): the most frequent word of at least three letters of file stems and folders; ties by the alphabet."""
    stem_words = F.split(F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", ""), "[_.-]+")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    words = members.select("community", F.explode(F.concat(stem_words, folders)).alias("word")).select("community", F.lower("word").alias("word")).filter((F.length("word") >= 3) & ~F.col("word").isin(STOP_WORDS))
    counted = words.groupBy("community", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("community").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("suggested_name"))


def drift_alerts(graph: Graph, labelled: DataFrame, weights: DataFrame) -> DataFrame:
    """Modules alone of their domain in a community whose dominant domain has at least two: file_path, physical_domain, community, dominant_domain, affinity_score."""
    domain = graph.nodes.filter("level = 'L1' AND path <> ''").groupBy("path").agg(F.max(F.when(F.col("domain") == "", "root").otherwise(F.col("domain"))).alias("domain"))
    members = labelled.join(domain, "path")
    per_domain = members.groupBy("community", "domain").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    top = per_domain.groupBy("community").agg(F.min_by(F.struct("domain", "n"), F.struct(-F.col("n"), "domain")).alias("top"))
    lone = per_domain.filter("n = 1").join(top, "community").filter("top.n >= 2 AND domain <> top.domain")
    both = weights.select(F.col("a").alias("path"), F.col("b").alias("o"), "w").unionByName(weights.select(F.col("b").alias("path"), F.col("a").alias("o"), "w"))
    tied = both.join(lone.select("path", "community"), "path").join(labelled.select(F.col("path").alias("o"), F.col("community").alias("oc")), "o").groupBy("path").agg(F.round(F.sum(F.when(F.col("oc") == F.col("community"), F.col("w")).otherwise(0.0)) / F.sum("w"), 2).alias("affinity_score"))
    return lone.join(tied, "path", "left").select(F.col("path").alias("file_path"), F.col("domain").alias("physical_domain"), "community", F.col("top.domain").alias("dominant_domain"), F.coalesce("affinity_score", F.lit(0.0)).alias("affinity_score"))
