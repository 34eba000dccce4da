"""Communities and drift: weights from the tables, rounds by joins."""

import shutil

import pytest

from stratograph.graph import Graph, as_nodes
from stratograph.operators import community
from stratograph.operators.resolve import table_edges
from stratograph.plans import graph_queries
from stratograph.session import data_dir
from tests.test_graph import graph, random_edges


def test_weights_over_numbers(spark):
    """Names that are the caller's own, in its class, its file, an imported file or anywhere; files that are no modules; an id of another form."""
    nodes = [{"id": f"file:{p}", "level": "L1", "path": p, "import_paths": i} for p, i in [("a.py", ["b", "c"]), ("b.py", ["a"]), ("c.py", []), ("d.py", ["e"])]] + [{"id": "e!", "level": "L1", "path": "e.py", "import_paths": []}]
    symbols = [("1", "A.save", "a.py", "class:A", ["save", "go", "one"]), ("2", "B.save", "a.py", "class:B", ["run", "twin"]), ("3", "A.go", "a.py", "class:A", ["save", "only", "none", "only"]), ("4", "one", "b.py", "", ["go", "save", "far", ""]),
               ("5", "only", "x.py", "", ["one", "far"]), ("6", "twin", "c.py", "", ["one"]), ("7", "twin", "d.py", "", ["far"]), ("8", "run", "c.py", "", []), ("9", "run", "d.py", "", ["go"]), ("10", "far", "e.py", "", ["one", "go"]), ("11", "", "e.py", "", ["one"])]
    nodes += [{"id": i, "level": "L3", "name": n, "file_path": f, "parent_id": p, "calls": c} for i, n, f, p, c in symbols]
    fields = "id string, level string, name string, path string, file_path string, parent_id string, import_paths array<string>, calls array<string>"
    n = as_nodes(spark.createDataFrame([tuple(x.get(f.split()[0]) for f in fields.split(", ")) for x in nodes], fields))
    got = {tuple(r) for r in community.table_weights(n).collect()}
    assert got == {tuple(r) for r in community.module_weights(Graph(n, table_edges(n))).collect()} and len(got) > 5


@pytest.mark.parametrize("name", ["c_communities", "c_drift"])
def test_queries_of_coupling_do_not_build_the_stored_graph(spark, tmp_path, name):
    shutil.copytree(data_dir(), tmp_path / "data")
    ask = lambda: sorted(map(str, graph_queries.QUERIES[name](spark, str(tmp_path / "data")).collect()))
    from_tables = ask()
    assert Graph.built(spark, str(tmp_path / "data")) is None
    Graph.indexed(spark, str(tmp_path / "data"))
    assert ask() == from_tables


def test_rounds_by_joins_do_not_shuffle_links(spark, monkeypatch):
    pairs = [(a, b, 1.0) for a, b in random_edges(40, 90, 3) if a < b]
    w, g = spark.createDataFrame(pairs, "a string, b string, w double"), graph(spark, [{"id": f"file:{p}", "level": "L1", "path": p} for p in {x for a, b, _ in pairs for x in (a, b)}], [])
    plans, moves = [], community._moves

    def seen(*args):
        df = moves(*args)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(community, "ROUNDS", 3)
    monkeypatch.setattr(community, "_moves", seen)
    one = sorted(community.communities(g, w).collect())
    assert sorted(community.communities(g, w, one_task_pairs=0).collect()) == one
    assert plans and all("hashpartitioning(v" not in p and p.count("BroadcastHashJoin") == 2 for p in plans)
    monkeypatch.setattr(community, "BROADCAST_NODES", 0)
    assert sorted(community.communities(g, w, one_task_pairs=0).collect()) == one
