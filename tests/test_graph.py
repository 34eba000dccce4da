import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratograph.functions import paths
from stratograph.graph import Graph
from stratograph.operators import audit, community, impact, query, records, routes, search, sync, traverse, zoom
from stratograph.operators.resolve import resolve_calls, resolve_imports

NODE = "id string, level string, name string, file_path string, path string, domain string, layer string, kind string, is_public boolean, cyclomatic_complexity int, line_start int, line_end int, labels array<string>"


def graph(spark, nodes, edges):
    keys = [x.split()[0] for x in NODE.split(", ")]
    rows = [tuple(n.get(k) for k in keys) for n in nodes]
    return Graph.of(spark.createDataFrame(rows, NODE), spark.createDataFrame(edges or [], "src string, dst string, edge_type string"))


def sym(i, name=None, file="a.go", **more):
    return {"id": i, "level": "L3", "name": name or i, "file_path": file, "kind": "function", **more}


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, [sym("A", file="a.go", cyclomatic_complexity=22, is_public=True), sym("B", file="b.go", cyclomatic_complexity=3), sym("C", file="c.go", cyclomatic_complexity=2)], [("B", "A", "CALLS")])


def test_structural_query(small):
    ids = lambda **k: [r["id"] for r in query.query(small, query.NodeQuery(**k)).collect()]
    assert ids(min_complexity=20) == ["A"] and ids(level="l3", max_in=0, max_out=0) == ["C"] and ids(file="a.go") == ["A"] and ids(file="*.GO") == ["A", "B", "C"]
    assert ids(name="^a$") == ["A"] and ids(name="[.*") == ["A", "B", "C"] and ids(is_public=True) == ["A"] and ids(limit=1) == ["A"]
    assert query.query_counts(small, query.NodeQuery(level="L3", min_in=1)).first().asDict() == {"total_scanned": 3, "total_matched": 1}


def test_store(small, spark):
    assert small.has("A") and not small.has("Z") and small.outgoing("B", "CALLS").count() == 1 and small.incoming("A").count() == 1
    same = small.nodes
    assert small.changed_nodes(same).count() == 0
    changed = same.withColumn("name", F.when(F.col("id") == "A", "A2").otherwise(F.col("name")))
    assert [r["id"] for r in small.changed_nodes(changed).collect()] == ["A"]
    g = small.upsert_nodes(changed)
    assert g.nodes.count() == 3 and g.node("A").first()["name"] == "A2"
    g = g.delete_nodes(spark.createDataFrame([("A",), (None,)], "id string"))
    assert g.nodes.count() == 2 and g.edges.count() == 0
    assert small.upsert_edges(small.edges).edges.count() == 1 and small.delete_edges(["CALLS"]).edges.count() == 0 and small.delete_edges(source="X").edges.count() == 1
    assert small.delete_file("a.go").nodes.count() == 2 and small.counts().first()["l3_nodes"] == 3
    empty = graph(spark, [], [])
    assert empty.counts().first()["total_nodes"] == 0 and empty.degrees().count() == 0 and query.query(empty, query.HOTSPOTS).count() == 0


def test_names(spark):
    g = graph(spark, [sym("1", "AuthService.login", "pkg/a.py"), sym("2", "login", "pkg/b.py")], [])
    count = lambda *a: g.named(*a).count()
    assert (count("login"), count("login", "pkg/b.py"), count("login", "pkg\\a.py"), count("AuthService.login")) == (2, 1, 1, 1)


def test_traces(spark):
    g = graph(spark, [sym(x, file=f"{x}.go") for x in "ABCD"], [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("A", "D", "CALLS")])
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert traverse.call_tree(g, of("A")).count() == 3 and traverse.call_tree(g, of("C"), "inbound").count() == 2
    assert [tuple(r) for r in traverse.call_paths(g, of("A"), of("C")).collect()] == [(2, "A -> B -> C")]
    assert traverse.call_paths(g, of("A"), of("A")).count() == 0 and traverse.call_tree(g, of("A"), cap=1).count() == 1
    assert traverse.call_tree(g, of("Z")).count() == 0


def test_hub_may_exceed_cap(spark):
    g = graph(spark, [sym("T")] + [sym(f"c{i:03}", file=f"{i}.py", domain="services") for i in range(300)] + [sym("far")], [(f"c{i:03}", "T", "CALLS") for i in range(300)] + [("far", "c000", "CALLS")])
    r = traverse.blast_radius(g, spark.createDataFrame([("T",)], "id string"), max_hops=2)
    assert r.count() == 300
    assert traverse.blast_radius(g, spark.createDataFrame([("T",)], "id string"), max_hops=2, cap=0).count() == 301


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_cycles_against_brute_force(spark, seed):
    pairs = [(a, b) for a, b in random_edges(14, 26, seed) if a != b]
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    nodes = {x for p in pairs for x in p}
    reaches = {x: reach(x) for x in nodes}
    want = {}
    for x in nodes:
        same = {y for y in reaches[x] if x in reaches[y]} | {x}
        if len(same) > 1:
            want[x] = min(same)
    df = spark.createDataFrame(pairs, "src string, dst string")
    assert {r["id"]: r["component"] for r in audit.components(df).collect()} == want
    assert {r["id"]: r["component"] for r in audit.components(df, in_one_task=0).collect()} == want
    cycles = set()

    def walk(path):
        for y in out[path[-1]]:
            if y == path[0]:
                cycles.add(" -> ".join([*path, y]))
            elif y > path[0] and y not in path and len(path) < 5:
                walk([*path, y])

    for x in nodes:
        walk([x])
    cycles = {c for c in cycles if c.count("->") > 1}
    assert {r["chain"] for r in audit.simple_cycles(df, 5, 0).collect()} == cycles
    assert audit.simple_cycles(df, 5, 3).count() == min(3, len(cycles))


def test_cycles_of_any_length(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)] + [("x", "n0")]
    assert [r["cycle_length"] for r in audit.simple_cycles(spark.createDataFrame(ring, "src string, dst string")).collect()] == [6]
    assert audit.normalized_path("./a//b/../c.py/") == "a/c.py" and audit.normalized_path("/w/x/a.py", "/w/x/") == "a.py" and audit.normalized_path("a\\b.py") == "a/b.py"


def test_hub_cycles(spark):
    df = spark.createDataFrame([("h", "a"), ("a", "h"), ("h", "b"), ("b", "h")], "src string, dst string")
    assert sorted(r["chain"] for r in audit.simple_cycles(df).collect()) == ["a -> h -> a", "b -> h -> b"]
    assert audit.simple_cycles(df, through="b").count() == 1 and audit.components(df.limit(0)).count() == 0


def louvain_fixture(spark):
    paths_ = ["pay/ctrl.py", "pay/repo.py", "pay/svc.py", "user/ctrl.py", "user/repo.py", "user/svc.py"]
    nodes = [{"id": f"file:{p}", "level": "L1", "path": p, "domain": p.split("/")[0]} for p in paths_]
    e = [("user/ctrl", "user/svc"), ("user/svc", "user/repo"), ("pay/ctrl", "pay/svc"), ("pay/svc", "pay/repo"), ("pay/svc", "user/svc")]
    return graph(spark, nodes, [(f"file:{a}.py", f"file:{b}.py", "IMPORTS") for a, b in e])


def test_communities(spark):
    g = louvain_fixture(spark)
    w = community.module_weights(g)
    told = community.communities(g, w, "sequential")
    report = community.community_report(g, told, w).collect()
    assert [r["size"] for r in report] == [3, 3] and report[0]["cohesion"] == 0.67 and report[0]["suggested_name"] == "pay" and [r["id"] for r in report] == ["community_1", "community_2"]
    score = community.coupling_score(w, told).first()
    assert (score["modularity_score"], score["health"], score["total_weight"]) == (0.56, "EXCELLENT", 20.0)
    assert community.modularity(w, told).first()[0] == 0.3
    assert community.coupling_score(w.limit(0), told).first()["health"] == "INSUFFICIENT_DATA"


def test_communities_are_the_same_on_both_sides_of_the_bound(spark, monkeypatch):
    """One rule: in one task, by joins, and as a plain program that looks at every community for every node."""
    monkeypatch.setattr(community, "ROUNDS", 4)
    rng = random.Random(1)
    names = [f"m{i:02}.py" for i in range(16)]
    pairs = {(a, b): rng.choice([1.0, 2.0, 3.0]) for a in names for b in names if a < b and rng.random() < (0.7 if int(a[1:3]) // 5 == int(b[1:3]) // 5 else 0.05)}
    w = spark.createDataFrame([(a, b, x) for (a, b), x in pairs.items()], "a string, b string, w double")
    g = graph(spark, [{"id": f"file:{p}", "level": "L1", "path": p} for p in names], [])
    one = {r["path"]: r["community"] for r in community.communities(g, w).collect()}
    assert {r["path"]: r["community"] for r in community.communities(g, w, one_task_pairs=0).collect()} == one
    h = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in names], "x string").select("x", F.xxhash64("x")).collect()}
    weight = lambda a, b: pairs.get((min(a, b), max(a, b)), 0.0)
    k = {a: sum(weight(a, b) for b in names if b != a) for a in names}
    m2, home, still = sum(k.values()), {a: a for a in names}, 0
    for r in range(community.ROUNDS):
        new = dict(home)
        for v in names:
            if k[v] and h[v] % 2 == r % 2:
                options = {home[u] for u in names if u != v and weight(u, v)} | {home[v]}
                gain = lambda c: sum(weight(u, v) for u in names if u != v and home[u] == c) * m2 - sum(k[u] for u in names if u != v and home[u] == c) * k[v]  # noqa: B023, E731
                new[v] = max(options, key=lambda c: (gain(c), c == home[v], -h[c]))  # noqa: B023
        still, home = (0 if new != home else still + 1), new
        if still == 2:
            break
    assert home == one and len(set(one.values())) < 16


def test_local_moving_never_loses_modularity():
    for seed in range(5):
        pairs = [(a, b, 1.0) for a, b in random_edges(20, 40, seed) if a < b]
        home = community.local_moving(pairs)
        m2 = 2 * len(pairs)
        degree = defaultdict(int)
        for a, b, _ in pairs:
            degree[a] += 1
            degree[b] += 1

        def q(label):
            return sum(2 for a, b, _ in pairs if label[a] == label[b]) / m2 - sum((sum(degree[x] for x in degree if label[x] == c) / m2) ** 2 for c in set(label.values()))

        assert q(home) >= q({x: x for x in degree}) - 1e-12 and set(home) == set(degree)


def test_resolution_ladder(spark):
    S = spark.createDataFrame([("1", "A.save", "a.py", "class:a:A"), ("2", "B.save", "a.py", "class:a:B"), ("3", "A.go", "a.py", "class:a:A"), ("4", "use", "b.py", "file:b.py"), ("5", "only", "c.py", "file:c.py"), ("6", "twin", "c.py", "f"), ("7", "twin", "d.py", "f"), ("8", "rec", "d.py", "f")],
                              "id string, name string, file_path string, parent_id string")
    C = spark.createDataFrame([("3", "save"), ("4", "save"), ("4", "only"), ("4", "twin"), ("3", "twin"), ("8", "rec"), ("4", "nothing"), ("9", "save"), ("3", None)], "caller_id string, called_name string")
    imports = spark.createDataFrame([("b.py", "c.py")], "source_file string, target string")
    got = {tuple(r) for r in resolve_calls(C, S, imports).collect()}
    # own class; ambiguous; only one; imported twin; ambiguous twin; itself is no candidate
    assert got == {("3", "1"), ("4", "5"), ("4", "6")}


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a/b.py", "src/a/c/__init__.py", "lib/x/y.ts", "lib/x/z/index.ts", "inc/h.hpp", "include/k.h", "m.js", "p/Q.php")], "path string")
    I = spark.createDataFrame([("src/a/m.py", ".b", ["f"], True), ("src/a/c/d.py", "..b", ["g"], True), ("src/a/m.py", ".", ["c"], True), ("z.py", "a.b", ["h"], False), ("lib/x/q.ts", "./y", ["y"], True), ("lib/x/q.ts", "./z", [], True), ("lib/x/w/r.ts", "../y", [], True),
                               ("k.c", "k.h", [], False), ("n.js", "./m", [], True), ("r.php", "p\\Q", [], False), ("src/a/b.py", ".b", [], True), ("z.py", "os", [], False), (None, "x", [], False)], "source_file string, module_spec string, names array<string>, is_relative boolean")
    got = {(r["source_file"], r["target"]): r["imported_names"] for r in resolve_imports(I, files).collect()}
    assert got[("src/a/m.py", "src/a/b.py")] == ["f"] and got[("src/a/c/d.py", "src/a/b.py")] == ["g"] and ("src/a/m.py", "src/a/c/__init__.py") in got and ("z.py", "src/a/b.py") in got
    assert ("lib/x/q.ts", "lib/x/y.ts") in got and ("lib/x/q.ts", "lib/x/z/index.ts") in got and ("lib/x/w/r.ts", "lib/x/y.ts") in got and ("k.c", "include/k.h") in got and ("r.php", "p/Q.php") in got
    assert ("n.js", "m.js") not in got and not [k for k in got if k[0] == k[1]]


def test_diff_and_overlap(spark):
    text = "diff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -9,3 +10,4 @@ x\n+1\n@@ -40 +41,5 @@\n--- a/b.go\n+++ b/b.go\n@@ -1,0 +5,2 @@\n--- a/gone.go\n+++ /dev/null\n@@ -1,9 +0,0 @@\n--- a/c.go\n+++ b/c.go\n@@ -3 +3 @@\n@@ -8,2 +7,0 @@\n"
    spans = impact.diff_spans(spark.createDataFrame([("d", text), ("e", None)], "diff_id string, text string"))
    assert sorted(tuple(r)[1:] for r in spans.collect()) == [("a.go", 10, 13), ("a.go", 41, 45), ("b.go", 5, 6), ("c.go", 3, 3), ("c.go", 7, 7)]
    g = graph(spark, [sym("s1", file="service.go", line_start=10, line_end=30, is_public=True), sym("s2", file="service.go", line_start=80, line_end=95), sym("t", file="service_test.go", line_start=1, line_end=9), sym("u", file="service.go", line_start=0, line_end=0)], [("t", "s1", "CALLS"), ("ghost", "t", "CALLS"), ("s2", "ghost", "CALLS")])
    changed = impact.changed_symbols(g, spark.createDataFrame([("service.go", 15, 16), ("service.go", 16, 20)], "file_path string, start int, end int"))
    assert [r["id"] for r in changed.collect()] == ["s1"]
    hit = impact.affected(g, changed)
    assert [(r["id"], r["is_test"], r["target_symbol"]) for r in hit.collect()] == [("t", True, "s1")] and impact.affected(g, changed, scope="symbols").count() == 0
    told = impact.change_summary(changed, hit).first()
    assert (told["blast_score"], told["risk_tier"], told["affected_tests"]) == (15, "LOW", 1)


def test_routes(spark):
    g = graph(spark, [sym("symbol:h.go:GetUsers", "GetUsers", "h.go"), {"id": "file:h.go", "level": "L1", "path": "h.go"}], [])
    R = spark.createDataFrame([("r1", "GET", "/api/users", "GetUsers", "h.go", 3, "go-web"), ("r2", "POST", "/payments", "Pay", "h.go", 4, "go-web")], "id string, method string, path string, handler_name string, file_path string, line int, framework string")
    g2 = routes.index_routes(routes.index_routes(g, R), R)
    assert [(r["id"], r["handler_id"]) for r in routes.list_routes(g2, "users").collect()] == [("r1", "symbol:h.go:GetUsers")]
    assert g2.of_type("EXPOSES_ROUTE").count() == 1 and g2.node("symbol:h.go:GetUsers").first()["routes"] == ["GET /api/users"]
    assert routes.list_routes(g2, method="all").count() == 2 and routes.list_routes(g2, method="post").count() == 1
    J = spark.createDataFrame([("", ""), ("a/", "/b"), ("", "x"), ("/", "/"), ("/p", ""), (None, "/q//")], "p string, s string").select(routes.joined_path(F.col("p"), F.col("s")).alias("j"))
    assert [r["j"] for r in J.collect()] == ["/", "/a/b", "/x", "/", "/p", "/q//"]


def test_search(spark):
    T = spark.createDataFrame([("1", "ZoomSymbol parseHTTPServer"), ("2", "zoom_symbol helper2"), ("3", ""), ("4", None), ("5", "other words")], "id string, text string")
    postings, documents = search.index(T)
    terms = defaultdict(set)
    for r in postings.collect():
        terms[r["id"]].add(r["term"])
    assert terms["1"] == {"zoomsymbol", "zoom", "symbol", "parsehttpserver", "parse", "http", "server"} and terms["2"] == {"zoom_symbol", "zoom", "symbol", "helper2", "helper", "2"} and documents.count() == 3
    for q in ("symbol", "http", "server", "zoom", "Zoom zoom parse", "pars serv"):
        a = {r["id"]: round(r["score"], 9) for r in search.scores(postings, documents, q).collect()}
        assert a and a == {r["id"]: round(r["score"], 9) for r in search.score_texts(T, q).collect()}
    assert search.scores(postings, documents, "zoom zoom").filter("id = '1'").first()["score"] == pytest.approx(2 * search.scores(postings, documents, "zoom").filter("id = '1'").first()["score"])
    assert [r["term"] for r in search.fuzzy_terms(postings, "symbl").collect()] == ["symbol"]
    p2, d2 = search.without(postings, documents, spark.createDataFrame([("1",)], "id string"))
    assert p2.filter("id = '1'").count() == 0 and d2.count() == 2 and search.top_terms(postings, 2, documents).filter("id = '1'").count() == 2


def test_overview(spark):
    mods = [{"id": f"file:d/{i:02}.py", "level": "L1", "path": f"d/{i:02}.py", "domain": "d"} for i in range(55)]
    g = graph(spark, [{"id": "domain:d", "level": "L0", "name": "d"}, *mods], [("domain:d", m["id"], "CONTAINS") for m in mods])
    assert zoom.overview_domains(g).first()["total_modules"] == 55
    assert zoom.overview_modules(g).count() == 5 and zoom.overview_modules(g).first()["summary_mode"] and zoom.overview_modules(g, "d").count() == 50
    assert zoom.module_card(g, g.nodes.filter("id = 'file:d/00.py'")).first()["functions"] == 0


def test_records(spark, tmp_path):
    a = records.created(records.created(records.empty(spark), "Use Parquet", today="2025-01-01", tags=["Store"]), "Drop JSON", today="2025-01-02")
    assert [(r["id"], r["status"]) for r in records.listed(a).collect()] == [("ADR-0001", "accepted"), ("ADR-0002", "accepted")]
    assert records.listed(a, tag="store").count() == 1 and records.one(a, "2").first()["title"] == "Drop JSON"
    b = records.updated(a, "1", superseded_by="ADR-0002", today="2025-02-01")
    assert records.one(b, "ADR-0001").first()["status"] == "superseded" and records.one(b, "2").first()["updated_at"] == "2025-01-02"
    assert records.write_markdown(b, str(tmp_path)) == ["0001-use-parquet.md", "0002-drop-json.md"]
    assert records.write_markdown(records.deleted(b, "2"), str(tmp_path)) == ["0001-use-parquet.md"] and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        records.created(a, " ")


def test_maintenance(spark, small):
    schema = "path string, sha string, mtime long, size long"
    scan = spark.createDataFrame([("a", "X", 1, 1), ("b", "new", 2, 2), ("c", "same", 9, 9), ("d", "q", None, 1)], schema)
    old = spark.createDataFrame([("a", "x", 5, 1), ("b", "old", 1, 1), ("c", "other", 9, 9), ("e", "z", 1, 1)], schema)
    assert {r["path"]: r["change"] for r in sync.classify(scan, old).collect()} == {"a": "unchanged", "b": "modified", "c": "unchanged", "d": "added", "e": "deleted"}
    j = spark.createDataFrame([(1, "A", "delete"), (2, "A", "upsert"), (3, "B", "delete"), (3, "B", "delete"), (1, "B", "upsert")], "seq long, node_id string, op string")
    g = sync.apply_journal(small, j, small.nodes)
    assert {r["id"] for r in g.nodes.collect()} == {"A", "C"} and sync.last_intents(j).count() == 2
    assert sync.save_mode(10, 100, 100) == "delta" and sync.save_mode(3000, 100, 100) == "full" and sync.save_mode(None, 1, 1) == "full"
    assert sync.drifted(small, scan) and sync.owned_only(small, spark.createDataFrame([("a.go", "x")], "path string, domain string")).nodes.count() == 1


def test_path_expressions(spark):
    P = spark.createDataFrame([(p,) for p in ("src/rapid.py", "src/handlers/user_repo.py", "src/controllers/user.py", "a.kts", "tests/a.py", "x/tests/a.py", "x/test_a.py", "b/a_test.go", "README")], "p string")
    got = {r["p"]: r for r in P.select("p", paths.layer(F.col("p")).alias("l"), paths.domain(F.col("p")).alias("d"), paths.language(F.col("p")).alias("g"), paths.is_test_file(F.col("p")).alias("t")).collect()}
    assert [got[p]["l"] for p in ("src/rapid.py", "src/handlers/user_repo.py", "src/controllers/user.py")] == ["", "repository", "controller"]
    assert got["a.kts"]["d"] == "root" and got["a.kts"]["g"] == "kotlin" and got["README"]["g"] is None
    assert [got[p]["t"] for p in ("tests/a.py", "x/tests/a.py", "x/test_a.py", "b/a_test.go", "a.kts")] == [False, True, True, True, False]
    C = spark.createDataFrame([("a/./b/../c",), ("a/..",), ("../x",), ("",)], "p string").select(paths.clean(F.col("p")).alias("c"))
    assert [r["c"] for r in C.collect()] == ["a/c", "", "../x", ""]
