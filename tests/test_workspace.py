from pyspark.sql import functions as F

from stratograph.operators import audit, impact, query, routes, search, traverse, zoom
from stratograph.sources.workspace import Workspace, git_head, load, load_json, save, save_json, scan


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def edges(graph, kind):
    return {(r["src"], r["dst"]) for r in graph.of_type(kind).collect()}


LAYERED = {
    "src/controller/user_controller.py": "from src.service.user_service import serve\n\ndef handle():\n    return serve()\n",
    "src/service/user_service.py": "from src.repository.user_repository import load\n\ndef serve():\n    return load()\n",
    "src/repository/user_repository.py": "from src.controller.user_controller import handle\n\ndef load():\n    return 1\n",
}


def test_layers_cycle_and_coupling(spark, tmp_path):
    put(tmp_path / "ws", LAYERED)
    ws = Workspace(spark, str(tmp_path / "ws"), str(tmp_path / "store"))
    stats = ws.sync()
    assert stats["added"] == 3 and stats["modified"] == 0
    g = ws.graph()
    bad = audit.layer_violations(g).collect()
    assert [(r["source_layer"], r["target_layer"]) for r in bad] == [("repository", "controller")]
    cycles = audit.simple_cycles(audit.module_edges(g)).collect()
    assert len(cycles) == 1 and cycles[0]["cycle_length"] == 3
    told = {r["path"]: (r["ca"], r["ce"], r["instability"]) for r in audit.coupling(g).collect()}
    assert told["src/service/user_service.py"] == (1, 1, 0.5)
    assert audit.verdict(g).first()["status"] == "FAILED"
    assert ("symbol:src/controller/user_controller.py:handle", "symbol:src/service/user_service.py:serve") in edges(g, "CALLS")
    assert search.search(g, "user repo load").first()["file_path"] == "src/repository/user_repository.py"
    assert ws.sync()["cached"] == 3


def rows(g):
    n = sorted(map(str, g.nodes.select(*sorted(g.nodes.columns)).collect()))
    e = sorted(map(str, g.edges.select("src", "dst", "edge_type", "imported_names", "spec").collect()))
    return n, e


def test_delta_equals_full_rebuild(spark, tmp_path):
    root = tmp_path / "ws"
    put(root, {"pkg/core.py": "def base(\n    a,\n    b,\n):\n    return a\n", "pkg/user.py": "from .core import base\n\nclass U:\n    def save(self):\n        return base(1, 2)\n", "pkg/other.py": "class V:\n    def save(self):\n        return 1\n    def go(self):\n        return save()\n",
               "third.py": "def f(x):\n    return x.save()\n", "src/api.py": "@app.get('/u')\ndef base2():\n    return 1\n", "node_modules/x.py": "def no(): pass\n", "a.min.js": "x"})
    ws = Workspace(spark, str(root), str(tmp_path / "store"))
    assert ws.sync()["added"] == 5
    g = ws.graph()
    calls = edges(g, "CALLS")
    assert ("symbol:pkg/user.py:U.save", "symbol:pkg/core.py:base") in calls
    assert ("symbol:pkg/other.py:V.go", "symbol:pkg/other.py:V.save") in calls and not [x for x in calls if x[0] == "symbol:third.py:f"]
    assert edges(g, "HANDLED_BY") == {("route:src/api.py:GET:/u", "symbol:src/api.py:base2")}
    put(root, {"pkg/core.py": "def base(a, b, c):\n    return c\n", "pkg/new.py": "def extra():\n    return f(1)\n"})
    (root / "pkg/other.py").unlink()
    stats = ws.sync()
    assert (stats["added"], stats["modified"], stats["deleted"], stats["cached"]) == (1, 1, 1, 3)
    fresh = Workspace(spark, str(root), str(tmp_path / "fresh"))
    fresh.sync()
    assert rows(ws.graph()) == rows(fresh.graph())
    # removing one of two candidates makes the other one the target
    assert ("symbol:third.py:f", "symbol:pkg/user.py:U.save") in edges(ws.graph(), "CALLS")
    domains = {r["name"]: r["module_count"] for r in ws.graph().nodes.filter("level = 'L0'").collect()}
    assert domains == {"pkg": 3, "root": 1, "src": 1}
    assert ws._state()["graph"] == ["v/1", "v/2"]  # saved as changes
    # a version that is not whole is set aside: the one before is in force, and a sync leads from there to the same graph
    import shutil
    shutil.rmtree(tmp_path / "store" / "v/2/edges")
    again = ws.sync()
    assert (again["added"], again["modified"], again["deleted"], again["version"]) == (1, 1, 1, "v/3") and rows(ws.graph()) == rows(fresh.graph())
    # one file after an edit; what else changed waits for the next sync
    put(root, {"third.py": "def f(x):\n    return x.go()\n", "pkg/new.py": "def extra():\n    return 2\n"})
    assert ws.sync_file("third.py")["modified"] == 1 and ws.sync_file("gone.py")["cached"] == 0
    assert ws.graph().node("symbol:third.py:f").first()["calls"] == ["go"] and ws.graph().node("symbol:pkg/new.py:extra").first()["calls"] == ["f"]
    assert ws.sync()["modified"] == 1
    fresh.sync()
    assert rows(ws.graph()) == rows(fresh.graph())
    ws.clean()
    assert rows(ws.graph()) == rows(fresh.graph()) and ws.sync()["cached"] == 5
    # a store that does not fit what was recorded is built anew, and so is one of which nothing is whole
    import json
    commit = sorted((tmp_path / "store/commits").glob("*.json"))[-1]
    (commit.parent / f".{commit.name}.crc").unlink()
    commit.write_text(json.dumps(json.loads(commit.read_text()) | {"nodes": 1}))
    assert ws.sync()["added"] == 5
    shutil.rmtree(tmp_path / "store" / "v")
    assert ws.sync()["added"] == 5 and rows(ws.graph()) == rows(fresh.graph())


def test_go_modules_aliases_and_components(spark, tmp_path):
    put(tmp_path, {"go.mod": "module example.com/m\n", "svc/a.go": "package svc\n\nfunc A() {}\n", "svc/a_test.go": "package svc\n\nfunc T() {}\n", "main.go": 'package main\n\nimport "example.com/m/svc"\n\nfunc main() { svc.A() }\n',
                   "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["web/*"]}}}', "web/b.ts": "export function b() { return 1; }\n", "web/c.ts": 'import { b } from "@/b";\nexport function c() { return b(); }\n',
                   "web/App.vue": '<script>\nimport Card from "./Card.vue"\n</script>', "web/Card.vue": "<script>\n</script>"})
    ws = Workspace(spark, str(tmp_path), str(tmp_path / ".store"))
    g = ws.graph()
    assert edges(g, "IMPORTS") == {("file:main.go", "file:svc/a.go"), ("file:web/c.ts", "file:web/b.ts"), ("file:web/App.vue", "file:web/Card.vue")}
    assert ("symbol:web/c.ts:c", "symbol:web/b.ts:b") in edges(g, "CALLS")
    assert ws.status()["files"] == 7 and git_head(str(tmp_path)) is None


def test_blast_and_impact(spark, tmp_path):
    put(tmp_path, {"src/core/hash.py": "def hash_token(x):\n    return x\n", "src/auth/auth.py": "from src.core.hash import hash_token\n\ndef authenticate(t):\n    return hash_token(t)\n", "src/api/login.py": "from src.auth.auth import authenticate\n\ndef login_handler(t):\n    return authenticate(t)\n"})
    g = Workspace(spark, str(tmp_path), str(tmp_path / ".store")).graph()
    hits = {r["symbol_name"]: (r["hop_distance"], r["impact_score"]) for r in traverse.blast_radius(g, traverse.resolve_target(g, "hash_token")).collect()}
    assert hits == {"authenticate": (1, 54.0), "login_handler": (2, 27.0)}
    told = traverse.blast_summary(traverse.blast_radius(g, traverse.resolve_target(g, "hash_token"))).first()
    assert (told["blast_score"], told["risk_tier"]) == (100, "CRITICAL")
    assert {r["id"] for r in traverse.resolve_target(g, "src/core/hash.py").collect()} == {"symbol:src/core/hash.py:hash_token"}
    card = zoom.symbol_card(g, zoom.find_symbol(g, "authenticate")).first()
    assert card["callers"] == 1 and card["resolved_outgoing_calls"] == "symbol:src/core/hash.py:hash_token"
    assert query.query(g, query.NodeQuery(level="L3", sort="in_degree")).first()["in_degree"] == 1
    assert "authenticate" in traverse.blast_tree(traverse.blast_radius(g, traverse.resolve_target(g, "hash_token")), "x")


def test_json_and_parquet_round_trip(spark, tmp_path):
    put(tmp_path / "w", LAYERED)
    g = Workspace(spark, str(tmp_path / "w"), str(tmp_path / "s")).graph()
    save(g, str(tmp_path / "again"))
    assert rows(load(spark, str(tmp_path / "again"))) == rows(g)
    save_json(g, str(tmp_path / "json"))
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "symbol:a:x", "labels": ["Symbol"], "properties": {"level": "L3", "name": "x", "line_start": 3}}], "edges": [{"source_id": "symbol:a:x", "target_id": "gone", "edge_type": ""}]}')
    j = load_json(spark, str(tmp_path / "g.json"))
    assert j.nodes.first()["line_start"] == 3 and j.edges.first()["edge_type"] == "RELATES" and j.published().edges.count() == 0


def test_scan_ignores(spark, tmp_path):
    put(tmp_path, {"a/x.py": "1", "out/y.py": "1", "out.py": "1", "a/z.MIN.js": "1", "a/z.min.js": "1", "b/dist/q.py": "1", "c/readme.md": "x", "skip/me.py": "1"})
    assert {r["path"] for r in scan(spark, str(tmp_path), ["skip"]).collect()} == {"a/x.py", "out.py", "a/z.MIN.js"}
    assert scan(spark, str(tmp_path)).filter(F.length("sha") != 64).count() == 0
    assert routes is not None and impact is not None
