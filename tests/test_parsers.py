import pytest

from stratograph.parsing import parse_file
from stratograph.parsing.endpoints import find_routes, joined, next_path
from stratograph.parsing.source import domain_of, layer_of


def symbols(r):
    return {s["name"]: s for s in r.symbols}


def test_layers_and_domains():
    assert [layer_of(p) for p in ("src/rapid.py", "src/handlers/user_repo.py", "src/controllers/user.py", "x/db/readme.py")] == ["", "repository", "controller", "repository"]
    assert [domain_of(p) for p in ("a.py", "src/a.py", "src/billing/a.py", "tools/x/a.py")] == ["root", "src", "billing", "tools"]


def test_python():
    r = parse_file("pkg/user.py", '"""Users."""\nfrom .core import base, other as o\n\nclass User(Base):\n    """A user."""\n    name: str\n\n    def load(\n        self,\n        key: str,  # which\n    ) -> str:\n        """Loads."""\n        if key and base(key):\n            def inner():\n                return deep()\n            return helper(key)\n\n\nasync def run(x):\n    # not_a_call()\n    return User().load("y(")\n')
    s = symbols(r)
    assert s["User.load"]["signature"] == "def load(self, key: str) -> str" and s["User.load"]["kind"] == "method" and s["User.load"]["docstring"] == "Loads."
    assert s["User.load"]["calls"] == ["base", "deep", "helper"] and s["User.load"]["parent_id"] == "class:pkg/user.py:User" and (s["User.load"]["line_start"], s["User.load"]["line_end"]) == (8, 16)
    assert s["run"]["kind"] == "async_function" and s["run"]["calls"] == ["User", "load"]
    assert r.imports == [{"source_file": "pkg/user.py", "module_spec": ".core", "names": ["base", "o"], "is_relative": True}]
    assert r.classes[0]["bases"] == ["Base"] and r.classes[0]["docstring"] == "A user." and r.classes[0]["method_signatures"] == [s["User.load"]["signature"]] and r.classes[0]["field_signatures"] == ["name: str"]
    assert r.module["docstring"] == "Users." and r.module["exports"] == ["User"] and r.module["loc"] == 22


def test_go():
    r = parse_file("svc/a.go", '// Package a serves.\npackage a\n\nimport "m/x"\n\n// T holds.\ntype T struct {\n\tBase\n\tn int\n}\n\n// Do does.\nfunc (t *T) Do(a, b int) (int, error) {\n\tif a > 1 && b > 2 {\n\t\tx.List(t)\n\t}\n\tswitch a {\n\tcase 1:\n\tdefault:\n\t}\n\treturn len(s), nil\n}\n\nfunc asm(a int) int\n')
    s = symbols(r)
    assert r.classes[0]["kind"] == "struct" and r.classes[0]["bases"] == ["Base"] and r.classes[0]["docstring"] == "T holds."
    assert s["T.Do"]["calls"] == ["List"] and s["T.Do"]["cyclomatic_complexity"] == 5 and s["T.Do"]["params"] == ["a int", "b int"] and s["T.Do"]["signature"] == "func (t *T) Do(a int, b int) (int, error)"
    assert s["asm"]["calls"] == [] and s["asm"]["is_public"] is False
    broken = parse_file("svc/b.go", "package b\nfunc f() {\n")
    assert broken.symbols == [] and broken.module["language"] == "go"


def test_typescript_and_components():
    r = parse_file("src/a.tsx", 'import { b as c } from "./b";\nexport class A extends B {\n  private n: number = 1;\n  private hide() { return c(1); }\n  async load(id: string): Promise<{ a: string }> {\n    if (id) {\n      function inner() { return no(); }\n      return fetchIt(id);\n    }\n  }\n}\nexport const Card = (p) => {\n  // old()\n  return <UserCard x={help(p)} />;\n};\nfunction util(a) {\n  return other(a);\n}\n')
    s = symbols(r)
    assert s["A.load"]["calls"] == ["fetchIt"] and not s["A.hide"]["is_public"] and s["A.hide"]["calls"] == ["c"]
    assert s["Card"]["kind"] == "component" and s["Card"]["calls"] == ["help", "UserCard"] and s["util"]["calls"] == ["other"]
    assert r.imports[0]["names"] == ["c"] and r.imports[0]["is_relative"]
    assert [c for c in r.calls if c["called_name"] == "UserCard"][0]["line_number"] == 14
    angular = parse_file("src/c.ts", "@Component({ selector: 'x' })\nexport class X {\n}\n")
    assert angular.classes[0]["kind"] == "component"
    vue = parse_file("src/App.vue", '<template><div><UserCard/><my-list/></div></template>\n<script setup>\nimport UserCard from "./UserCard.vue"\nfunction go() { return x(); }\n</script>\n<style>.a{}</style>')
    assert vue.classes[0]["name"] == "App" and {"UserCard", "MyList"} <= set(vue.module["exports"]) and "div" not in vue.module["exports"] and "go" in symbols(vue)


@pytest.mark.parametrize("path,text,classes,name,parent,call,imports", [
    ("s/A.java", "package p;\nimport a.B;\nimport static c.D;\npublic class A {\n  public int get() { return helper(); }\n  public int put(int x) { return other(x); }\n}\n", [("A", "class")], "get", "A", ("helper", 5), ["a.B", "c.D"]),
    ("s/a.kt", "package p\nimport a.B\ndata class A(val x: Int)\nprivate fun go(x: Int): Int {\n  return helper(x)\n}\n", [("A", "data class")], "go", "A", ("helper", 5), ["a.B"]),
    ("s/a.cs", "using X.Y;\nnamespace N {\n  public class A {\n    public async Task<int> Go(int x) {\n      return Helper(x);\n    }\n  }\n}\n", [("A", "class")], "Go", "A", ("Helper", 5), ["X.Y"]),
    ("s/a.swift", "import Foundation\nstruct A {\n  func go(x: Int) -> Int {\n    return helper(x)\n  }\n}\n", [("A", "struct")], "go", "A", ("helper", 4), ["Foundation"]),
    ("s/a.php", "<?php\nuse A\\B;\nclass C {\n  public function go($x) {\n    return helper($x);\n  }\n}\n", [("C", "class")], "go", "C", ("helper", 5), ["A\\B"]),
    ("s/a.rs", "use crate::x::Y;\nuse std::fmt;\npub struct A;\nimpl A {\n    pub fn go(&self) -> i32 {\n        helper()\n    }\n}\n", [("A", "struct")], "go", "A", ("helper", 6), ["crate/x/Y", "std/fmt"]),
    ("s/a.cpp", '#include "x.h"\n#include <vector>\nclass A {\n};\nint go(int x) {\n  return helper(x);\n}\nint decl(int x);\n', [("A", "class")], "go", "A", ("helper", 6), ["x.h", "vector"]),
])
def test_brace_family(path, text, classes, name, parent, call, imports):
    r = parse_file(path, text)
    s = symbols(r)
    assert [(c["name"], c["kind"]) for c in r.classes] == classes
    assert s[name]["parent_id"].endswith(":" + parent) and call[0] in s[name]["calls"]
    assert {"caller_id": s[name]["id"], "called_name": call[0], "line_number": call[1]} in r.calls
    assert [i["module_spec"] for i in r.imports] == imports
    if "decl" in s:
        assert s["decl"]["calls"] == []
    if path.endswith("java"):
        assert s["put"]["calls"] == ["other"]
    assert r.classes[0]["method_signatures"]


def test_empty_and_unknown_files():
    assert parse_file("a.txt", "x") is None
    for ext in ("py", "go", "ts", "vue", "java", "kt", "cs", "swift", "php", "rs", "c"):
        r = parse_file(f"x/a.{ext}", "")
        assert r.module["loc"] == 1 and not r.symbols
        parse_file(f"x/a.{ext}", "}}}} ((( \"'`/* # \n" * 50)


def test_routes():
    go = find_routes("a/main.go", '// r.GET("/no", h)\nr.GET("/users", auth, h.List)\nrouter.POST("/users", Create)\nhttp.HandleFunc("/health", s.Health)\n')
    assert [(r["method"], r["path"], r["handler_name"], r["line"]) for r in go] == [("GET", "/users", "List", 2), ("POST", "/users", "Create", 3), ("ANY", "/health", "Health", 4)]
    py = find_routes("a/m.py", '@app.get("/a")\n@auth\ndef a():\n    pass\n@router.post("/b", x=1)\nasync def skip(): pass\ndef b():\n    pass\n')
    assert [(r["method"], r["path"], r["handler_name"]) for r in py] == [("GET", "/a", "a"), ("POST", "/b", "b")]
    ts = find_routes("a/m.ts", "/* app.get('/x', y)\n\n */ // z\n\n\n\napp.get('/users', list);\nrouter.delete('/u/:id', auth, remove);\n")
    assert [(r["path"], r["handler_name"], r["line"]) for r in ts] == [("/users", "list", 7), ("/u/:id", "remove", 8)]
    nest = find_routes("a/c.ts", "@Controller('cats')\nexport class C {\n  @Get(':id')\n  async one() {}\n  @Post()\n  make() {}\n}\n")
    assert [(r["method"], r["path"], r["handler_name"]) for r in nest] == [("GET", "/cats/:id", "one"), ("POST", "/cats", "make")]
    spring = find_routes("a/C.java", '@RequestMapping("/api/v1/")\npublic class C {\n  @GetMapping("/x")\n  public List<X> all() {\n  }\n}\n')
    assert [(r["path"], r["handler_name"]) for r in spring] == [("/api/v1/x", "all")]
    assert find_routes("app/api/users/route.ts", "export async function GET(r) {}")[0]["path"] == "/api/users"
    assert joined("", "") == "/" and joined("a/", "/b") == "/a/b" and joined("", "x") == "/x" and joined("/", "/") == "/" and next_path("x/y.ts") == "/y.ts"
