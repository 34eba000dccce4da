import pytest

from stratograph.llm import written as w

MODULE = "id string, path string, language string, loc int, sha string, docstring string, domain string, exports array<string>, rank int"
SYMBOL = "id string, file_path string, code string, line_end int"


def tables(spark, modules, symbols=(), classes=(), files=(), vendored=()):
    return (spark.createDataFrame([(f"file:{p}" if p else None, p, lang, loc, sha, doc, "d", [], 1) for p, lang, loc, sha, doc in modules], MODULE), spark.createDataFrame(list(symbols), SYMBOL),
            spark.createDataFrame(list(classes), "file_path string, line_end int"), spark.createDataFrame(list(files), "path string, size long"), spark.createDataFrame(list(vendored), "sha string"))


def reasons(*tables):
    return {r["id"][5:]: r["reason"] for r in w.unwritten_modules(w.module_evidence(*tables)).collect()}


HAND = [("a/x/w/services/s.py", "python", 40, "aa", "Generates the monthly report from the ledger."), ("a/x/w/vendors/v.py", "Python ", 12, "bb", None), ("a/x/w/util/big.go", "go", 5900, "cc", "Hand-written front end of the code generator."), ("a/x/w/jobs/min_heap.js", "javascript", 2, None, None), ("a/x/w/n.py", None, None, None, None)]
CODE = "def f(a):\n    if a:\n        return g(a, 'x')\n    return 2\n"


def test_reasons(spark):
    modules = HAND + [
        ("a/x/w/assets/app.js", "javascript", 2, "d1", None), ("a/x/w/k.min.js", "javascript", 1, "d2", None), ("a/x/w/m.pb.go", "go", 500, "d3", None), ("a/x/w/n2.ts", "typescript", 9000, "d4", "Code generated by tool. DO NOT EDIT."),
        ("a/x/w/autogen/o.rs", "rust", 100, "d5", ""), ("a/x/w/third_party/lib/p.c", "c", 90, "d6", None), ("a/x/w/q.py", "python", 300, "ABCD", None), ("a/x/w/tables/r.py", "python", 40000, "d7", None)]
    files = [("a/x/w/assets/app.js", 150000), ("a/x/w/jobs/min_heap.js", 60), ("a/x/w/services/s.py", 1200), ("a/x/w/util/big.go", 200000), ("a/x/w/tables/r.py", 900000), ("a/x/w/services/s.py", None)]
    symbols = [("s1", "a/x/w/services/s.py", CODE, 38), ("s1", "a/x/w/services/s.py", CODE, 36), ("s2", "a/x/w/util/big.go", "func f() {\n}\n", 80), ("s3", "a/x/w/util/big.go", None, None), (None, None, None, None)]
    t = tables(spark, modules + modules + [(None, None, None, None, None)], symbols, [("a/x/w/services/s.py", 39)], files, [("abcd",), (None,)])
    assert reasons(*t) == {"a/x/w/assets/app.js": "minified", "a/x/w/k.min.js": "minified", "a/x/w/m.pb.go": "generated", "a/x/w/n2.ts": "generated", "a/x/w/autogen/o.rs": "generated", "a/x/w/third_party/lib/p.c": "vendored", "a/x/w/q.py": "vendored", "a/x/w/tables/r.py": "data"}
    assert reasons(*[x.limit(0) for x in t]) == {}


@pytest.mark.parametrize("code,found,canonical", [("", 0, 0), ("a();b();c();", 1, 3), ("a();\nb();\n", 2, 2), ("if (x) { y('a;b'); }", 1, 3), ("f(\n  1,\n  2\n)\n", 4, 1), ("'unclosed", 1, 1)])
def test_layout(code, found, canonical):
    got = w.layout(code)
    assert (got[0], got[1]) == (found, canonical)


def test_long_text_is_lexed_in_time():
    assert w.layout("x = '" + "a" * 500_000 + "'; " + "f(1);" * 50_000)[1] == 50_001


def test_uniform_symbols_and_believed_headers(spark):
    """Layout decides: uniform symbols without any mark are generated; a header is not believed of a file that is mostly laid-out code."""
    modules = [("u/uniform.ts", "typescript", 90, "e1", None), ("u/hand.ts", "typescript", 90, "e2", "Generated leads. Counts those of a month."), ("u/bare.ts", "typescript", 900, "e3", "Generated from the model."), ("u/tiny.ts", "typescript", 8, "e4", "Tests the code generator.")]
    one = "export function get{0}(x: string) {{\n  return call('{0}', x, {1});\n}}\n"
    other = ["if (a) { b(); }\n", "for (;;) { c(); }\nd();\n", "return [1, 2];\n", "let x = 1;\nlet y = 2;\nz(x, y);\n", "while (a) b();\n", "switch (a) { case 1: b(); }\n", "try { a(); } catch (e) { b(); }\n", "a = b ? c : d;\n", "x.y.z();\n"]
    symbols = [(f"u{i}", "u/uniform.ts", one.format(i, i * 7), 10 * i) for i in range(1, 10)] + [(f"h{i}", "u/hand.ts", f"function f{i}() {{\n{body}}}\n", 10 * i) for i, body in enumerate(other, 1)] + [("b1", "u/bare.ts", other[0], 20)]
    t = tables(spark, modules, symbols, [], [(m[0], m[2] * 34) for m in modules])
    assert reasons(*t) == {"u/uniform.ts": "generated", "u/bare.ts": "generated"}
    off = list(t)
    off[1] = t[1].withColumn("code", t[1]["code"].substr(1, 0))  # nothing lexed
    assert reasons(*off) == {"u/hand.ts": "generated", "u/bare.ts": "generated"}
