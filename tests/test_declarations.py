"""Headers over several lines, generics, annotations, and what only looks like a declaration."""

import pytest

from stratograph.parsing import parse_file
from stratograph.parsing import braced


def symbols(path, text):
    return {s["name"]: s for s in parse_file(path, text).symbols}


def kinds(path, text):
    return [(c["name"], c["kind"]) for c in parse_file(path, text).classes]


def test_java_headers():
    text = """package p;
@Service
public final class Box<T extends Map<String, List<T>>> implements A, B {
  @Override
  @Cached(keys = {"a(", "b"}, size = 3)
  public static <K, V extends Comparable<V>> Map<K, List<V>> sort(
      final Map<K, V> in,
      @Nullable Order order)
      throws IOException, Broken {
    if (in == null) { return helper(in); }
    return new Box<>(in).run(order);
  }
  public int[] sizes() { return measure(); }
  public abstract void later(int x);
  private final Map<K, V> field = make(1);
  void hidden() { nothing(); }
  public Box(int x) { start(x); }
  public Runnable r() {
    return new Runnable() {
      @Override public void run() { inner(); }
    };
  }
}
record Point(int x, int y) {}
"""
    s = symbols("s/Box.java", text)
    assert set(s) == {"sort", "sizes", "later", "r", "run"}
    assert s["sort"]["calls"] == ["helper", "run"]
    assert (s["sort"]["line_start"], s["sort"]["line_end"]) == (6, 12) and s["sort"]["signature"] == "Map<K, List<V>> sort(final Map<K, V> in, @Nullable Order order)"
    assert s["sizes"]["signature"] == "int[] sizes()" and s["sizes"]["calls"] == ["measure"] and s["later"]["calls"] == []
    assert kinds("s/Box.java", text) == [("Box", "class"), ("Point", "record")]
    assert s["sort"]["parent_id"].endswith(":Point")  # members belong to the last type of the file
    assert s["run"]["calls"] == ["inner"]


def test_kotlin_headers():
    text = "package p\nimport a.B as C\nsealed class S\n@Inject\ninternal suspend inline fun <reified T : Any> List<T>.pick(\n  first: (Int) -> Unit,\n  n: Int = other(2)\n): Map<String, T>? {\n  first(n)\n  return helper(n)\n}\nfun short(x: Int): Int = twice(x)\nfun next() = 1\nenum class E { A, B }\ncompanion object { }\n"
    s = symbols("s/a.kt", text)
    assert set(s) == {"pick", "short", "next"} and not s["pick"]["is_public"] and s["pick"]["signature"].endswith("): Map<String, T>?")
    assert s["pick"]["calls"] == ["first", "helper"] and (s["pick"]["line_start"], s["pick"]["line_end"]) == (5, 11)
    assert s["short"]["calls"] == ["twice"] and s["short"]["line_end"] == 12 and s["next"]["calls"] == []
    assert kinds("s/a.kt", text) == [("S", "sealed class"), ("E", "enum class")]


def test_csharp_headers():
    text = "global using X.Y;\nusing static A.B;\nusing Z = C.D;\nnamespace N.M;\npublic record struct R(int X);\n[Serializable]\npublic class A<T> where T : class, new()\n{\n  [HttpGet(\"x(\")]\n  public async Task<Dictionary<string, T?>> Go<K>(\n    int x,\n    K k) where K : struct\n  {\n    using (var f = Open(x)) { }\n    return Helper(x ?? 1);\n  }\n  public int Twice(int x) => Mul(x, 2);\n  int None(int x) { return x; }\n}\n"
    r = parse_file("s/a.cs", text)
    s = {x["name"]: x for x in r.symbols}
    assert set(s) == {"Go", "Twice"} and s["Go"]["calls"] == ["Open", "Helper"] and s["Go"]["signature"] == "Task<Dictionary<string, T?>> Go(int x, K k)"
    assert s["Twice"]["calls"] == ["Mul"] and s["Twice"]["line_end"] == 17
    assert [i["module_spec"] for i in r.imports] == ["X.Y", "A.B", "C.D"] and ("A", "class") in kinds("s/a.cs", text)


def test_swift_php_rust_headers():
    s = symbols("s/a.swift", "@testable import class Foo.Bar\npublic final class A<T: P> {\n  private func hide() { a() }\n  @discardableResult\n  public static func make<K: Hashable>(\n    _ k: K,\n    then: @escaping (Int) -> Void\n  ) async throws -> [K: T] where K: P {\n    guard ok(k) else { return [:] }\n    return build(k)\n  }\n}\nprotocol P {\n  func need(x: Int) -> Int\n  func more()\n}\n")
    assert set(s) == {"hide", "make", "need", "more"} and not s["hide"]["is_public"] and s["make"]["calls"] == ["ok", "build"] and s["make"]["signature"].endswith("-> [K: T]")
    assert s["need"]["calls"] == [] and s["need"]["parent_id"].endswith(":P") and s["need"]["line_end"] == 14
    s = symbols("s/a.php", "<?php\nnamespace A\\B;\nuse function X\\f;\nfinal class C extends D\n{\n  #[Route('/x')]\n  public static function &go(\n    array $x = [1, 2],\n    ?int $y = null\n  ): ?array\n  {\n    $f = function ($a) use ($x) { return inner($a); };\n    return helper($x);\n  }\n  abstract protected function none(): int;\n}\n")
    assert set(s) == {"go", "none"} and s["go"]["calls"][-2:] == ["inner", "helper"] and s["go"]["signature"].endswith("): ?array") and not s["none"]["is_public"]
    text = "pub(crate) use crate::a::{\n  B, C,\n};\npub struct A<'a, T: Clone>(&'a T);\nimpl<'a, T: Clone> fmt::Display for A<'a, T> {\n  pub(crate) async unsafe fn show<'b, F: Fn(i32) -> i32>(\n    &self,\n    f: F,\n  ) -> Result<Vec<T>, E>\n  where\n    T: Send,\n  {\n    fn nested(x: i32) -> i32 { deep(x) }\n    match f(1) { _ => run(2) }\n  }\n  fn plain(&self);\n}\n"
    s = symbols("s/a.rs", text)
    assert set(s) == {"show", "nested", "plain"} and s["show"]["is_public"] and not s["plain"]["is_public"] and s["show"]["calls"] == ["f", "run"] and s["nested"]["calls"] == ["deep"]
    assert s["show"]["signature"].endswith("-> Result<Vec<T>, E>") and s["show"]["parent_id"].endswith(":A") and kinds("s/a.rs", text) == [("A", "struct")]


def test_c_headers():
    text = '#define MAX(a, b) ((a) > (b))\n#include <a/b.h>\n# include "c.h"\nstruct S { int x; };\nstruct S *find(\n    const char *name,\n    int (*cmp)(int, int))\n{\n  struct S *s = look(name);\n  if (s) return grow(s);\n  return 0;\n}\ntemplate <class T> class V : public B {\n public:\n  virtual std::vector<T> all() const override { return list(); }\n  int count() const;\n};\nstd::string V::name(int x) const\n{\n  return text(x);\n}\nstatic inline int twice(int x) { return mul(x); }\nenum class E { A };\nint x = call(3);\nMACRO(y)\n'
    s = symbols("s/a.cpp", text)
    assert set(s) == {"find", "all", "count", "name", "twice"} and s["find"]["calls"] == ["look", "grow"] and s["name"]["parent_id"].endswith(":V")
    assert kinds("s/a.cpp", text) == [("S", "struct"), ("V", "class")] and s["all"]["signature"] == "std::vector<T> all()" and s["count"]["calls"] == []
    assert [i["module_spec"] for i in parse_file("s/a.cpp", text).imports] == ["a/b.h", "c.h"]


@pytest.mark.parametrize("limit,calls", [(0, 400), (150, 149)])
def test_long_bodies_are_read_to_the_end(limit, calls):
    text = "fun f() {\n" + "".join(f"  c{i}()\n" for i in range(400)) + "}\n"
    got = braced.parse("a.kt", text, "", "d", "kotlin", max_body=limit).symbols[0]
    assert len(got["calls"]) == calls and got["line_end"] == (402 if limit == 0 else 150)


def test_ecma_heads():
    text = """import def, { a as b, type C } from './x';
import * as ns from "y";
import 'side';
export default abstract class A<T extends { k: string }> extends B<T> implements C, D<E> {
  #n: Map<string, number> = new Map();
  static async *walk<K>(
    id: K,
    opts: { deep: boolean } = {},
  ): AsyncGenerator<K> {
    yield go(id);
  }
  if(x) { no(); }
}
interface I<T> extends J, K<T> {
  id: string;
  run(x: T): void;
}
export const load: Loader<string> = async <T,>(x: T): Promise<T> => {
  return fetchIt(x);
};
const plain = (1 + 2);
async function util<T>(
  a: T
): Promise<T> {
  return other(a);
}
"""
    r = parse_file("s/a.ts", text)
    s = {x["name"]: x for x in r.symbols}
    assert [(i["module_spec"], i["names"]) for i in r.imports] == [("./x", ["def", "b", "C"]), ("y", ["ns"]), ("side", [])]
    assert r.classes[0]["bases"] == ["B", "C", "D<E>"] and r.classes[0]["field_signatures"] == ["#n: Map<string, number>"] and r.classes[1]["bases"] == ["J", "K<T>"]
    assert set(s) == {"A.walk", "load", "util"} and s["A.walk"]["calls"] == ["go"] and s["load"]["calls"] == ["fetchIt"] and s["util"]["calls"] == ["other"] and (s["util"]["line_start"], s["util"]["line_end"]) == (22, 26)
