"""Go: declarations found at brace depth zero of the blanked text."""

from __future__ import annotations

import re

from stratograph.parsing.source import Parsed, Source, class_row, module_row, symbol_row

CALL = re.compile(r"(?<![\w.])(?:[\w.]+\.)?(\w+)\s*\(")
_PACKAGE = re.compile(r"^package\s+\w+", re.M)
_FUNC = re.compile(r"^func\s*(?:\(\s*(?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", re.M)
_TYPE = re.compile(r"^(?:type\s+)(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<what>=?\s*[^\n{]*\{?)", re.M)
_TYPES = re.compile(r"^type\s*\(", re.M)
# Words that look like calls.
_NO_CALLS = frozenset("if for switch select return func go defer range case var type map chan struct interface".split())
_BUILTIN = frozenset("append cap close complex copy delete imag len make new panic print println real recover string int int8 int16 int32 int64 uint byte rune float32 float64 bool error min max clear".split())


def complexity(body: str) -> int:
    """One plus if, for, each case and default, and each && and ||."""
    return 1 + len(re.findall(r"\b(?:if|for|case)\b|\bdefault\s*:|&&|\|\|", body))


def _comment_above(src: Source, line: int) -> str:
    first = line
    while first > 0 and src.lines[first - 1].lstrip().startswith("//"):
        first -= 1
    if first < line:
        return "\n".join(re.sub(r"^\s*// ?", "", x) for x in src.lines[first:line]).strip()
    if line > 0 and src.lines[line - 1].rstrip().endswith("*/"):
        begin = src.text.rfind("/*", 0, src.start_of(line))
        return "\n".join(x.strip(" \t*") for x in src.text[begin + 2:src.text.rfind("*/", 0, src.start_of(line))].split("\n")).strip()
    return ""


def _parameters(text: str) -> list[str]:
    """``a, b int, c ...string`` as one entry per name, each with its type."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            if text[at:i].strip():
                parts.append(" ".join(text[at:i].split()))
            at = i + 1
    if not any(" " in p for p in parts):
        return parts
    out, kind = [], ""
    for p in reversed(parts):
        name, _, own = p.partition(" ")
        kind = own or kind
        out.append(f"{name} {kind}".strip())
    return out[::-1]


def parse(path: str, text: str, sha: str, domain: str, language: str = "go") -> Parsed:
    src = Source(path, text, "go")
    package = _PACKAGE.search(src.bare)
    out = Parsed(module_row(path, text, sha, domain, "go", _comment_above(src, src.line_of(package.start())) if package else ""))
    if package is None or any(src.bare.count(a) != src.bare.count(b) for a, b in ("{}", "()")):
        return out  # no package clause, or brackets that do not close: the file does not compile
    plain = re.sub(r"\"[^\"\n]*\"|`[^`]*`", lambda m: m.group(), text)
    for m in re.finditer(r"^import\s*(?:\((?P<many>[^)]*)\)|(?P<alias>[\w.]+\s+)?\"(?P<one>[^\"]+)\")", src.bare, re.M):
        for x in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", plain[m.start():m.end()]):
            alias = x.group(1) if x.group(1) not in (None, "import") else None
            out.imports.append({"source_file": path, "module_spec": x.group(2), "names": [alias or x.group(2).rpartition("/")[2]], "is_relative": False})
            out.module["import_paths"].append(x.group(2))

    def type_row(name: str, at: int, what: str, brace: int) -> None:
        first = src.line_of(at)
        end = src.closing(brace) if brace >= 0 else src.start_of(first) + len(src.lines[first])
        kind = "struct" if re.match(r"=?\s*struct\b", what) else "interface" if re.match(r"=?\s*interface\b", what) else "type"
        bases, fields, methods = [], [], []
        if brace >= 0 and kind != "type":
            for raw in src.text[brace + 1:end - 1].split("\n"):
                line = re.sub(r"//.*|`[^`]*`", "", raw).strip()
                if not line:
                    continue
                if kind == "interface" and "(" in line:
                    methods.append(line)
                elif re.fullmatch(r"\*?[\w.]+(?:\[[^\]]*\])?", line):
                    bases.append(line.lstrip("*"))
                elif kind == "struct" and (f := re.match(r"((?:\w+\s*,\s*)*\w+)\s+(.+)", line)):
                    fields += [f"{x.strip()}: {f.group(2).strip()}" for x in f.group(1).split(",")]
        if name[0].isupper():
            out.module["exports"].append(name)
        row = class_row(path, name, kind, name[0].isupper(), _comment_above(src, first), first + 1, src.line_of(end - 1) + 1, bases, fields)
        row["method_signatures"] = methods
        out.classes.append(row)

    for m in _TYPE.finditer(src.bare):
        brace = src.bare.find("{", m.start("what"), m.end()) if re.match(r"=?\s*(?:struct|interface)\b", m.group("what")) else -1
        type_row(m.group("name"), m.start(), m.group("what"), brace)
    for m in _TYPES.finditer(src.bare):
        end = src.closing(src.bare.index("(", m.start()), "()")
        at = m.end()
        one = re.compile(r"^[ \t]*(\w+)(?:\[[^\]]*\])?\s+(=?\s*[^\n{]+)(\{?)", re.M)
        while (x := one.search(src.bare, at, end - 1)):
            brace = x.start(3) if x.group(3) and re.match(r"=?\s*(?:struct|interface)\b", x.group(2)) else -1
            type_row(x.group(1), x.start(1), x.group(2), brace)
            at = src.closing(brace) if brace >= 0 else x.end()
    for m in _FUNC.finditer(src.bare):
        first = src.line_of(m.start())
        close = src.closing(m.end() - 1, "()")
        rest = re.compile(r"\s*(?:\([^)]*\)|[^\n{]*?)\s*(\{|\n|\Z)").match(src.bare, close)
        has_body = bool(rest and rest.group(1) == "{")
        end = src.closing(rest.start(1)) if has_body else close
        last = src.line_of(end - 1)
        name, recv = m.group("name"), (m.group("recv") or "").strip()
        owner = re.sub(r"\[.*", "", recv.split()[-1].lstrip("*")) if recv else ""
        full = f"{owner}.{name}" if owner else name
        results = " ".join(text[close:rest.start(1) if rest else close].split())
        params = _parameters(" ".join(text[m.end():close - 1].split()))
        signature = "func " + (f"({recv}) " if recv else "") + f"{name}({', '.join(params)})" + (f" {results}" if results else "")
        body, shift = (src.bare[rest.start(1):end], rest.start(1)) if has_body else ("", 0)
        calls: dict[str, int] = {}
        for c in CALL.finditer(body):
            if c.group(1) not in _NO_CALLS and c.group(1) not in _BUILTIN and c.group(1) != name:
                calls.setdefault(c.group(1), src.line_of(shift + c.start(1)) + 1)
        public = name[0].isupper()
        if public and not owner:
            out.module["exports"].append(name)
        out.symbols.append(symbol_row(path, full, "method" if owner else "function", f"class:{path}:{owner}" if owner else f"file:{path}", first + 1, last + 1, signature, src.slice_lines(first, last), complexity(body), list(calls), public, _comment_above(src, first), params))
        out.calls.extend({"caller_id": f"symbol:{path}:{full}", "called_name": c, "line_number": n} for c, n in calls.items())
    return out.roll_up()
