"""TypeScript and JavaScript, and components whose scripts are written in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from stratograph.parsing.declarations import Tokens
from stratograph.parsing.source import Parsed, Source, call_sites, class_row, module_row, symbol_row

CALL = re.compile(r"([\w$]+)\s*\(")
_TAG = re.compile(r"<([A-Z]\w*)")
_NESTED = re.compile(r"\bfunction\s")
_COMPONENT = re.compile(r"@Component\b")
# Words that look like calls or methods, words and signs that branch.
_NO_CALLS = frozenset("if for while switch catch return new typeof React".split())
_NO_METHODS = _NO_CALLS | frozenset("function else do try super throw await yield delete".split())
_BRANCHES = frozenset(["if", "while", "for", "catch", "switch", "case", "&&", "||", "?"])


def complexity(lines: list[str]) -> int:
    """One plus branch words and signs that stand alone between white space; ``if(`` without a blank is none of them."""
    return 1 + sum(w.strip("{};:,()") in _BRANCHES for line in lines if not line.strip().startswith(("//", "/*")) for w in line.split())


def _tags(src: Source, spans: list[tuple[int, str]], own: str, have: set[str]) -> list[tuple[str, int]]:
    found: dict[str, int] = {}
    for line, piece in spans:
        for m in _TAG.finditer(piece):
            if m.group(1) != own and m.group(1) not in have and m.group(1) not in _NO_CALLS:
                found.setdefault(m.group(1), line + 1)
    return list(found.items())


def _open_brace(src: Source, at: int) -> int:
    """Offset of the brace that opens the body behind a parameter list, or -1. Braces of type literals are stepped over."""
    depth, i = 0, at
    while i < len(src.bare):
        c = src.bare[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth == 0 and c == ";":
            return -1
        elif depth == 0 and c == "{":
            if src.bare[at:i].rstrip()[-1:] not in ("<", ":", "|", "&", ","):
                return i
            i = src.closing(i) - 1
        i += 1
    return -1


# ---- heads ------------------------------------------------------------------------------------
_WORDS_BEFORE = frozenset("export default abstract async declare".split())
_BINDINGS = frozenset("const let var".split())
_MEMBER_WORDS = frozenset("public private protected static async override readonly abstract get set accessor declare".split())


@dataclass(frozen=True)
class Head:
    """The opening of a declaration: word and name, offsets of the name and behind the head, and what it says."""

    word: str
    name: str
    at: int
    end: int
    exported: bool
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)


def _first_on_line(t: Tokens, i: int) -> int:
    """Position of the first of the words that stand before i and belong to it; -1 if anything else stands on its line before them."""
    j = i
    while t.text(j - 1) in _WORDS_BEFORE:
        j -= 1
    return j if j == 0 or t.line(j - 1) != t.line(j) else -1


def _listed(t: Tokens, i: int, stops: tuple[str, ...]) -> tuple[list[str], int]:
    """Entries between commas from i up to a stop, as written, and where they end."""
    out, start, j = [], i, i
    while j < len(t):
        if t.text(j) in (",", *stops):
            out.append(t.between(start, j))
            start = j + 1
            if t.text(j) != ",":
                return [x for x in out if x], j
        j = t.behind(j) if t.text(j) in ("(", "[", "<") else j + 1
    return [x for x in out if x], j


def _heads(t: Tokens) -> Iterator[Head]:
    """Classes, interfaces, functions and arrow functions that begin a line."""
    for i, token in enumerate(t.all):
        word = token.text
        if word not in ("class", "interface", "function") and word not in _BINDINGS or (first := _first_on_line(t, i)) < 0:
            continue
        exported, j = t.text(first) == "export", i + 1
        if word == "function" and t.text(j) == "*":
            j += 1
        if not t.is_word(j) and t.text(j)[:1] != "$":
            continue
        name, at = t.text(j), t.all[j].at
        j = t.behind(j + 1) if t.text(j + 1) == "<" else j + 1
        if word == "function":
            if t.text(j) == "(":
                yield Head(word, name, at, t.all[j].end, exported)
        elif word in _BINDINGS:
            if (arrow := _arrow(t, j)) >= 0:
                yield Head("arrow", name, at, t.all[arrow].end, exported)
        else:
            extends, implements = [], []
            if t.text(j) == "extends":
                extends, j = _listed(t, j + 1, ("{", "implements"))
            if t.text(j) == "implements":
                implements, j = _listed(t, j + 1, ("{",))
            if t.text(j) == "{":
                yield Head(word, name, at, t.all[j].end, exported, extends, implements)


def _arrow(t: Tokens, i: int) -> int:
    """Position of the arrow of a function bound by ``= (...) =>``, -1 if something else is bound."""
    if t.text(i) == ":":  # the type of the variable, up to its equals sign
        i = t.until(i, ("=", ";"))
    if t.text(i) != "=":
        return -1
    i += 1 + (t.text(i + 1) == "async")
    if t.text(i) == "<":
        i = t.behind(i)
    if t.text(i) != "(":
        return -1
    i = t.behind(i)
    if t.text(i) == ":":
        i = t.until(i, ("=>", ";", "="))
    return i if t.text(i) == "=>" else -1


def _member(t: Tokens, i: int) -> tuple[list[str], str, int] | None:
    """(modifiers, name, position of the bracket) of a method that begins at i; None for other members."""
    mods = []
    while t.text(i) in _MEMBER_WORDS and (t.is_word(i + 1) or t.text(i + 1) in ("#", "*", "[") or t.text(i + 1)[:1] == "$"):
        mods.append(t.text(i))
        i += 1
    i += t.text(i) == "*"
    mark = "#" if t.text(i) == "#" else ""
    i += bool(mark)
    if not t.is_word(i) and t.text(i)[:1] != "$":
        return None
    j = t.behind(i + 1) if t.text(i + 1) == "<" else i + 1
    return (mods, mark + t.text(i), j) if t.text(j) == "(" else None


def _field(t: Tokens, i: int, last_line: int) -> str:
    """``name: type`` of a field that begins at i; '' for other members."""
    while t.text(i) in _MEMBER_WORDS and t.is_word(i + 1):
        i += 1
    mark = "#" if t.text(i) == "#" else ""
    i += bool(mark)
    j = i + 1 + (t.text(i + 1) in ("?", "!"))
    if not t.is_word(i) or t.text(j) != ":":
        return ""
    end = j + 1
    while end < len(t) and t.line(end) <= last_line and t.text(end) not in (";", "="):
        end = t.behind(end) if t.text(end) in ("(", "[", "{", "<") else end + 1
    return f"{mark}{t.text(i)}: {t.between(j + 1, end)}" if end > j + 1 else ""


def _imports(src: Source, t: Tokens) -> Iterator[tuple[str, list[str]]]:
    """(module, names) of each import; the name of a module is a string, so it is read from the text."""
    for i, token in enumerate(t.all):
        if token.text != "import" or i and t.line(i - 1) == t.line(i) and t.text(i - 1) != ";" or t.text(i + 1) in ("(", "."):
            continue
        j = i + 1 + (t.text(i + 1) == "type" and (t.is_word(i + 2) and t.text(i + 2) != "from" or t.text(i + 2) in ("{", "*")))
        names = []
        while j < len(t) and (t.is_word(j) or t.text(j) in ("{", "}", ",", "*") or t.text(j)[:1] == "$") and t.text(j) != "from":
            if t.text(j) not in ("{", "}", ",", "*", "type", "as") and t.text(j + 1) != "as":
                names.append(t.text(j))
            j += 1
        j += t.text(j) == "from"
        if t.text(j) in ("'", '"'):
            close = src.text.find(t.text(j), t.all[j].end)
            spec = src.text[t.all[j].end:close] if close > 0 else ""
            if spec and "\n" not in spec:
                yield spec, names


def parse(path: str, text: str, sha: str, domain: str, language: str) -> Parsed:
    src = Source(path, text, language)
    jsx = path.endswith((".tsx", ".jsx", ".js"))
    out = Parsed(module_row(path, text, sha, domain, language))
    tokens = Tokens(src)
    starts: dict[int, int] = {}  # line -> position of its first token
    for i in range(len(tokens)):
        starts.setdefault(tokens.line(i), i)
    for spec, names in _imports(src, tokens):
        out.imports.append({"source_file": path, "module_spec": spec, "names": names, "is_relative": spec.startswith(".")})
        out.module["import_paths"].append(spec)

    def add(name: str, kind: str, parent: str, first: int, last: int, head: str, public: bool, own: str) -> None:
        spans = [(i, src.bare_lines[i]) for i in range(first + 1, last + 1)]
        if last == first and "{" in src.bare_lines[first]:
            spans = [(first, src.bare_lines[first].partition("{")[2])]
        elif "=>" in src.bare_lines[first]:
            spans.insert(0, (first, src.bare_lines[first].partition("=>")[2]))
        calls = call_sites(src, spans, CALL, _NO_CALLS, own, _NESTED)
        if jsx:
            calls += _tags(src, [(i, src.bare_lines[i]) for i in range(first, last + 1)], own, {c for c, _ in calls})
        arrow = kind in ("function", "component") and "=>" in src.bare_lines[first] and "function" not in src.bare_lines[first]
        out.symbols.append(symbol_row(path, name, kind, parent, first + 1, last + 1, head, src.slice_lines(first, last), 1 if arrow else complexity(src.lines[first:last + 1]), [c for c, _ in calls], public))
        out.calls.extend({"caller_id": f"symbol:{path}:{name}", "called_name": c, "line_number": n} for c, n in calls)

    inside: list[tuple[int, int]] = []
    heads = list(_heads(tokens))
    for h in heads:
        if h.word == "class":
            name, first = h.name, src.line_of(h.at)
            end = src.closing(h.end - 1)
            last = src.line_of(end - 1)
            inside.append((h.end - 1, end))
            if h.exported:
                out.module["exports"].append(name)
            above = "\n".join(src.bare_lines[max(0, first - 8):first + 1])
            component = _COMPONENT.search(above[above.rfind("}\n\n") + 1:]) is not None
            class_id, fields, depth = f"class:{path}:{name}", [], 1
            j = src.line_of(h.end - 1) + 1
            while j < last:
                line = src.bare_lines[j]
                member = _member(tokens, starts[j]) if depth == 1 and j in starts else None
                if member and member[1] not in _NO_METHODS:
                    mods, method, bracket = member
                    brace = _open_brace(src, tokens.all[bracket].at)
                    if 0 <= brace < end:
                        stop = src.line_of(src.closing(brace) - 1)
                        head = re.sub(r"\s+", " ", text[src.start_of(j):brace]).strip()
                        hidden = method.startswith(("_", "#")) or "private" in mods
                        add(f"{name}.{method}", "method", class_id, j, stop, head, not hidden, method)
                        j = stop + 1
                        continue
                elif depth == 1 and j in starts and (told := _field(tokens, starts[j], j)):
                    fields.append(told)
                depth += line.count("{") - line.count("}")
                j += 1
            bases = [re.sub(r"<.*", "", b) if i == 0 and h.extends else b for i, b in enumerate([*h.extends, *h.implements])]
            out.classes.append(class_row(path, name, "component" if component else "class", h.exported, "@Component" if component else "", first + 1, last + 1, bases, fields))
    for h in heads:
        if h.word == "interface":
            first, end = src.line_of(h.at), src.closing(h.end - 1)
            inside.append((h.end - 1, end))
            if h.exported:
                out.module["exports"].append(h.name)
            members = [x.strip().rstrip(";,") for x in re.split(r"[\n;]", src.text[h.end:end - 1]) if x.strip()]
            row = class_row(path, h.name, "interface", h.exported, "", first + 1, src.line_of(end - 1) + 1, h.extends, [x for x in members if "(" not in x.partition(":")[0]])
            row["method_signatures"] = [x for x in members if "(" in x.partition(":")[0]]
            out.classes.append(row)

    top: list[tuple[int, int]] = []
    for word in ("function", "arrow"):
        for h in heads:
            if h.word != word or any(b < h.at < e for b, e in inside + top):
                continue
            first = src.line_of(h.at)
            if word == "function":
                brace = _open_brace(src, h.end - 1)
                end = src.closing(brace) if brace >= 0 else h.end
                head = text[src.start_of(first):brace if brace >= 0 else h.end]
            else:
                at = h.end + len(src.bare[h.end:]) - len(src.bare[h.end:].lstrip())
                opens = src.bare[at:at + 1]
                stop = src.bare.find("\n", h.end)
                end = src.closing(at, "{}" if opens == "{" else "()") if opens and opens in "{(" else stop if stop >= 0 else len(src.bare)
                head = text[src.start_of(first):h.end]
            top.append((h.at, end))
            if h.exported:
                out.module["exports"].append(h.name)
            add(h.name, "component" if h.name[0].isupper() else "function", f"file:{path}", first, src.line_of(max(end - 1, h.at)), re.sub(r"\s+", " ", head).strip(), h.exported or not h.name.startswith("_"), h.name)
    out.symbols.sort(key=lambda s: s["line_start"])
    return out.roll_up()


# ---- single-file components -------------------------------------------------------------------
_SCRIPT = re.compile(r"<script[^>]*>(.*?)</script>", re.I | re.S)
_STYLE = re.compile(r"<style[^>]*>.*?</style>", re.I | re.S)
_NAMED = re.compile(r"name\s*:\s*[\"'](\w+)[\"']")
_ELEMENT = re.compile(r"<([A-Za-z][\w-]*)")


def _references(markup: str) -> list[str]:
    """Elements of the template that are components: capitalised or with a hyphen, in PascalCase."""
    out = {}
    for m in _ELEMENT.finditer(markup):
        tag = m.group(1)
        if tag[0].isupper():
            out[tag] = None
        elif "-" in tag:
            out["".join(x.capitalize() for x in tag.split("-"))] = None
    return list(out)


def parse_component(path: str, text: str, sha: str, domain: str, language: str) -> Parsed:
    """Vue and Svelte: all scripts as one, with lines counted within it; a component node; the components of the template join the exports."""
    script = "\n".join(m.group(1) for m in _SCRIPT.finditer(text))
    out = parse(path, script, sha, domain, "typescript")
    stem = path.rpartition("/")[2].rpartition(".")[0]
    given = _NAMED.search(script)
    name = given.group(1) if given else stem
    doc = f"{language.capitalize()} component {name} in {path}"
    out.module |= {"language": language, "docstring": doc}
    row = class_row(path, name, "component", docstring=doc)
    row["method_signatures"] = [s["signature"] for s in out.symbols if s["parent_id"] == out.module["id"] and s["signature"]]
    out.classes.insert(0, row)
    out.module["exports"] = list(dict.fromkeys(out.module["exports"] + _references(_STYLE.sub("", _SCRIPT.sub("", text)))))
    return out
