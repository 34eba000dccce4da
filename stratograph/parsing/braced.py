"""Java, Kotlin, C#, Swift, PHP, Rust and C/C++: one reader of declarations, one description per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from stratograph.parsing.declarations import Function, Tokens
from stratograph.parsing.source import MAX_BODY, Parsed, Source, call_sites, class_row, module_row, symbol_row

CALL = re.compile(r"\b(\w+)\s*\(")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


@dataclass(frozen=True)
class Language:
    """The words of a language and how its headers are laid out."""

    title: str
    kind: str  # of functions
    types: frozenset[str]
    modifiers: frozenset[str]
    no_calls: frozenset[str]
    branches: tuple[str, ...]
    joints: tuple[str, ...]
    imports: str = "import"
    package: str = ""
    function: str = ""  # the word that opens a function; without one a function is a type, a name and parameters
    result: str = ""  # the mark before the result
    lines_end: bool = False  # a line break ends a statement
    two_words: frozenset[str] = frozenset()  # words that make a kind of type together with the next
    needs_modifier: bool = False
    hidden: frozenset[str] = frozenset()  # modifiers of what is not public
    shown: frozenset[str] = frozenset()  # modifiers without which nothing is public
    nested: bool = True  # functions within functions are looked for, and the lines of their headers give no calls
    last_type: bool = False  # members belong to the last type of the file, not to the nearest above


# Words of the languages, words before a bracket that are no calls, marks of branches and joints.
LANGUAGES: dict[str, Language] = {
    "java": Language("Java package", "method", _set("class interface enum record"), _set("public protected private static final abstract synchronized native default strictfp sealed"),
                     _set("if for while switch catch return new throw"), ("if ", "for ", "while ", "case ", "catch "), (" && ", " || "), package="package", needs_modifier=True, shown=_set("public"), last_type=True),
    "kotlin": Language("Kotlin package", "function", _set("class interface object"), _set("public private protected internal open override abstract suspend inline tailrec operator infix external final annotation inner value data sealed enum expect actual"),
                       _set("if for while when return fun class super this"), ("if ", "when ", "for ", "while ", "catch "), (" && ", " || "), package="package", function="fun", result=":", lines_end=True,
                       two_words=_set("data sealed enum"), hidden=_set("private internal")),
    "csharp": Language("C# namespace", "method", _set("class interface enum struct record"), _set("public private protected internal static virtual override async sealed abstract extern new partial readonly unsafe required"),
                       _set("if for foreach while switch catch using lock return new"), ("if ", "for ", "foreach ", "while ", "switch ", "catch "), (" && ", " || ", " ?? "), imports="using", package="namespace", needs_modifier=True, shown=_set("public")),
    "swift": Language("Swift module", "function", _set("class struct enum protocol extension"), _set("public private fileprivate internal open override static class final mutating nonmutating required convenience indirect"),
                      _set("if for while guard switch return func init self"), ("if ", "guard ", "for ", "while ", "switch ", "catch "), (" && ", " || ", " ?? "), function="func", result="->", lines_end=True, hidden=_set("private fileprivate")),
    "php": Language("PHP namespace", "function", _set("class interface trait enum"), _set("public protected private static final abstract readonly"),
                    _set("if for foreach while switch return function echo isset empty"), ("if ", "for ", "foreach ", "while ", "switch ", "catch "), (" && ", " || ", " ?? "), imports="use", package="namespace", function="function", result=":",
                    hidden=_set("private protected")),
    "rust": Language("Rust module", "function", _set("struct enum trait union"), _set("pub async const unsafe extern default"),
                     _set("if match for while return let use"), ("if ", "match ", "for ", "while "), (" && ", " || "), imports="use", function="fn", result="->", shown=_set("pub")),
    "c": Language("file", "function", _set("class struct"), _set("static inline virtual explicit constexpr extern friend"),
                  _set("if for while switch catch return sizeof defined new delete"), ("if ", "for ", "while ", "case ", "catch "), (" && ", " || "), nested=False),
}
LANGUAGES["cpp"] = LANGUAGES["c"]

#: Words that can stand where a type might, but never name one.
_NO_TYPE = _set("return new else throw case do goto delete await yield typedef using namespace operator where in is as and or not if while for switch")
#: What may stand between the parameters of a function and its body, where no word opens it.
_TAILS = {"java": _set("throws default"), "csharp": _set("where"), "c": _set("const override noexcept final volatile try throw & && -> = requires"), "cpp": _set("const override noexcept final volatile try throw & && -> = requires")}


# ---- imports ----------------------------------------------------------------------------------
def _spec(language: str, words: str) -> str:
    """The module an import statement names, from the text behind its word; '' where the statement imports nothing."""
    words = " ".join(words.split())
    if language == "rust":
        return words
    if language == "swift":
        parts = words.split(" ")
        return (parts[1] if len(parts) > 1 and parts[0] in ("class", "struct", "enum", "protocol", "func", "var", "let", "typealias") else parts[0]).partition(".")[0]
    parts = words.split(" ")
    while parts and parts[0] in ("static", "function", "const"):
        parts = parts[1:]
    if language == "csharp" and len(parts) == 3 and parts[1] == "=":
        parts = parts[2:]
    plain = bool(parts) and not set(parts[0]) & set("({$=<") and (len(parts) == 1 or parts[1] == "as")
    return parts[0] if plain else ""


def _import_row(language: str, path: str, spec: str) -> tuple[dict, str]:
    if language in ("c", "cpp"):
        names, relative = [spec.rpartition("/")[2]], not spec.startswith("sys/") and "std" not in spec
    elif language == "rust":
        names, relative = [spec.rpartition("::")[2]], spec.startswith(("crate::", "super::", "self::"))
        spec = spec.replace("::", "/")
    else:
        names, relative = [spec.rpartition("\\" if language == "php" else ".")[2]], False
    return {"source_file": path, "module_spec": spec, "names": names, "is_relative": relative}, spec


def _imports(tokens: Tokens, lang: Language, language: str) -> Iterator[str]:
    src = tokens.src
    if language in ("c", "cpp"):
        for i, line in enumerate(src.lines):
            head, _, rest = line.strip().partition("include")
            if head.replace(" ", "") == "#" and src.bare_lines[i].strip().startswith("#"):
                name = rest.strip()
                close = {'"': '"', "<": ">"}.get(name[:1])
                if close and name.find(close, 1) > 1:
                    yield name[1:name.find(close, 1)]
        return
    for i, t in enumerate(tokens.all):
        starts = i == 0 or tokens.text(i - 1) in (";", "{", "}") or tokens.line(i) != tokens.line(i - 1) or tokens.text(i - 1) in lang.modifiers or tokens.text(i - 1) in ("testable", "global", ")", "php")
        if t.text == lang.imports and starts:
            end = tokens.until(i + 1, (";",), same_line=lang.lines_end)
            stop = tokens.all[end - 1].end if end > i + 1 else t.end
            if spec := _spec(language, src.text[t.end:stop]):
                yield spec


def _package(tokens: Tokens, lang: Language) -> str:
    for i, t in enumerate(tokens.all):
        if lang.package and t.text == lang.package and tokens.is_word(i + 1) and (i == 0 or tokens.line(i) != tokens.line(i - 1) or tokens.text(i - 1) in (";", "}", "php")):
            j = i + 1
            while tokens.is_word(j) or tokens.text(j) in (".", "\\"):
                if tokens.is_word(j) and tokens.is_word(j - 1) and j > i + 1:
                    break
                j += 1
            return tokens.between(i + 1, j)
    return ""


# ---- types ------------------------------------------------------------------------------------
def _types(tokens: Tokens, lang: Language, language: str) -> Iterator[tuple[int, str, str]]:
    """(offset, kind, name) of each type."""
    for i, t in enumerate(tokens.all):
        if t.text not in lang.types or not tokens.is_word(i + 1) or tokens.text(i + 1) in lang.types or tokens.text(i + 1) in _NO_TYPE or tokens.text(i + 1) == lang.function and lang.function or tokens.text(i + 1) in lang.modifiers and language == "swift":
            continue
        left, after = tokens.text(i - 1), tokens.text(i + 2)
        if left in (".", "::", ":", ",", "<", "(") or language in ("c", "cpp") and (left in ("enum", "friend", "typedef") or after not in ("{", ":", ";", "final")):
            continue
        if t.text in ("record", "union", "trait", "extension", "object") and after and after not in ("{", "(", "<", ":", ";", "extends", "implements", "permits", "where", "=") and tokens.line(i + 2) == tokens.line(i + 1):
            continue
        two = left in lang.two_words
        yield t.at, f"{left} {t.text}" if two else t.text, tokens.text(i + 1)


def _implementations(tokens: Tokens) -> Iterator[tuple[int, str]]:
    """(offset, type) of each block that adds to a type."""
    for i, t in enumerate(tokens.all):
        if t.text == "impl" and tokens.text(i - 1) in ("", ";", "{", "}", "]", "unsafe", "default"):
            j = tokens.behind(i + 1) if tokens.text(i + 1) == "<" else i + 1
            stop = tokens.until(j, ("{", ";", "where"))
            k = next((x + 1 for x in range(j, stop) if tokens.text(x) == "for" and tokens.text(x + 1) != "<"), j)
            names = []
            while k < stop and tokens.text(k) != "<":
                names += [tokens.text(k)] if tokens.is_word(k) else []
                k += 1
            if names:
                yield t.at, names[-1]


# ---- functions --------------------------------------------------------------------------------
def _finish(tokens: Tokens, lang: Language, name: str, mods: list[str], first: int, opens: int, owner: str = "", result: str = "") -> Function:
    """Read on behind the name: parameters, result, and body, expression or nothing."""
    src, close = tokens.src, tokens.behind(opens)
    params = tokens.between(opens + 1, close - 1)
    at, stops = close, ("{", ";", "=>", "=", "}") if lang.result != "->" else ("{", ";", "}")
    if lang.result:
        mark = tokens.until(at, (lang.result, *stops), same_line=lang.lines_end)
        if tokens.text(mark) == lang.result:
            at = tokens.until(mark + 1, (*stops, "where"), same_line=lang.lines_end)
            result = tokens.between(mark + 1, at)
    end = tokens.until(at, stops, same_line=lang.lines_end)
    if lang.lines_end and tokens.text(end) == "where":
        end = tokens.until(end, stops)
    head = max(close - 1, end - 1)
    made = Function(name, mods, params, result, tokens.line(first), tokens.line(head), tokens.all[first].at, None, tokens.all[min(head, len(tokens) - 1)].end, owner)
    mark = tokens.text(end)
    if mark == "{":
        begin = tokens.all[end].at
        made.body, made.head_end_line = (begin, src.closing(begin)), tokens.line(end)
        made.end = made.body[1]
    elif mark in ("=", "=>") and (lang.function or mark == "=>"):
        stop = tokens.until(end + 1, (";", "}"), same_line=lang.lines_end)
        last = tokens.all[max(end, stop - 1)].end
        made.body, made.end, made.expression = (tokens.all[end].end, last), last, True
    elif mark == ";":
        made.end = tokens.all[end].end
    return made


def _with_word(tokens: Tokens, lang: Language) -> Iterator[Function]:
    """Functions that a word opens: the word, type parameters, a receiver, the name, parameters."""
    for i, t in enumerate(tokens.all):
        if t.text != lang.function or tokens.text(i - 1) in (".", "::"):
            continue
        j = i + 1
        if tokens.text(j) == "<":
            j = tokens.behind(j)
        if tokens.text(j) == "&":
            j += 1
        name = ""
        while tokens.is_word(j) or tokens.text(j) in (".", "<", "?"):
            if tokens.text(j) == "<":
                j = tokens.behind(j)
                continue
            name = tokens.text(j) if tokens.is_word(j) else name
            j += 1
        if name and tokens.text(j) == "(" and name not in lang.types:
            yield _finish(tokens, lang, name, tokens.words_before(i, lang.modifiers), i, j)


def _typed_left(tokens: Tokens, i: int) -> int:
    """First position of the modifiers, annotations and type that stand before the name at i."""
    j = i - 1
    while j >= 0:
        t = tokens.text(j)
        if t in (">", "]"):
            k = tokens.before(j, "<" if t == ">" else "[", t)
            if k < 0:
                break
            j = k - 1
        elif tokens.all[j].is_word or t in (".", "::", "*", "&", "?", "@"):
            j -= 1
        else:
            break
    return j + 1


def _without_word(tokens: Tokens, lang: Language, language: str) -> Iterator[Function]:
    """Functions told by their shape: modifiers, a type, a name, parameters, and a body or its absence."""
    skip, line_starts = -1, language in ("c", "cpp")
    for i, t in enumerate(tokens.all):
        at = tokens.before(i - 1, "<", ">") - 1 if language == "csharp" and tokens.text(i - 1) == ">" else i - 1
        if t.text != "(" or t.at < skip or not tokens.is_word(at) or tokens.text(at) in lang.no_calls:
            continue
        name, owner = tokens.text(at), ""
        while line_starts and tokens.text(at - 1) == "::" and tokens.is_word(at - 2):
            owner, at = owner or tokens.text(at - 2), at - 2
        first = _typed_left(tokens, at)
        if line_starts:  # a directive has no end but that of its line
            directive = next((k for k in range(at, first - 1, -1) if tokens.text(k - 1) == "#"), None)
            if directive is not None:
                while first < at and tokens.line(first) == tokens.line(directive):
                    first += 1
        j = first
        while j < at and (tokens.text(j) == "@" or tokens.text(j) == "[" or tokens.text(j) == "<"):
            if tokens.text(j) == "@":
                j += 2
                while tokens.text(j) == ".":
                    j += 2
            else:
                j = tokens.behind(j)
        begin, mods = j, []
        while j < at and tokens.text(j) in lang.modifiers:
            mods.append(tokens.text(j))
            j += 1
        while j < at and tokens.text(j) == "@":
            j += 2
        if tokens.text(j) == "<":
            j = tokens.behind(j)
        mods = mods or tokens.words_before(first, lang.modifiers)
        kind = [tokens.text(k) for k in range(j, at)]
        if not kind or not tokens.is_word(j) or lang.needs_modifier and not mods or set(kind) & (_NO_TYPE | lang.no_calls) or name in _NO_TYPE or not line_starts and lang.types & set(kind):
            continue
        close = tokens.behind(i)
        tail = tokens.text(close)
        if tail not in ("{", ";") and tail not in _TAILS[language] and not (tail == "=>" and language == "csharp"):
            continue
        if tail == "=" and tokens.text(close + 1) not in ("0", "default", "delete"):
            continue
        made = _finish(tokens, lang, name, mods, begin, i, owner, tokens.between(j, at))
        if not lang.nested and made.body:
            skip = made.end
        yield made


# ---- files ------------------------------------------------------------------------------------
def _signature(lang: Language, f: Function) -> str:
    if not lang.function:
        return f"{f.result} {f.name}({f.params})"
    mark = {"": "", ":": ": ", "->": " -> "}[lang.result]
    return f"{lang.function} {f.name}({f.params})" + (f"{mark}{f.result}" if f.result else "")


def _module_doc(tokens: Tokens, lang: Language, language: str, path: str) -> str:
    if language in ("c", "cpp"):
        return f"{language.upper()} file {path}"
    if not lang.package:
        return f"{lang.title} {path.rpartition('/')[2]} in {path}"
    return f"{lang.title} {_package(tokens, lang)} in {path}"


def _complexity(lang: Language, lines: list[str], one_line: bool) -> int:
    """One, plus at most one for a branch and one for a joint on each line of the body."""
    total = 1
    for line in lines:
        text = line.strip()
        branch = any(b in text for b in lang.branches) if one_line else text.startswith(lang.branches)
        total += branch + any(j in text for j in lang.joints)
    return total


def _pieces(src: Source, f: Function, max_body: int) -> tuple[list[tuple[int, str]], bool, int]:
    """(line, text) pieces of a body, whether it stands on one line, and the last line of the function."""
    last = src.line_of(max(f.end - 1, f.at))
    if max_body:
        last = min(last, f.first_line + max_body - 1)
    if f.body is None:
        return [], False, last
    begin, end = f.body
    first = src.line_of(begin)
    inner = src.bare[begin + (not f.expression):end - (not f.expression and src.bare[end - 1:end] == "}")]
    if first == src.line_of(max(end - 1, begin)):
        return [(first, inner)], True, last
    opening = inner.partition("\n")[0]
    return ([(first, opening)] if opening.strip() else []) + [(i, src.bare_lines[i]) for i in range(first + 1, last + 1)], False, last


def parse(path: str, text: str, sha: str, domain: str, language: str, max_body: int = MAX_BODY) -> Parsed:
    """All declarations of a file. ``max_body``: lines after which a body is given up, 0 (the default) for none."""
    lang, src = LANGUAGES[language], Source(path, text, language)
    tokens = Tokens(src)
    out = Parsed(module_row(path, text, sha, domain, language, _module_doc(tokens, lang, language, path)))
    for spec in _imports(tokens, lang, language):
        row, spec = _import_row(language, path, spec)
        out.imports.append(row)
        out.module["import_paths"].append(spec)
    heads: list[tuple[int, str]] = []
    known: set[str] = set()
    for at, kind, name in _types(tokens, lang, language):
        heads.append((at, name))
        out.module["exports"].append(name)
        if name not in known:
            known.add(name)
            out.classes.append(class_row(path, name, kind, docstring=f"{kind} {name} in {path}"))
    if language == "rust":
        for at, name in _implementations(tokens):
            heads.append((at, name))
            if name not in known:
                known.add(name)
                out.classes.append(class_row(path, name, "impl", docstring=f"impl {name} in {path}"))
    heads.sort()
    functions = list(_with_word(tokens, lang) if lang.function else _without_word(tokens, lang, language))
    functions = [f for f in functions if f.name not in lang.no_calls]
    headers = {i for f in functions for i in range(f.first_line, f.head_end_line + 1)} if lang.nested else set()
    for f in functions:
        pieces, one_line, last = _pieces(src, f, max_body)
        calls = call_sites(src, [p for p in pieces if one_line or p[0] == f.head_end_line or p[0] not in headers], CALL, lang.no_calls, f.name)
        above = [name for at, name in heads if lang.last_type or at < f.at]
        owner = f.owner if f.owner in known else above[-1] if above else ""
        public = not lang.hidden & set(f.modifiers) and (not lang.shown or bool(lang.shown & set(f.modifiers)))
        if public:
            out.module["exports"].append(f.name)
        out.symbols.append(symbol_row(path, f.name, lang.kind, f"class:{path}:{owner}" if owner else f"file:{path}", f.first_line + 1, last + 1, _signature(lang, f), src.slice_lines(f.first_line, last),
                                      _complexity(lang, [p for _, p in pieces], one_line), [c for c, _ in calls], public))
        out.calls += [{"caller_id": f"symbol:{path}:{f.name}", "called_name": c, "line_number": n} for c, n in calls]
    return out.roll_up()
