"""A source text with its comments and strings blanked, and what all parsers build from it."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from stratograph.functions.paths import LANGUAGES, LAYERS, ROOTS

#: Lines after which the scan of a body gives up; 0 reads every body to its end. 150 gives the numbers of indexers that stop there.
MAX_BODY = 0
_C_LIKE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.DOTALL)
_HASHED = re.compile(r"\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.DOTALL)
_PHP = re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.DOTALL)
_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.[^'\n]*)'", re.DOTALL)


def blank(text: str, language: str, strings: bool = True) -> str:
    """The text with comments (and the insides of strings) replaced by spaces; offsets and line breaks stay."""
    pattern = {"python": _HASHED, "php": _PHP, "rust": _RUST}.get(language, _C_LIKE)

    def cover(m: re.Match) -> str:
        piece = m.group()
        if piece[0] in "\"'`":
            if not strings:
                return piece
            edge = 3 if piece[:3] in ('"""', "'''") and language == "python" else 1
            return piece[:edge] + re.sub(r"[^\n]", " ", piece[edge:-edge]) + piece[-edge:] if len(piece) >= 2 * edge else piece
        return re.sub(r"[^\n]", " ", piece)

    return pattern.sub(cover, text)


class Source:
    def __init__(self, path: str, text: str, language: str):
        self.path, self.text, self.language = path, text, language
        self.bare = blank(text, language)
        self.lines, self.bare_lines = text.split("\n"), self.bare.split("\n")
        self._starts = [0]
        for line in self.lines:
            self._starts.append(self._starts[-1] + len(line) + 1)

    def line_of(self, offset: int) -> int:
        """0-based line of an offset."""
        return bisect.bisect_right(self._starts, offset) - 1

    def start_of(self, line: int) -> int:
        return self._starts[line]

    def closing(self, offset: int, pair: str = "{}") -> int:
        """Offset just behind the bracket that closes the one at ``offset``; the end of the text if none does."""
        depth = 0
        for m in re.compile(f"[{re.escape(pair)}]").finditer(self.bare, offset):
            depth += 1 if m.group() == pair[0] else -1
            if depth == 0:
                return m.end()
        return len(self.text)

    def slice_lines(self, first: int, last: int) -> str:
        """Lines first..last (0-based, last included)."""
        return "\n".join(self.lines[first:last + 1])


@dataclass
class Parsed:
    """What one file gives: rows for nodes, imports, call sites and routes."""

    module: dict
    classes: list[dict] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    routes: list[dict] = field(default_factory=list)

    def roll_up(self) -> Parsed:
        """Fill the method signatures of classes from the symbols below them; keep exports in first order without repeats."""
        by_parent: dict[str, list[str]] = {}
        for s in self.symbols:
            if s["signature"]:
                by_parent.setdefault(s["parent_id"], []).append(s["signature"])
        for c in self.classes:
            c["method_signatures"] = by_parent.get(c["id"], c.get("method_signatures") or [])
        self.module["exports"] = list(dict.fromkeys(self.module["exports"]))
        return self


def layer_of(path: str) -> str:
    """Layer by path, as :func:`stratograph.functions.paths.layer` tells it for columns."""
    *folders, base = path.split("/")
    for part in [base.rpartition(".")[0] or base, *reversed(folders)]:
        words = set(re.split(r"[^a-z0-9]+", part.lower()))
        for name, keys in LAYERS.items():
            if words & set(keys):
                return name
    return ""


def domain_of(path: str) -> str:
    parts = path.split("/")
    if len(parts) < 2:
        return "root"
    return parts[1] if parts[0] in ROOTS and len(parts) > 2 else parts[0]


def language_of(path: str) -> str | None:
    dot = path.rpartition("/")[2].rpartition(".")
    return LANGUAGES.get("." + dot[2].lower()) if dot[1] else None


def module_row(path: str, text: str, sha: str, domain: str, language: str, docstring: str = "") -> dict:
    return {"id": f"file:{path}", "path": path, "filename": path.rpartition("/")[2], "language": language, "loc": text.count("\n") + 1, "sha": sha, "docstring": docstring,
            "domain": domain, "layer": layer_of(path), "exports": [], "import_paths": [], "level": "L1", "labels": ["L1Module", "Module", "File"]}


def class_row(path: str, name: str, kind: str, public: bool = True, docstring: str = "", first: int = 0, last: int = 0, bases: list[str] | None = None, fields: list[str] | None = None) -> dict:
    return {"id": f"class:{path}:{name}", "name": name, "file_path": path, "kind": kind, "bases": bases or [], "line_start": first, "line_end": last, "docstring": docstring, "is_public": public,
            "method_signatures": [], "field_signatures": fields or [], "level": "L2", "labels": ["L2Class", "Class", kind.capitalize()]}


def symbol_row(path: str, name: str, kind: str, parent: str, first: int, last: int, signature: str, code: str, complexity: int, calls: list[str], public: bool, docstring: str = "", params: list[str] | None = None) -> dict:
    return {"id": f"symbol:{path}:{name}", "name": name, "parent_id": parent, "file_path": path, "kind": kind, "line_start": first, "line_end": last, "signature": signature, "return_type": "",
            "params": params or [], "docstring": docstring, "code": code, "is_public": public, "cyclomatic_complexity": complexity, "calls": calls, "references": [], "level": "L3",
            "labels": ["L3Symbol", "Symbol", "Method" if "method" in kind else "Function"]}


def call_sites(src: Source, spans: list[tuple[int, str]], pattern: re.Pattern, excluded: frozenset[str], own: str, nested: re.Pattern | None = None) -> list[tuple[str, int]]:
    """(name, 1-based line) of calls in bare line pieces, each name once, where it stands first; lines that define something nested are skipped."""
    found: dict[str, int] = {}
    for line, piece in spans:
        if nested is not None and nested.search(piece):
            continue
        for m in pattern.finditer(piece):
            if m.group(1) != own and m.group(1) not in excluded:
                found.setdefault(m.group(1), line + 1)
    return list(found.items())
