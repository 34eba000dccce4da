"""Python: top-level classes and functions and the functions of class bodies, by indentation."""

from __future__ import annotations

import re

from stratograph.parsing.source import Parsed, Source, blank, class_row, module_row, symbol_row

CALL = re.compile(r"(?<!\bdef )(?<!\bclass )\b(\w+)\s*\(")
_FROM = re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]+)", re.M)
_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n#]+)", re.M)
_ALL = re.compile(r"^__all__\s*=\s*[\[(]([^\])]*)[\])]", re.M)
_CLASS = re.compile(r"^class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:")
_DEF = re.compile(r"^(\s*)(async\s+)?def\s+(\w+)")
# Words that look like calls, and words that branch.
_NO_CALLS = frozenset("if elif while for and or not in is return yield await lambda with assert del raise except import from def class".split())
_BRANCHES = frozenset("if elif while for except with and or".split())


def complexity(lines: list[str]) -> int:
    """One plus the branch words among words between white space, stripped of ``:,()``; comment lines do not count, docstrings do."""
    return 1 + sum(w.strip(":,()") in _BRANCHES for line in lines if not line.strip().startswith("#") for w in line.split())


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


def docstring(src: Source, line: int) -> str:
    """The triple-quoted string that is the first statement at or below a line."""
    while line < len(src.lines) and (not src.lines[line].strip() or src.lines[line].lstrip().startswith("#")):
        line += 1
    if line >= len(src.lines):
        return ""
    m = re.compile(r"[ \t]*[rRuU]?(\"{3}|'{3})(.*?)(?:\1|\Z)", re.S).match(src.text, src.start_of(line))
    return "\n".join(x.strip() for x in m.group(2).strip().split("\n")) if m else ""


def _signature_end(src: Source, line: int) -> int:
    """Line on which a header that may span several lines ends with its colon."""
    depth = 0
    for i in range(line, len(src.bare_lines)):
        depth += sum(src.bare_lines[i].count(c) for c in "([{") - sum(src.bare_lines[i].count(c) for c in ")]}")
        if depth <= 0 and ":" in src.bare_lines[i]:
            return i
    return line


def _signature(src: Source, first: int, last: int) -> str:
    """The header on one line, without its comments, its colon and trailing commas."""
    begin, end = src.start_of(first), src.start_of(last) + len(src.lines[last])
    bare, kept, depth = src.bare[begin:end], blank(src.text, "python", strings=False)[begin:end], 0
    for i, c in enumerate(bare):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth == 0:
            kept = kept[:i]
            break
    text = re.sub(r"\s+", " ", kept).strip()
    return re.sub(r",\s*\)", ")", re.sub(r"\(\s+", "(", re.sub(r"\s+\)", ")", text)))


def _block_end(src: Source, header_end: int, indent: int) -> int:
    """Last line of the block below a header: up to the next line of code indented no deeper, without trailing blank lines."""
    last = header_end
    for i in range(header_end + 1, len(src.lines)):
        if not src.bare_lines[i].strip():
            continue
        # a line inside a multi-line string is blank in bare form but for its quotes
        if _indent(src.lines[i]) <= indent and not src.bare_lines[i].lstrip().startswith((")", "]", "}", '"""', "'''")):
            break
        last = i
    return last


def parse(path: str, text: str, sha: str, domain: str, language: str = "python") -> Parsed:
    src = Source(path, text, "python")
    out = Parsed(module_row(path, text, sha, domain, "python", docstring(src, 0)))
    listed = _ALL.search(text)
    if listed:
        out.module["exports"] = re.findall(r"[\"']([^\"']+)[\"']", listed.group(1))
    found = []
    for m in _FROM.finditer(src.bare):
        names = []
        for part in m.group(2).strip("() \n").split(","):
            words = part.split()
            names += [words[2]] if len(words) >= 3 and words[1] == "as" else words[:1]
        found.append((m.start(), {"source_file": path, "module_spec": m.group(1), "names": names, "is_relative": m.group(1).startswith(".")}))
    for m in _IMPORT.finditer(src.bare):
        for part in m.group(1).split(","):
            words = part.split()
            if words:
                found.append((m.start(), {"source_file": path, "module_spec": words[0], "names": [words[2] if len(words) >= 3 and words[1] == "as" else words[0]], "is_relative": False}))
    for _, spec in sorted(found, key=lambda x: x[0]):
        out.imports.append(spec)
        out.module["import_paths"].append(spec["module_spec"])

    def function(line: int, owner: str | None) -> int:
        m = _DEF.match(src.bare_lines[line])
        indent, name = _indent(src.lines[line]), m.group(3)
        head_end = _signature_end(src, line)
        last = _block_end(src, head_end, indent)
        full = f"{owner}.{name}" if owner else name
        calls: dict[str, int] = {}
        for i in range(head_end, last + 1):
            piece = src.bare_lines[i]
            if i == head_end:
                piece = piece.rpartition(":")[2] if i == line or ")" in piece else ""
            for c in CALL.finditer(piece):
                if c.group(1) != name and c.group(1) not in _NO_CALLS:
                    calls.setdefault(c.group(1), i + 1)
        kind = ("async_" if m.group(2) else "") + ("method" if owner else "function")
        parent = f"class:{path}:{owner}" if owner else f"file:{path}"
        out.symbols.append(symbol_row(path, full, kind, parent, line + 1, last + 1, _signature(src, line, head_end), src.slice_lines(line, last), complexity(src.lines[line:last + 1]), list(calls), not name.startswith("_"), docstring(src, head_end + 1)))
        out.calls.extend({"caller_id": f"symbol:{path}:{full}", "called_name": c, "line_number": n} for c, n in calls.items())
        return last

    first_public = not out.module["exports"]
    i = 0
    while i < len(src.bare_lines):
        line = src.bare_lines[i]
        head = _CLASS.match(line) if line.startswith("class ") else None
        if line.startswith("class ") and head is None:  # header over several lines
            end = _signature_end(src, i)
            head = _CLASS.match(" ".join(x.strip() for x in src.bare_lines[i:end + 1]))
        if head:
            name, head_end = head.group(1), _signature_end(src, i)
            last = _block_end(src, head_end, 0)
            bases = [b.strip() for b in (head.group(2) or "").split(",") if b.strip()]
            fields = []
            j = head_end + 1
            while j <= last:
                if _DEF.match(src.bare_lines[j]):
                    j = function(j, name)
                elif _indent(src.lines[j]) == 4 and (f := re.match(r"\s*(\w+)\s*:\s*([^=#]+)", src.bare_lines[j])) and f.group(1) not in ("if", "else", "try", "for", "while", "with"):
                    fields.append(f"{f.group(1)}: {f.group(2).strip()}")
                j += 1
            out.classes.append(class_row(path, name, "class", not name.startswith("_"), docstring(src, head_end + 1), i + 1, last + 1, bases, fields))
        elif line.startswith(("def ", "async def ")):
            name = _DEF.match(line).group(3)
            last = function(i, None)
        else:
            i += 1
            continue
        # without __all__ only the first public name is exported
        if first_public and not name.startswith("_"):
            out.module["exports"].append(name)
            first_public = False
        i = last + 1
    return out.roll_up()
