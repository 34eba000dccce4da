"""Parsers: source text to rows of the graph, file by file."""

from __future__ import annotations

from collections.abc import Callable

from stratograph.parsing import braced, ecma, endpoints, golang, python
from stratograph.parsing.source import Parsed, domain_of, language_of

PARSERS: dict[str, Callable[..., Parsed]] = {
    "python": python.parse, "go": golang.parse, "typescript": ecma.parse, "javascript": ecma.parse, "vue": ecma.parse_component, "svelte": ecma.parse_component,
    **{name: braced.parse for name in braced.LANGUAGES},
}


def parse_file(path: str, text: str, sha: str = "", domain: str | None = None) -> Parsed | None:
    """Parse one file by its extension; None for files that are not indexed."""
    path = path.replace("\\", "/")
    language = language_of(path)
    if language is None:
        return None
    out = PARSERS[language](path, text.replace("\r\n", "\n"), sha, domain_of(path) if domain is None else domain, language)
    out.routes = endpoints.find_routes(path, text.replace("\r\n", "\n"))
    return out
