"""Reading declarations of brace languages from tokens: modifiers, keyword, name, balanced parameters, what follows.

A file is cut into tokens once (comments and the insides of strings are blank by then). Words that open a
declaration are looked up, and what belongs to it is read to the right with brackets balanced and to the left
up to the end of the declaration before; lines play no part, so headers may span any number of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from stratograph.parsing.source import Source

_TOKEN = re.compile(r"[^\W\d][\w$]*|\$[^\W\d]\w*|\d[\w.]*|::|->|=>|&&|\|\||\?\?|[^\s\w]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


@dataclass(frozen=True)
class Token:
    text: str
    at: int

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @property
    def is_word(self) -> bool:
        return self.text[0].isalpha() or self.text[0] == "_"


class Tokens:
    """The tokens of a source with the walks that all grammars share. Positions are indexes of tokens."""

    def __init__(self, src: Source):
        self.src = src
        self.all = [Token(m.group(), m.start()) for m in _TOKEN.finditer(src.bare)]

    def __len__(self) -> int:
        return len(self.all)

    def text(self, i: int) -> str:
        return self.all[i].text if 0 <= i < len(self.all) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.all) and self.all[i].is_word

    def line(self, i: int) -> int:
        return self.src.line_of(self.all[min(i, len(self.all) - 1)].at)

    def between(self, i: int, j: int) -> str:
        """The original text of tokens i..j-1, white space as one blank."""
        return " ".join(self.src.text[self.all[i].at:self.all[j - 1].end].split()) if i < j else ""

    @cached_property
    def _partner(self) -> dict[int, int]:
        """Closing token of each round, square or curly bracket."""
        out, open_ = {}, []
        for i, t in enumerate(self.all):
            if t.text in "([{" and len(t.text) == 1:
                open_.append(i)
            elif t.text in (")", "]", "}"):
                while open_:
                    j = open_.pop()
                    if _PAIRS[self.all[j].text] == t.text:
                        out[j] = i
                        break
        return out

    def behind(self, i: int) -> int:
        """Position behind the bracket that opens at i; the end where none closes it."""
        if self.text(i) != "<":
            return self._partner.get(i, len(self.all) - 1) + 1
        depth, j = 0, i
        while j < len(self.all):
            t = self.all[j].text
            if t in ("(", "[", "{"):
                j = self._partner.get(j, len(self.all)) + 1
                continue
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j + 1
            if t in (";", ")", "]", "}"):
                break
            j += 1
        return i + 1

    def before(self, i: int, opening: str, closing: str) -> int:
        """Position of the bracket that opens the one that closes at i, or -1."""
        depth = 0
        for j in range(i, -1, -1):
            t = self.all[j].text
            depth += (t == closing) - (t == opening)
            if depth == 0:
                return j
            if t in (";", "{", "}"):
                break
        return -1

    def words_before(self, i: int, known: frozenset[str]) -> list[str]:
        """The known words that stand directly before i, annotations and bracketed arguments of words between them stepped over."""
        out, j = [], i - 1
        while j >= 0:
            t = self.text(j)
            if t in known:
                out.append(t)
                j -= 1
            elif t == ")" and (k := self.before(j, "(", ")")) > 0 and self.is_word(k - 1):
                j = k - 1 if self.text(k - 1) in known else self._annotation(k - 1)
            elif self.is_word(j) and (k := self._annotation(j)) < j:
                j = k
            else:
                break
        return out[::-1]

    def _annotation(self, i: int) -> int:
        """Position before an annotation whose last word is at i; i itself, or -1 to stop, where there is none."""
        j = i
        while self.text(j - 1) == "." and self.is_word(j - 2):
            j -= 2
        return j - 2 if self.text(j - 1) == "@" else (i if self.is_word(i) else -1)

    def until(self, i: int, stops: tuple[str, ...], same_line: bool = False) -> int:
        """First position from i on that holds one of the stops, brackets stepped over; with ``same_line`` at latest where a line ends."""
        while i < len(self.all):
            t = self.all[i].text
            if t in stops or same_line and i and self.line(i) != self.line(i - 1):
                return i
            i = self.behind(i) if t in ("(", "[", "{") else i + 1
        return len(self.all)


@dataclass
class Function:
    """A function header with its places: tokens first..last of the header, and offsets of the body (None without one)."""

    name: str
    modifiers: list[str]
    params: str
    result: str
    first_line: int
    head_end_line: int
    at: int
    body: tuple[int, int] | None
    end: int
    owner: str = ""
    expression: bool = False
