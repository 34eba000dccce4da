"""One deterministic automaton for the regular grammars of credentials: token formats, key armor, connection strings, logins.

Grammars are written as expressions over character sets. Together they are one nondeterministic automaton, of which the
deterministic one is made by subsets, state by state as texts ask for them, and remembered. Reading begins where the
anchor search (Aho-Corasick, itself a deterministic automaton) puts it down, takes one step per character and tells for every grammar
where it last accepted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: States and steps remembered at most; beyond it the tables begin anew, which costs time but changes nothing.
REMEMBERED = 50_000


@dataclass
class _Nodes:
    """Nodes of the nondeterministic automaton: moves on a character set, moves on nothing, and what is accepted."""

    moves: list[list[tuple[int, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    accepts: dict[int, str] = field(default_factory=dict)

    def new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


Test = Callable[[str], bool]
Part = Callable[["Grammar", int], int]  # build from a node on, give the last node


def word_of(word: str) -> Part:
    """A word; ASCII letters in either case where the word is in lower case."""
    return seq(*[chars(lambda c, w=w: c == w or w.islower() and c.lower() == w, ("text", w)) for w in word])


def exact(word: str) -> Part:
    return seq(*[chars(lambda c, w=w: c == w, ("exact", w)) for w in word])


def chars(test: Test, name: object = None) -> Part:
    def build(g: Grammar, at: int) -> int:
        end = g.nodes.new()
        g.nodes.moves[at].append((g.set_of(test, name), end))
        return end
    return build


def any_of(members: str, name: object = None) -> Part:
    held = frozenset(members)
    return chars(lambda c: c in held, ("any", members) if name is None else name)


def none_of(members: str, space: bool = False) -> Part:
    held = frozenset(members)
    return chars(lambda c: c not in held and (space or not c.isspace()), ("none", members, space))


def seq(*parts: Part) -> Part:
    def build(g: Grammar, at: int) -> int:
        for p in parts:
            at = p(g, at)
        return at
    return build


def either(*parts: Part) -> Part:
    def build(g: Grammar, at: int) -> int:
        end = g.nodes.new()
        for p in parts:
            g.nodes.free[p(g, at)].append(end)
        return end
    return build


def times(part: Part, least: int, most: int | None = None) -> Part:
    """``least`` to ``most`` times; any number from ``least`` on without ``most``."""
    def build(g: Grammar, at: int) -> int:
        for _ in range(least):
            at = part(g, at)
        if most is None:
            loop = g.nodes.new()
            g.nodes.free[at].append(loop)
            g.nodes.free[part(g, loop)].append(loop)
            return loop
        end = g.nodes.new()
        g.nodes.free[at].append(end)
        for _ in range(most - least):
            at = part(g, at)
            g.nodes.free[at].append(end)
        return end
    return build


class Grammar:
    """All grammars in one automaton; :meth:`read` runs it from a place of a text."""

    def __init__(self, grammars: dict[str, Part]):
        self.nodes, self._tests, self._names = _Nodes(), [], {}
        start = self.nodes.new()
        for kind, part in grammars.items():
            begin = self.nodes.new()
            self.nodes.free[start].append(begin)
            self.nodes.accepts[part(self, begin)] = kind
        self._start = self._closed(frozenset([start]))
        self._forget()

    def set_of(self, test: Test, name: object) -> int:
        if name is None or name not in self._names:
            self._tests.append(test)
            if name is None:
                return len(self._tests) - 1
            self._names[name] = len(self._tests) - 1
        return self._names[name]

    def _closed(self, nodes: frozenset[int]) -> frozenset[int]:
        out, work = set(nodes), list(nodes)
        while work:
            for n in self.nodes.free[work.pop()]:
                if n not in out:
                    out.add(n)
                    work.append(n)
        return frozenset(out)

    def _forget(self) -> None:
        self._ids: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._kinds: list[tuple[str, ...]] = []
        self._steps: dict[tuple[int, str], int] = {}
        self._state(self._start)

    def _state(self, nodes: frozenset[int]) -> int:
        if nodes not in self._ids:
            self._ids[nodes] = len(self._sets)
            self._sets.append(nodes)
            self._kinds.append(tuple(sorted({self.nodes.accepts[n] for n in nodes if n in self.nodes.accepts})))
        return self._ids[nodes]

    def _step(self, state: int, c: str) -> int:
        held = {i for i, test in enumerate(self._tests) if test(c)}
        nodes = self._closed(frozenset(n for s in self._sets[state] for i, n in self.nodes.moves[s] if i in held))
        to = self._state(nodes) if nodes else -1
        self._steps[state, c] = to
        return to

    def read(self, text: str, at: int) -> dict[str, int]:
        """Per grammar that accepts from ``at`` on: the end of its longest match."""
        if len(self._steps) > REMEMBERED or len(self._sets) > REMEMBERED:
            self._forget()
        state, found, steps = 0, {}, self._steps
        for i in range(at, len(text)):
            c = text[i]
            to = steps.get((state, c))
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            for kind in self._kinds[state]:
                found[kind] = i + 1
        return found
