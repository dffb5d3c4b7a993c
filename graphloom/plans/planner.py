"""Order of a basic graph pattern's joins.

With statistics the cheapest connected order is found by dynamic programming over subsets of up to
DP_LIMIT patterns and greedily beyond; without, patterns with more constants come first. Cost is
the sum of estimated rows after each step.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from typing import Any

from ..sources.stores import TripleStore
from ..terms import RDF_TYPE
from .model import Pattern, Var
from .statistics import IN, OUT, Statistics

DP_LIMIT = 10
#: Rows that an unknown predicate or constant is taken for.
_UNKNOWN = 1_000.0


@dataclass(frozen=True)
class _State:
    """Estimated cost and rows of some patterns' join, and the most selective edge of each variable."""

    cost: float
    rows: float
    order: tuple[int, ...]
    edge: tuple[tuple[str, tuple[Any, str]], ...]


class Planner:
    def __init__(self, store: TripleStore, statistics: Statistics | None = None):
        self._store, self._statistics = store, statistics

    def order(self, patterns: list[Pattern]) -> list[Pattern]:
        if len(patterns) < 2:
            return list(patterns)
        if self._statistics is None:
            return self._by_constants(patterns)
        return self._by_cost(patterns)

    def is_empty(self, patterns: list[Pattern]) -> bool:
        """True only if two edges that meet in a variable occur at no common vertex of this very graph."""
        if self._statistics is None or self._statistics.together is None or self._statistics.version != self._store.version:
            return False
        at: dict[str, set[tuple[Any, str]]] = {}
        for pattern in patterns:
            key = self._predicate(pattern)
            if key is None:
                continue
            for term, direction in ((pattern.s, OUT), (pattern.o, IN)):
                if isinstance(term, Var):
                    at.setdefault(term.name, set()).add((key, direction))
        return any(self._statistics.both(a, b) == 0 for kinds in at.values() for a, b in combinations(sorted(kinds, key=str), 2))

    def _predicate(self, pattern: Pattern) -> Any | None:
        return self._store.key(pattern.p) if isinstance(pattern.p, str) else None

    def _by_constants(self, patterns: list[Pattern]) -> list[Pattern]:
        def weight(p: Pattern) -> tuple[int, int]:
            ends = sum(not isinstance(t, Var) for t in (p.s, p.o)) - (p.p == RDF_TYPE) * 0.5
            return (-int(2 * ends), isinstance(p.p, Var))

        left, out, bound = list(patterns), [], set()
        while left:
            near = [p for p in left if not out or bound & set(p.variables())] or left
            chosen = min(near, key=lambda p: (not set(p.variables()) <= bound if out else False, *weight(p)))
            left.remove(chosen)
            out.append(chosen)
            bound |= set(chosen.variables())
        return out

    # estimates

    def _alone(self, pattern: Pattern) -> float:
        stats, key = self._statistics, self._predicate(pattern)
        if key is None:
            total = float(sum(p.triples for p in stats.predicates.values()))
            return total / (_UNKNOWN if not isinstance(pattern.s, Var) or not isinstance(pattern.o, Var) else 1)
        size = stats.predicates.get(key)
        if size is None:
            return 0.0
        s, o = isinstance(pattern.s, Var), isinstance(pattern.o, Var)
        if not s and not o:
            return 1.0
        if not o and pattern.p == RDF_TYPE:
            return float(stats.types.get(self._store.key(pattern.o), 0))
        return size.triples / (1 if s and o else size.subjects if not s else size.objects)

    def _joined(self, state: _State, pattern: Pattern) -> tuple[float, dict[str, tuple[Any, str]]]:
        """Rows after a step: share of rows whose vertex has the edge, times matches of such a vertex."""
        stats, key, edge = self._statistics, self._predicate(pattern), dict(state.edge)
        alone = self._alone(pattern)
        known = [(t.name, d) for t, d in ((pattern.s, OUT), (pattern.o, IN)) if isinstance(t, Var) and t.name in edge]
        rows = state.rows * alone if not known else state.rows
        if known:
            if key is None:
                rows *= max(1.0, alone / _UNKNOWN)
            else:
                for i, (name, direction) in enumerate(known):
                    vertices = max(1, stats.vertices(key, direction))
                    before = edge[name]
                    both, had = stats.both(before, (key, direction)), max(1, stats.vertices(*before))
                    share = min(1.0, (both if both is not None else vertices) / had)
                    rows *= share * (alone / vertices if i == 0 else min(1.0, 1 / vertices))
        for term, direction in ((pattern.s, OUT), (pattern.o, IN)):
            if isinstance(term, Var) and key is not None:
                kind = (key, direction)
                if term.name not in edge or stats.vertices(*kind) < stats.vertices(*edge[term.name]):
                    edge[term.name] = kind
        return rows, edge

    def _first(self, i: int, pattern: Pattern) -> _State:
        rows = self._alone(pattern)
        _, edge = self._joined(_State(0, 0, (), ()), pattern)
        return _State(rows, rows, (i,), tuple(edge.items()))

    def _next(self, state: _State, i: int, pattern: Pattern) -> _State:
        rows, edge = self._joined(state, pattern)
        return _State(state.cost + rows, rows, (*state.order, i), tuple(edge.items()))

    def _by_cost(self, patterns: list[Pattern]) -> list[Pattern]:
        variables = [set(p.variables()) for p in patterns]

        def near(state: _State, i: int) -> bool:
            return any(variables[i] & variables[j] for j in state.order)

        count = len(patterns)
        if count > DP_LIMIT:
            state = min((self._first(i, p) for i, p in enumerate(patterns)), key=lambda s: s.cost)
            while len(state.order) < count:
                left = [i for i in range(count) if i not in state.order]
                state = min((self._next(state, i, patterns[i]) for i in ([i for i in left if near(state, i)] or left)), key=lambda s: s.cost)
            return [patterns[i] for i in state.order]
        best: dict[frozenset[int], _State] = {frozenset([i]): self._first(i, p) for i, p in enumerate(patterns)}
        for size in range(1, count):
            for chosen in [c for c in best if len(c) == size]:
                state = best[chosen]
                left = [i for i in range(count) if i not in chosen]
                for i in [i for i in left if near(state, i)] or left:
                    found, key = self._next(state, i, patterns[i]), chosen | {i}
                    if key not in best or found.cost < best[key].cost:
                        best[key] = found
        return [patterns[i] for i in best[frozenset(range(count))].order]
