"""The engine: queries in, lazy DataFrames out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.filters import FilterCompiler, variables
from .operators.modifiers import modified
from .operators.steps import RIGHT, compatible_join, names, nothing, run_steps, unit
from .plans.model import Corun, Expr, Group, Pattern, Query, Var, inner_name, with_inner_names
from .plans.plan_language import parse_plan
from .plans.planner import Planner
from .plans.sparql import parse_sparql
from .plans.statistics import Statistics, collect_statistics
from .sources.stores import TripleStore


class Engine:
    """Runs queries over a store. Without statistics joins are ordered by constants alone."""

    def __init__(self, store: TripleStore, statistics: Statistics | None = None, functions: dict[str, Callable[..., Column]] | None = None):
        self.store, self.statistics, self._functions = store, statistics, functions or {}

    def analyze(self, pairs: bool = True) -> Statistics:
        """Collect statistics and plan with them from now on."""
        self.statistics = collect_statistics(self.store, pairs)
        return self.statistics

    def sparql(self, text: str) -> DataFrame:
        """Rows of terms of a standard SPARQL query."""
        return self.run(parse_sparql(text))

    def plan(self, text: str) -> DataFrame:
        """Rows of terms of a plan-language query, whose steps run as written."""
        return self.run(parse_plan(text))

    def run(self, query: Query) -> DataFrame:
        inside = with_inner_names(query)
        rows = self.group(inside.where, query.ordered)
        found = modified(self.store.decode(rows, names(rows)), inside, named_variables(inside.where))
        outside = {inner_name(v): v for v in [*group_variables(query.where), *(query.select or [])]}
        return found.toDF(*[outside.get(c, c) for c in found.columns])

    def count(self, query: Query) -> int:
        """Number of rows without modifiers, nothing decoded."""
        return self.group(with_inner_names(query).where, query.ordered).count()

    def group(self, group: Group, ordered: bool = False) -> DataFrame:
        """All bindings of a group, as keys of the store; variables must differ but for case."""
        steps = list(group.steps)
        planner = Planner(self.store, self.statistics)
        if not ordered and all(isinstance(s, Pattern) for s in steps):
            if planner.is_empty(steps):
                return nothing(self.store, list(dict.fromkeys(v for v in group_variables(group))))
            steps = planner.order(steps)
        rows = run_steps(self.store, steps)
        maybe: set[str] = set()
        for parts in group.unions:
            found = [self.group(part) for part in parts]
            everywhere = set.intersection(*(set(names(f)) for f in found))
            # a part without a variable leaves it unbound
            part_maybe = {v for f in found for v in names(f)} - everywhere | set().union(*(self._maybe(p) for p in parts))
            union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
            rows = union if rows is None else compatible_join(rows, union, "inner", maybe | part_maybe)
            maybe |= part_maybe
        for part in group.optionals:
            # its filters are part of the join and see the variables around it
            found = self.group(replace(part, filters=[]))
            if rows is None:
                rows = unit(self.store)
            new = set(names(found)) - set(names(rows))
            rows = self._optional(rows, found, maybe | self._maybe(part), part.filters)
            maybe |= new
        if rows is None:
            rows = unit(self.store)
        for condition in group.filters:
            rows = self._filtered(rows, condition)
        return rows

    def _maybe(self, group: Group) -> set[str]:
        """Variables that a group may leave unbound."""
        bound = {v for s in group.steps for v in s.variables()}
        inside = {v for g in [*group.optionals, *(p for parts in group.unions for p in parts)] for v in group_variables(g)}
        return inside - bound

    def _optional(self, rows: DataFrame, found: DataFrame, maybe: set[str], conditions: list[Expr]) -> DataFrame:
        if not conditions:
            return compatible_join(rows, found, "left", maybe)
        used = set().union(*map(variables, conditions))
        ours, theirs = names(rows), names(found)
        terms: dict[str, Column] = {}
        beside = []
        for side, own, mark in ((rows, ours, "^left"), (found, theirs, "^term")):
            wanted = [v for v in own if v in used]
            if self.store.key_type != "string":  # ids are decoded beside the keys for the time of the join
                side = self.store.decode(side.selectExpr("*", *[f"`{v}` AS `{v}{mark}`" for v in wanted]), [v + mark for v in wanted])
            else:
                mark = RIGHT if mark == "^term" else ""
            for v in wanted:
                here = F.col(f"`{v}{mark}`") if self.store.key_type != "string" or v in ours else F.col(f"`{v}`")
                terms[v] = here if v not in terms else F.coalesce(terms[v], here)
            beside.append(side)
        columns = [*ours, *(v for v in theirs if v not in ours)]
        test = reduce(lambda a, b: a & b, [FilterCompiler(columns, self._functions, terms).condition(c) for c in conditions])
        joined = compatible_join(*beside, "left", maybe, test)
        return joined.select(*[F.col(f"`{c}`") for c in [*rows.columns, *(v for v in theirs if v not in ours)]])

    def _filtered(self, rows: DataFrame, condition: Expr) -> DataFrame:
        """Ids are decoded beside the keys for the time of the filter."""
        if self.store.key_type == "string":
            return rows.where(FilterCompiler(names(rows), self._functions).condition(condition))
        used = [v for v in names(rows) if v in variables(condition)]
        beside = rows.selectExpr("*", *[f"`{v}` AS `__key_{v}`" for v in used])
        decoded = self.store.decode(beside, used)
        kept = decoded.where(FilterCompiler(names(rows), self._functions).condition(condition))
        return kept.selectExpr(*[f"`__key_{c}` AS `{c}`" if c in used else f"`{c}`" for c in rows.columns])


def group_variables(group: Group) -> list[str]:
    """Names of all variables of a group, blank nodes too, in order."""
    found = [v for s in group.steps for v in s.variables()]
    for part in [*(p for parts in group.unions for p in parts), *group.optionals]:
        found += group_variables(part)
    return list(dict.fromkeys(found))


def named_variables(group: Group) -> list[str]:
    """Like ``group_variables`` without blank nodes."""
    blank = {t.name for p in _patterns(group) for t in (p.s, p.p, p.o) if isinstance(t, Var) and t.blank}
    return [v for v in group_variables(group) if v not in blank]


def _patterns(group: Group) -> list[Pattern]:
    found = [p for s in group.steps for p in (s.chain if isinstance(s, Corun) else (s,)) if isinstance(p, Pattern)]
    for part in [*(p for parts in group.unions for p in parts), *group.optionals]:
        found += _patterns(part)
    return found

