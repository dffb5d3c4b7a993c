"""Steps of a basic graph pattern as DataFrame operations. No step runs an action."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Corun, IndexScan, Pattern, Placeholder, QueryError, Step, Var
from ..sources.stores import TripleStore

#: Column of a result without variables: its rows count matches.
UNIT = "__unit"


def names(rows: DataFrame | None) -> list[str]:
    return [] if rows is None else [c for c in rows.columns if c != UNIT]


def matches(store: TripleStore, pattern: Pattern) -> DataFrame:
    """Distinct bindings of a pattern's variables; without variables one row of UNIT if it holds."""
    if any(isinstance(t, Placeholder) for t in (pattern.s, pattern.p, pattern.o)):
        raise QueryError("a template needs to be filled first")
    keys = {}
    for place, term in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
        if not isinstance(term, Var):
            keys[place] = store.key(term)
            if keys[place] is None:
                return nothing(store, pattern.variables())
    if "p" in keys:
        rows = store.edges(keys["p"], keys.get("s"), keys.get("o"))
    else:
        rows = store.triples(keys.get("s"), keys.get("o"))
    chosen: dict[str, str] = {}
    for place, term in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
        if isinstance(term, Var):
            if term.name in chosen:
                rows = rows.where(F.col(chosen[term.name]) == F.col(place))
            else:
                chosen[term.name] = place
    if not chosen:
        return rows.limit(1).select(F.lit(1).alias(UNIT))
    return rows.select(*[F.col(place).alias(name) for name, place in chosen.items()])


def unit(store: TripleStore) -> DataFrame:
    """One row that binds nothing."""
    return store.spark.range(1).select(F.lit(1).alias(UNIT))


def nothing(store: TripleStore, variables: list[str]) -> DataFrame:
    """No rows of some variables."""
    fields = ", ".join(f"`{v}` {store.key_type}" for v in variables) or f"{UNIT} int"
    return store.spark.createDataFrame([], fields)


def index_scan(store: TripleStore, step: IndexScan) -> DataFrame:
    """Distinct subjects or objects of a predicate."""
    key = store.key(step.predicate)
    if key is None:
        return nothing(store, [step.var.name])
    return store.edges(key).select(F.col("s" if step.subjects else "o").alias(step.var.name)).distinct()


def joined(rows: DataFrame | None, found: DataFrame) -> DataFrame:
    """Rows extended by a pattern's bindings, or filtered if it binds nothing new."""
    if rows is None:
        return found
    ours, theirs = names(rows), names(found)
    shared = [v for v in theirs if v in ours]
    if not theirs:
        return rows.join(found.drop(UNIT), how="cross") if ours else rows.join(found.drop(UNIT), how="cross").select(UNIT)
    if not ours:
        return found.join(rows.drop(UNIT), how="cross")
    if not shared:
        return rows.join(found, how="cross")  # patterns that share no variable: the query asks for all combinations
    return rows.join(found, shared, "left_semi" if len(shared) == len(theirs) else "inner")


def corun(store: TripleStore, rows: DataFrame | None, step: Corun) -> DataFrame:
    """Run the chain from the distinct values of its start, keep the rows that it confirms."""
    unbound = [v for v in step.variables() if v not in names(rows)]
    if rows is None or unbound:
        raise QueryError(f"CORUN uses variables that aren't bound: {unbound}")
    first = step.chain[0]
    start = first.o if first.reverse else first.s
    if not isinstance(start, Var):
        raise QueryError("CORUN starts from a variable")
    chain = rows.select(start.name).distinct()
    for pattern in step.chain:
        chain = joined(chain, matches(store, pattern))
    return rows.join(chain.distinct(), names(chain), "left_semi")


def run_step(store: TripleStore, rows: DataFrame | None, step: Step) -> DataFrame:
    if isinstance(step, Corun):
        return corun(store, rows, step)
    return joined(rows, index_scan(store, step) if isinstance(step, IndexScan) else matches(store, step))


def run_steps(store: TripleStore, steps: list[Step], rows: DataFrame | None = None) -> DataFrame | None:
    return reduce(lambda done, step: run_step(store, done, step), steps, rows)


#: Mark of the right side's column of a variable that both sides have.
RIGHT = "^right"


def compatible_join(left: DataFrame, right: DataFrame, how: str, maybe: set[str], condition: Column | None = None) -> DataFrame:
    """Join, inner or left, on shared variables; those in ``maybe`` can be unbound and then agree with anything.

    Rows are told apart by which of these variables are bound, so that each part is joined on the
    variables that it has. ``condition`` is part of the join; it names shared columns of the right
    side with the mark RIGHT.
    """
    shared = [v for v in names(right) if v in names(left)]
    doubtful = [v for v in shared if v in maybe]
    if not doubtful and condition is None and shared:
        return left.join(right, shared, how)
    other = right.select(*[F.col(f"`{c}`").alias(c + RIGHT) if c in shared else F.col(f"`{c}`") for c in right.columns if c != UNIT])
    values = [F.coalesce(F.col(f"`{c}`"), F.col(f"`{c + RIGHT}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in left.columns]
    new = [c for c in other.columns if c.removesuffix(RIGHT) not in shared]

    def bound(rows: DataFrame, mask: tuple[bool, ...], mark: str) -> DataFrame:
        for v, is_bound in zip(doubtful, mask):
            column = F.col(f"`{v + mark}`")
            rows = rows.where(column.isNotNull() if is_bound else column.isNull())
        return rows

    masks = list(product((True, False), repeat=len(doubtful)))
    parts: list[DataFrame] = []
    for ours in masks:
        rows = rest = bound(left, ours, "")
        for theirs in masks:
            agreed = [v for v in shared if v not in doubtful or (ours[doubtful.index(v)] and theirs[doubtful.index(v)])]
            tests = [F.col(f"`{v}`") == F.col(f"`{v + RIGHT}`") for v in agreed] + ([] if condition is None else [condition])
            on = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
            found = bound(other, theirs, RIGHT)
            if len(masks) == 1:
                return rows.join(found, on, how).select(*values, *[F.col(f"`{c}`") for c in new])
            parts.append(rows.join(found, on).select(*values, *[F.col(f"`{c}`") for c in new]))
            rest = rest.join(found, on, "left_anti")
        if how == "left":
            parts.append(rest)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
