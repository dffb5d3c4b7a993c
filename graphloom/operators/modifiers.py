"""Projection, DISTINCT, REDUCED, COUNT, DUPLICATES, ORDER BY and LIMIT of decoded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Query, QueryError
from ..terms import number_of
from .steps import names

COUNT = "count"


def term_order(term: Column) -> list[Column]:
    """What terms are ordered by: unbound, blank nodes, addresses, literals; numbers by value before texts."""
    number = number_of(term)
    kind = F.when(term.isNull(), 0).when(term.startswith("_:"), 1).when(term.startswith("<"), 2).when(number.isNotNull(), 3).otherwise(4)
    return [kind, number, term]


def projected(rows: DataFrame, query: Query, named: list[str]) -> DataFrame:
    """The chosen variables, those that no pattern binds null; ``named``: all that the query names."""
    chosen = sorted(named) if query.select is None and not query.ordered else query.select
    if chosen is None:
        chosen = names(rows)
    if query.modifier == "COUNT" and COUNT in chosen:
        raise QueryError("SELECT COUNT adds a column of this name")
    return rows.select(*[F.col(f"`{v}`") if v in rows.columns else F.lit(None).cast("string").alias(v) for v in chosen])


def modified(rows: DataFrame, query: Query, named: list[str]) -> DataFrame:
    """``rows`` with all variables; an order by variables that aren't chosen is applied first."""
    out = projected(rows, query, named)
    chosen = out.columns
    if query.modifier in ("DISTINCT", "REDUCED"):
        out = out.distinct()
    elif query.modifier == "COUNT":
        out = out.groupBy(*[F.col(f"`{c}`") for c in chosen]).agg(F.count("*").alias(COUNT))
    if query.order:
        wanted = [COUNT if o.var is None else o.var for o in query.order]
        keys = [k.desc() if o.descending else k.asc() for w, o in zip(wanted, query.order) for k in ([F.col(w)] if o.var is None else term_order(F.col(f"`{w}`")))]
        if set(wanted) <= set(out.columns):
            out = out.orderBy(*keys)
        elif query.modifier in ("", "DUPLICATES") and set(wanted) <= set(rows.columns):
            out = projected(rows.orderBy(*keys), query, named)
        else:
            raise QueryError(f"ORDER BY uses variables that the result lacks: {wanted}")
    return out.limit(query.limit) if query.limit is not None else out
