"""Relational tables as a graph: each predicate is a projection of one table or a few.

Nothing is copied. A predicate reads the columns it needs; a constant subject or object is turned
back into the key column's value, so that its filter reaches the Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import INTEGER, RDF_TYPE
from .stores import TripleStore

ENTITY, VOCABULARY = "http://t/", "http://t/v#"


def vocabulary(name: str) -> str:
    return f"<{VOCABULARY}{name}>"


def entity(kind: str, key: object) -> str:
    return f"<{ENTITY}{kind}/{key}>"


@dataclass(frozen=True)
class Node:
    """Entities of a kind, by a key column."""

    kind: str
    column: str

    def term(self) -> Column:
        return F.concat(F.lit(f"<{ENTITY}{self.kind}/"), F.col(self.column).cast("string"), F.lit(">"))

    def value(self, term: str) -> str | None:
        found = re.fullmatch(rf"<{re.escape(ENTITY)}{self.kind}/([^/<>]*)>", term)
        return found[1] if found else None


@dataclass(frozen=True)
class Literal:
    """Texts of a column as plain literals, or numbers as integers."""

    column: str
    integer: bool = False

    def term(self) -> Column:
        if self.integer:
            return F.concat(F.lit('"'), F.col(self.column).cast("string"), F.lit(f'"^^{INTEGER}'))
        text = F.col(self.column)
        for sign, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(sign), F.lit(escape))
        return F.concat(F.lit('"'), text, F.lit('"'))

    def value(self, term: str) -> str | None:
        found = re.fullmatch(rf'"([^"\\]*)"{re.escape("^^" + INTEGER) if self.integer else ""}', term)
        return found[1] if found else None


@dataclass(frozen=True)
class Fixed:
    """One term for all rows."""

    name: str
    column: str | None = None

    def term(self) -> Column:
        return F.lit(self.name)

    def value(self, term: str) -> str | None:
        return "" if term == self.name else None


@dataclass(frozen=True)
class Edge:
    """Subject and object of a predicate's rows in a table; ``repeats`` if rows can give the same pair."""

    table: str
    s: Node
    o: Node | Literal | Fixed
    repeats: bool = False

    def frame(self, tables: DataFrame, s: str | None, o: str | None) -> DataFrame | None:
        """(s, o) of a table's rows, None if the constants can't occur."""
        columns = [c for c in dict.fromkeys([self.s.column, self.o.column]) if c]
        rows = tables.select(*columns).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
        for place, term in ((self.s, s), (self.o, o)):
            if term is not None:
                value = place.value(term)
                if value is None:
                    return None
                if place.column:
                    wanted = _cast(value, rows.schema[place.column].dataType)
                    if wanted is None:
                        return None
                    rows = rows.where(F.col(place.column) == F.lit(wanted))
        if self.repeats:
            rows = rows.distinct()
        return rows.select(self.s.term().alias("s"), self.o.term().alias("o"))


def _cast(value: str, kind: T.DataType) -> object | None:
    """The constant in the column's type, so that the scan can use it; None if it isn't written as the column would be."""
    if isinstance(kind, T.StringType):
        return value
    try:
        return int(value) if str(int(value)) == value else None
    except ValueError:
        return None


def _kinds(*of: tuple[str, str, str, bool]) -> list[Edge]:
    return [Edge(table, Node(kind.lower(), column), Fixed(vocabulary(kind)), repeats) for table, kind, column, repeats in of]


_NAMES = (("region", "r"), ("nation", "n"), ("customer", "c"), ("supplier", "s"), ("part", "p"))
#: Predicates of the order, shipping and event tables.
EDGES: dict[str, list[Edge]] = {
    RDF_TYPE: _kinds(
        ("region", "Region", "r_regionkey", False), ("nation", "Nation", "n_nationkey", False), ("customer", "Customer", "c_custkey", False),
        ("supplier", "Supplier", "s_suppkey", False), ("part", "Part", "p_partkey", False), ("orders", "Order", "o_orderkey", False),
        ("events", "Event", "event_id", False), ("events", "User", "user_id", True),
    ),
    vocabulary("name"): [Edge(t, Node(t, f"{c}_{ {'customer': 'cust', 'supplier': 'supp'}.get(t, t) }key"), Literal(f"{c}_name")) for t, c in _NAMES],
    vocabulary("inRegion"): [Edge("nation", Node("nation", "n_nationkey"), Node("region", "n_regionkey"))],
    vocabulary("inNation"): [
        Edge("customer", Node("customer", "c_custkey"), Node("nation", "c_nationkey")), Edge("supplier", Node("supplier", "s_suppkey"), Node("nation", "s_nationkey")),
    ],
    vocabulary("segment"): [Edge("customer", Node("customer", "c_custkey"), Literal("c_mktsegment"))],
    vocabulary("brand"): [Edge("part", Node("part", "p_partkey"), Literal("p_brand"))],
    vocabulary("size"): [Edge("part", Node("part", "p_partkey"), Literal("p_size", integer=True))],
    vocabulary("placedBy"): [Edge("orders", Node("order", "o_orderkey"), Node("customer", "o_custkey"))],
    vocabulary("status"): [Edge("orders", Node("order", "o_orderkey"), Literal("o_orderstatus"))],
    vocabulary("priority"): [Edge("orders", Node("order", "o_orderkey"), Literal("o_orderpriority"))],
    vocabulary("hasPart"): [Edge("lineitem", Node("order", "l_orderkey"), Node("part", "l_partkey"), True)],
    vocabulary("hasSupplier"): [Edge("lineitem", Node("order", "l_orderkey"), Node("supplier", "l_suppkey"), True)],
    vocabulary("suppliedBy"): [Edge("lineitem", Node("part", "l_partkey"), Node("supplier", "l_suppkey"), True)],
    vocabulary("byUser"): [Edge("events", Node("event", "event_id"), Node("user", "user_id"))],
    vocabulary("kind"): [Edge("events", Node("event", "event_id"), Literal("event_type"))],
}


class MappedStore(TripleStore):
    """The graph of the tables in a folder, ``<name>.parquet`` each."""

    def __init__(self, spark: SparkSession, folder: str, edges: dict[str, list[Edge]] | None = None):
        self.spark, self._folder = spark, folder
        self._edges = EDGES if edges is None else edges
        self._tables: dict[str, DataFrame] = {}

    def key(self, term: str) -> str:
        return term

    def predicates(self) -> list[str]:
        return list(self._edges)

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._tables[name]

    def edges(self, predicate: str, s: str | None = None, o: str | None = None) -> DataFrame:
        found = [f for e in self._edges.get(predicate, []) if (f := e.frame(self._table(e.table), s, o)) is not None]
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], "s string, o string")

    def triples(self, s: str | None = None, o: str | None = None) -> DataFrame:
        frames = [self.edges(p, s, o).select("s", F.lit(p).alias("p"), "o") for p in self._edges]
        return reduce(DataFrame.union, frames)

    def decode(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows
