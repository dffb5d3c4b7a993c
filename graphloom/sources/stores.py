"""Triple stores: what a query engine needs of a graph, from tokens or from integer ids."""

from __future__ import annotations

import uuid
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from ..terms import RDF_TYPE

#: Ids of the predicate index and of rdf:type; vertices begin at VERTEX.
PREDICATE_ID, TYPE_ID, VERTEX = 0, 1, 1 << 17


class TripleStore:
    """A set of triples. ``key`` is what stands for a term in columns."""

    spark: SparkSession

    @cached_property
    def version(self) -> str:
        """Names this store's triples; statistics of other ones prove nothing about it."""
        return uuid.uuid4().hex

    def key(self, term: str) -> Any | None:
        """The key of a term, None if the graph can't have it."""
        raise NotImplementedError

    def edges(self, predicate: Any, s: Any = None, o: Any = None) -> DataFrame:
        """Distinct (s, o) of a predicate; ``s`` and ``o`` restrict them to a key."""
        raise NotImplementedError

    def triples(self, s: Any = None, o: Any = None) -> DataFrame:
        """Distinct (s, p, o)."""
        raise NotImplementedError

    def decode(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Replace keys by terms."""
        raise NotImplementedError

    @property
    def key_type(self) -> str:
        return "string"


def _restricted(df: DataFrame, s: Any, o: Any) -> DataFrame:
    for name, value in (("s", s), ("o", o)):
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


class TermStore(TripleStore):
    """Triples of tokens (s, p, o), made distinct once: the first use writes them, sorted by predicate in each file."""

    def __init__(self, triples: DataFrame):
        self.spark = triples.sparkSession
        self._given = triples.select("s", "p", "o")

    @cached_property
    def _triples(self) -> DataFrame:
        return materialize(self._given.distinct().sortWithinPartitions("p"), "triples")

    def key(self, term: str) -> str:
        return term

    def edges(self, predicate: str, s: str | None = None, o: str | None = None) -> DataFrame:
        return _restricted(self._triples.where(F.col("p") == F.lit(predicate)), s, o).select("s", "o")

    def triples(self, s: str | None = None, o: str | None = None) -> DataFrame:
        return _restricted(self._triples, s, o)

    def decode(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows


class DictStore(TripleStore):
    """Triples of ids and a dictionary (id, str).

    Constants are looked up by a filter on the dictionary; results are decoded by joins, whose
    strategy Spark chooses from the size of the dictionary.
    """

    def __init__(self, triples: DataFrame, dictionary: DataFrame, distinct: bool = True):
        self.spark = triples.sparkSession
        rows = triples.select("s", "p", "o")
        self._triples = rows.distinct() if distinct else rows
        self._dictionary = dictionary.select("id", "str")
        self._keys: dict[str, int | None] = {}

    @property
    def key_type(self) -> str:
        return "bigint"

    def key(self, term: str) -> int | None:
        if term not in self._keys:
            name = "rdf:type" if term == RDF_TYPE else term
            found = self._dictionary.where(F.col("str").isin(term, name)).select("id").first()
            self._keys[term] = found["id"] if found else None
        return self._keys[term]

    def edges(self, predicate: int, s: int | None = None, o: int | None = None) -> DataFrame:
        return _restricted(self._triples.where(F.col("p") == F.lit(predicate)), s, o).select("s", "o")

    def triples(self, s: int | None = None, o: int | None = None) -> DataFrame:
        return _restricted(self._triples, s, o)

    def decode(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        order = rows.columns
        for name in columns:
            names = self._dictionary.select(F.col("id").alias("^id"), F.col("str").alias("^str"))
            rows = rows.join(names, F.col(f"`{name}`") == F.col("`^id`"), "left").withColumn(name, F.col("`^str`")).select(*[F.col(f"`{c}`") for c in order])
        return rows
