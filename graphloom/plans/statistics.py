"""Graph statistics for planning: sizes by predicate, instances by type, co-occurrence of predicates.

Each is one distributed aggregation; only the result, a row for each predicate, type or pair of
predicates, comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import TripleStore
from ..terms import RDF_TYPE

OUT, IN = "out", "in"


@dataclass(frozen=True)
class PredicateSize:
    triples: int
    subjects: int
    objects: int


@dataclass
class Statistics:
    predicates: dict[Any, PredicateSize] = field(default_factory=dict)
    types: dict[Any, int] = field(default_factory=dict)
    #: Vertices that have both edges, by ((predicate, direction), (predicate, direction)); none: not collected.
    together: dict[tuple[tuple[Any, str], tuple[Any, str]], int] | None = None
    #: Of the store that they were collected from.
    version: str = ""

    def vertices(self, predicate: Any, direction: str) -> int:
        size = self.predicates.get(predicate)
        return 0 if size is None else size.subjects if direction == OUT else size.objects

    def both(self, a: tuple[Any, str], b: tuple[Any, str]) -> int | None:
        """Vertices with both edges, None if unknown."""
        if self.together is None:
            return None
        return self.together.get((a, b), self.together.get((b, a), 0)) if a != b else self.vertices(*a)


def predicate_sizes(triples: DataFrame) -> DataFrame:
    """p, n_triples, n_subjects, n_objects of distinct triples."""
    return triples.groupBy("p").agg(F.count("*").alias("n_triples"), F.count_distinct("s").alias("n_subjects"), F.count_distinct("o").alias("n_objects"))


def type_sizes(triples: DataFrame, type_key: Any) -> DataFrame:
    """o, n_instances of each type."""
    return triples.where(F.col("p") == F.lit(type_key)).groupBy("o").agg(F.count("*").alias("n_instances"))


def predicate_pairs(triples: DataFrame) -> DataFrame:
    """p1, d1, p2, d2, n: vertices with an edge of each kind, for ordered pairs of kinds (p, direction).

    A vertex has at most two kinds of edges a predicate, so that its row of kinds is small however
    many edges it has; pairs come from that row instead of a join.
    """
    kinds = triples.select(F.col("s").alias("v"), "p", F.lit(OUT).alias("d")).union(triples.select(F.col("o"), "p", F.lit(IN))).distinct()
    rows = kinds.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("p", "d"))).alias("kinds"))
    pairs = rows.select(F.explode("kinds").alias("a"), "kinds").select("a", F.explode("kinds").alias("b")).where("a < b")
    return pairs.groupBy(F.col("a.p").alias("p1"), F.col("a.d").alias("d1"), F.col("b.p").alias("p2"), F.col("b.d").alias("d2")).agg(F.count("*").alias("n"))


def dataset_size(triples: DataFrame) -> DataFrame:
    """n_triples, n_subjects, n_predicates, n_objects."""
    return triples.agg(F.count("*").alias("n_triples"), *[F.count_distinct(c).alias(f"n_{name}") for c, name in (("s", "subjects"), ("p", "predicates"), ("o", "objects"))])


def collect_statistics(store: TripleStore, pairs: bool = True) -> Statistics:
    triples = store.triples()
    out = Statistics(version=store.version)
    for row in predicate_sizes(triples).collect():
        out.predicates[row["p"]] = PredicateSize(row["n_triples"], row["n_subjects"], row["n_objects"])
    for row in type_sizes(triples, store.key(RDF_TYPE)).collect():
        out.types[row["o"]] = row["n_instances"]
    if pairs:
        out.together = {((r["p1"], r["d1"]), (r["p2"], r["d2"])): r["n"] for r in predicate_pairs(triples).collect()}
    return out
