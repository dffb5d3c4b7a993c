"""Appended triples: a stream of them into a table, and a pattern that the stream completes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.steps import run_steps
from ..plans.model import Pattern, Var
from ..sources.stores import TripleStore

SCHEMA = "s string, p string, o string"


def stream_triples(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Triples (s, p, o) of the Parquet files that come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def append_triples(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream has so far to a table partitioned by predicate, once each, and stop."""
    written = stream.dropDuplicates(["s", "p", "o"]).writeStream.format("parquet").partitionBy("p")
    return written.option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def completed_by(stream: DataFrame, trigger: Pattern, rest: list[Pattern], store: TripleStore) -> DataFrame:
    """Matches of ``trigger`` in the stream joined with those of ``rest`` in the static store.

    ``rest`` must share a variable with ``trigger``; it runs as a static plan that the stream joins.
    """
    rows = stream
    chosen: dict[str, str] = {}
    for place, term in (("s", trigger.s), ("p", trigger.p), ("o", trigger.o)):
        if not isinstance(term, Var):
            rows = rows.where(F.col(place) == F.lit(term))
        elif term.name in chosen:
            rows = rows.where(F.col(chosen[term.name]) == F.col(place))
        else:
            chosen[term.name] = place
    rows = rows.select(*[F.col(place).alias(name) for name, place in chosen.items()])
    static = run_steps(store, list(rest))
    if static is None:
        return rows
    shared = [c for c in static.columns if c in chosen]
    if not shared:
        raise ValueError("the static patterns share no variable with the stream's")
    return rows.join(static, shared)
