"""SimHash near-duplicates by multi-index hashing.

Two fingerprints that differ in at most three bits differ in at most one in their lower or in
their upper half. Each half of each distinct fingerprint is stored in a table; look-ups enumerate
the half itself and those that have one zero bit set, fetch the matches and verify the complete
distance inside the join. Equal fingerprints are one entry, so that copies cost nothing.

Defined results: a null or empty text has fingerprint zero and is linked like any other; texts of
any length are read whole; repeated rows share a component; ties for the one document that stays
go to the first row; a null ``doc_id`` has a null component unless linked to others; an empty table
gives an empty result; ``near_dedup`` keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialize, prepare, scope, table, texts, with_row_id
from .components import connected_components
from .fingerprints import simhash

MAX_BITS = 3
#: A half that more distinct fingerprints share is dealt over several tasks.
TOGETHER = 2_000


def with_fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the signed 64-bit ``fp`` of each whole text."""
    prepare(docs.sparkSession)

    def compute(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            prints = [simhash(x) for x in texts(batch.column(len(keep)))]
            signed = pa.array([x - (1 << 64) if x >> 63 else x for x in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], signed], [*keep, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in (*keep, text)]).mapInArrow(compute, f"{kinds}, fp long")


def _half(upper: int) -> Column:
    """A half as a key; the upper one is marked by bit 32."""
    return F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)) if upper else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def links(prints: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` at MAX_BITS differing bits or fewer."""
    stored = prints.select("fp", F.explode(F.array(_half(0), _half(1))).alias("key"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit("key", i) == 0))
    ball = stored.select("fp", "key", F.lit(0).alias("flipped")).union(stored.select("fp", "key", bit.alias("i")).select("fp", F.expr("key | shiftleft(1L, i)"), F.lit(1)))
    hot = materialize(stored.groupBy("key").count().where(F.col("count") > together).select("key", F.ceil(F.col("count") / together).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        on = F.expr("s.key = p.key")
    else:
        stored = stored.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        ball = ball.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        on = F.expr("s.key = p.key AND s.part = p.part")
    near = F.expr(f"(p.flipped = 1 OR p.fp < s.fp) AND bit_count(p.fp ^ s.fp) <= {MAX_BITS}")
    return ball.alias("p").join(stored.alias("s"), on & near).select(F.col("p.fp").alias("a"), F.col("s.fp").alias("b"))


def classes(prints: DataFrame) -> DataFrame:
    """fp, root: the component of each fingerprint that has links."""
    return connected_components(links(materialize(prints.select("fp").distinct(), "prints"))).select(F.col("node").alias("fp"), "root")


def components(printed: DataFrame, first: Column) -> DataFrame:
    """Add ``least``, the least ``first`` of the component, to written rows with ``fp``; alone: null.

    Only fingerprints that several rows or links share are joined back.
    """
    by_print = printed.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    rooted = materialize(by_print.join(classes(printed), "fp", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return printed.join(rooted.join(least, "root").select("fp", "least"), "fp", "left")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: that of the least ``doc_id``, null last."""
    names = docs.columns
    marked = with_row_id(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), "row_file", "row_index")
    at = {c.lower(): f"c{i}" for i, c in enumerate(names)}
    ident = at[doc_id.lower()]
    with scope(docs.sparkSession) as keep:
        printed = materialize(with_fingerprints(marked, at[text.lower()], ["row_file", "row_index", ident]), "fingerprints")
        kept = keep(materialize(_first_rows(printed, ident), "first_rows"))
    # by sort-merge at every size, as what stays grows with the corpus
    return marked.join(kept.hint("merge"), ["row_file", "row_index"]).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _first_rows(printed: DataFrame, ident: str) -> DataFrame:
    """row_file and row_index of the one row of each component that stays."""
    order = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col("row_file").alias("f"), F.col("row_index").alias("i"))
    return components(printed, order).where(F.col("least").isNull() | (F.col("least") == order)).select("row_file", "row_index")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = materialize(with_fingerprints(table(spark, sf_dir, "documents"), "text", ["doc_id"]), "fingerprints")
    found = components(printed, F.col("doc_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("least", "doc_id").alias("component_id"))
