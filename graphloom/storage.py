"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Setting by which Spark deletes the shuffle files of a write once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written in each open scope, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that is unset a local session gets a temporary folder; a cluster gets an error, as a
    folder of one machine would lose rows there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = Path(tempfile.mkdtemp(prefix="graphloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/graphloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives executors.

    Shuffle files of the write go with its end. The folder goes with the scope that it is written in, if any.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those passed to the yielded ``keep``.

    A kept table belongs to the scope around. Only what was read from is deleted, after the tables
    made of it are written, so that lost executors need none of it.
    """
    written: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch_path)
        return df

    token = _SCOPES.set((*_SCOPES.get(), written))
    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        if scopes := _SCOPES.get():
            scopes[-1].extend(kept)
        for path in written:
            if path not in kept:
                discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(terms: DataFrame, start: int) -> DataFrame:
    """str, id in the order of the distinct ``str`` from ``start``, written.

    One range shuffle, whose rows get their partition and place as one number; the rows before each
    partition then come from the written table, so that both always agree.
    """
    placed = materialize(terms.select("str").repartitionByRange("str").sortWithinPartitions("str").select("str", F.monotonically_increasing_id().alias("at")), "numbers")
    part = F.shiftright("at", 33).alias("part")
    # a row for each partition, whose number the session bounds
    sizes = placed.groupBy(part).count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select("str", part, place.alias("place")).join(F.broadcast(before), "part").select("str", (F.col("before") + F.col("place") + F.lit(start)).cast("long").alias("id"))
