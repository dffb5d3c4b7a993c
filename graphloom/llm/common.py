"""What the operators of this subpackage share: word rules, shared scratch tables, Arrow limits."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, scope, scratch_path, setting

__all__ = ["ARROW_BATCH", "SPACE", "WORD", "batches", "discard", "fresh", "is_scan", "materialize", "prepare", "scope", "scratch_path", "setting", "table", "texts", "with_row_id", "words"]

#: White space that separates words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Largest Arrow batch that is handed to Python, so that long texts don't add up.
ARROW_BATCH = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with rows in them."""
    return (b for b in rows if b.num_rows)


#: Plan nodes that keep each row of a scan once at most.
_ROWWISE = frozenset(("Project", "Filter", "SubqueryAlias"))


def is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of its own of one scan of files."""

    def plain(plan: Any) -> bool:
        if plan.getClass().getSimpleName() == "LogicalRelation":
            return plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
        return plan.getClass().getSimpleName() in _ROWWISE and plain(plan.children().head())

    return plain(df._jdf.queryExecution().analyzed())


def with_row_id(df: DataFrame, file: str, index: str) -> DataFrame:
    """Add two longs that name a row for good: its file (hashed path) and its place there.

    Rows of a frame that isn't just read from files are first written to the shared folder.
    """
    if not is_scan(df):
        df = materialize(df, "rows")
    return df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
