"""Quality classifier: boosted trees over statistics of whole documents.

Labels are learned from a bounded sample of labelled documents (``MAX_TRAIN``, the least by a hash
of their id) outside the held-out fold; everything else covers all rows.

Defined results: a null text counts as empty, whose statistics are all zero, and is scored; texts
of any length are read whole; repeated rows get the same score; labels that are null are left out
and those of a repeated id are averaged, a tie counting as 1; without labels of both kinds the
score is constant; a null ``doc_id`` isn't held out; an empty table gives an empty result;
``with_scores`` keeps all other columns, and its own replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import batches, prepare, table, texts
from .quality_rules import STOP_WORDS

MAX_TRAIN = 20_000
THRESHOLD = 0.3
FOLDS = 5

_STOP = frozenset(STOP_WORDS)
_UPPER, _LOWER, _DIGIT = (np.array([chr(b) in s for b in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
_SYMBOL = np.array([chr(b) in "#*$%&|<>{}[]\\/=+_~^@" for b in range(256)])
_STOPS = np.array([chr(b) in ".,;:?!" for b in range(256)])
N_FEATURES = 20


def statistics(text: str) -> list[float]:
    """N_FEATURES numbers of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    data = np.frombuffer(text.encode(), np.uint8)
    byte = np.bincount(data, minlength=256)
    size = len(data)
    upper, lower, digit, symbol, stops = (int(byte[m].sum()) for m in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOPS))
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    triples = max(n - 2, 1)
    seen = byte[byte > 0] / size
    return [
        np.log1p(n),
        size / n,
        float(lengths.std()),
        float(lengths.max()),
        upper / size,
        lower / size,
        digit / size,
        symbol / n,
        stops / n,
        int(byte[33]) / n,
        int(byte[128:].sum()) / size,
        distinct / n,
        distinct / n**0.8,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 0.0,
        sum(map(_STOP.__contains__, words)) / n,
        len(lines),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
        float(-(seen * np.log2(seen)).sum()),
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(x) for x in texts(column)], np.float64).reshape(-1, N_FEATURES)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_train: int = MAX_TRAIN) -> Boosted:
    """Fit on the ``max_train`` labelled documents outside the held-out fold that come first by a hash."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    chosen = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "id")  # max_train rows of 16 bytes at most
    chosen = chosen.groupBy("id", "label").agg(F.min("text").alias("text"))

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            flat = pa.array(_matrix(batch.column(1)).ravel())
            x = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, N_FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], ["id", "label", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = chosen.select("id", "text", "label").mapInArrow(measure, f"id {kind}, label double, x array<double>").orderBy(F.xxhash64("id"), "id").toArrow()
    x = np.array(rows.column("x").combine_chunks().values.to_numpy(), np.float64).reshape(-1, N_FEATURES) if rows.num_rows else np.zeros((0, N_FEATURES))
    return fit(x, rows.column("label").to_numpy().astype(np.float64))


def with_scores(docs: DataFrame, model: Boosted, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all) of ``docs``, ``score`` and ``predicted``."""
    prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted") or c == text]

    def compute(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            score = model.score(_matrix(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*plain, "score", "predicted"])

    plain = [f"c{i}" for i in range(len(keep))]
    kinds = "".join(f"{p} {docs.schema[c].dataType.simpleString()}, " for p, c in zip(plain, keep))
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, keep)], F.col(f"`{text}`").alias("whole_text"))
    return rows.mapInArrow(compute, f"{kinds}score double, predicted int").toDF(*keep, "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
