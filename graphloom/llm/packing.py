"""Best-fit decreasing packing of token pieces into sequences of fixed length.

Documents become token ids plus an end id; those longer than a sequence are cut. Pieces are dealt
evenly over shards of bounded size; in each, pieces from longest to shortest go to the open
sequence that they fill most, which a segment tree over remaining capacities finds in a number of
steps that is logarithmic in the capacity.

Defined results: a null or empty text is one piece of the end id alone; texts of any length are
encoded whole; repeated rows are packed as often as they occur; ties in length go by checksum, then doc_id; a
null ``doc_id`` stays null; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialize, prepare, table, texts
from .tokens import encoder

CAPACITY = 4096
END_ID = 1
#: Pieces that one packing task holds. Each shard leaves about half a sequence open.
SHARD_PIECES = 8192


class CapacityTree:
    """Open bins by remaining capacity; ``tightest(n)`` is the least capacity of at least ``n``."""

    def __init__(self, capacity: int):
        self._leaves = 1 << (capacity + 1).bit_length()
        self._open = [0] * (2 * self._leaves)
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def tightest(self, need: int) -> int | None:
        node = self._leaves + need
        if self._open[node]:
            return need
        while node > 1:
            if not node & 1 and self._open[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node if self._open[2 * node] else 2 * node + 1
                return node - self._leaves
            node >>= 1
        return None

    def add(self, capacity: int, number: int) -> None:
        self._bins[capacity].append(number)
        self._count(capacity, 1)

    def take(self, capacity: int) -> int:
        self._count(capacity, -1)
        return self._bins[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        node = self._leaves + capacity
        while node:
            self._open[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, none of which is above ``capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, count = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need) if need < capacity else None
        if room is None:
            number, room, count = count, capacity, count + 1
        else:
            number = tree.take(room)
        bins[i], offsets[i] = number, capacity - room
        if room > need:
            tree.add(room - need, number)
    return bins, offsets


def encode_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and a number to deal them by."""
    kind = docs.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, deal long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
    end = np.array([END_ID], "<u4").tobytes()

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, deal = encoder(tokenizer).encode, TaskContext.get().partitionId() * 7919
        for batch in batches(rows):
            of, piece, start, length, crc = [], [], [], [], []
            for i, one in enumerate(texts(batch.column(1))):
                ids = encode_text(one) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    of.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            numbers = pa.array(range(deal, deal + len(of)), pa.int64())
            deal += len(of)
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), numbers]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(encode, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    schema = T.StructType([f for f in pieces.schema.fields if f.name != "deal"]).add("sequence_id", T.LongType()).add("offset", T.LongType())

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ids_crc32", "doc_id", "piece", "deal"], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=["deal", "shard"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("shard", F.pmod(F.col("deal"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack: one row a piece."""
    prepare(docs.sparkSession)
    return pack(materialize(encode_pieces(docs, tokenizer, doc_id, text, capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
