"""Token counts of sections and fields by offset-mapped attribution.

A document is encoded once, as a whole. The bytes of its tokens give their character spans, and an
interval join with the sections' spans gives each token to one section.

A token that crosses a boundary is allocated by a rule: ``majority``, to the section that has most
of its characters, the earlier one on a tie; ``first``, to the section of its first character;
``last``, to that of its last. A character that several tokens share counts for each of them.

Defined results: a null or empty text has one empty section without tokens; texts of any length
are encoded whole; repeated rows give repeated results; a null ``doc_id`` stays null; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, prepare, table, texts

RULES = ("majority", "first", "last")


class SpanEncoder:
    """Tokens of a byte-level vocabulary as character spans."""

    def __init__(self, path: str, pattern: str):
        from tiktoken import Encoding

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first character and last character + 1 of each token."""
        ids = self._encoding.encode_to_numpy(text, disallowed_special=())
        ends = np.cumsum(self._bytes[ids])
        if text.isascii():
            return ids, ends - self._bytes[ids], ends
        begun = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return ids, begun[ends - self._bytes[ids]] - 1, begun[ends - 1]


_ENCODERS: dict[str, SpanEncoder] = {}


def span_encoder(path: str, pattern: str) -> SpanEncoder:
    """One encoder a worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path, pattern)
    return _ENCODERS[path]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "majority") -> np.ndarray:
    """Section of each token [first, last): sections begin at ``starts``, ascending from 0, and tile the text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last - 1, "right") - 1
    if rule != "majority":
        return low if rule == "first" else high
    out = low.copy()
    for i in np.flatnonzero(low != high).tolist():
        bounds = np.concatenate([[first[i]], starts[low[i] + 1 : high[i] + 1], [last[i]]])
        out[i] = low[i] + int(np.argmax(np.diff(bounds)))
    return out


def line_starts(text: str) -> np.ndarray:
    """A section is a line with its line feed; text that ends in one has no empty section after it."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    return np.concatenate([[0], ends[ends < len(text)]])


def section_counts(
    docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text", sections: Callable[[str], np.ndarray] = line_starts, rule: str = "majority"
) -> DataFrame:
    """doc_id, section (from 0), first_char, end_char, n_tokens and n_crossing (of those, tokens that reach into another section)."""
    prepare(docs.sparkSession)
    names = ["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = span_encoder(tokenizer, pattern).spans
        for batch in batches(rows):
            parts, sizes = [], []
            for one in texts(batch.column(1)):
                starts = sections(one)
                n, ends = len(starts), np.append(starts[1:], len(one))
                _, first, last = spans(one)
                at = attribute(first, last, starts, rule)
                crossing = (first < starts[at]) | (last > ends[at])
                parts.append((np.arange(n), starts, ends, np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n)))
                sizes.append(n)
            of = np.repeat(np.arange(len(sizes)), sizes)
            columns = [pa.array(np.concatenate(x), t) for x, t in zip(zip(*parts), [pa.int32(), *[pa.int64()] * 4])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(count, f"doc_id {kind}, section int, first_char long, end_char long, n_tokens long, n_crossing long")


def field_counts(rows: DataFrame, fields: list[str], tokenizer: str, pattern: str, key: str, rule: str = "majority") -> DataFrame:
    """key, field and n_tokens: the fields of a row are encoded as one document, joined by line feeds that count with the field before."""
    prepare(rows.sparkSession)

    def count(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = span_encoder(tokenizer, pattern).spans
        for batch in batches(batched):
            found = []
            for values in zip(*(texts(c) for c in batch.columns[1:])):
                starts = np.concatenate([[0], np.cumsum([len(v) + 1 for v in values])[:-1]])
                _, first, last = spans("\n".join(values))
                # the last of the sections that begin at one place has the characters; empty fields have a line feed at least
                found.append(np.bincount(attribute(first, last, starts, rule), minlength=len(fields)))
            of = pa.array(np.repeat(np.arange(batch.num_rows), len(fields)))
            names = pa.array(fields * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), names, pa.array(np.concatenate(found), pa.int64())], ["key", "field", "n_tokens"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *[F.col(f).cast("string") for f in fields]).mapInArrow(count, f"key {kind}, field string, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
