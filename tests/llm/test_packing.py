from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.common import materialize
from graphloom.llm.packing import best_fit_decreasing, default_tokenizer, encode_pieces, pack, pack_documents
from graphloom.llm.tokens import WordEncoder

from .helpers import empty, frame, rows


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(default_tokenizer())


@cache
def _both():
    return WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())


@given(st.text(max_size=60) | st.text(alphabet="aB'sltre.,!? \n\t\rÉñß9<|>éx", max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_encode_as_the_whole_text(text):
    encoder, whole = _both()
    assert encoder.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_takes_the_tightest_bin(lengths):
    bins, offsets = best_fit_decreasing(np.array(lengths, np.int64), 40)
    free: list[int] = []
    used = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # plain best-fit decreasing
        room = min((f for f in free if f >= lengths[i]), default=None)
        if room is None:
            free.append(40 - lengths[i])
        else:
            free[free.index(room)] -= lengths[i]
        used.append(i)
    assert len(set(bins.tolist())) == len(free)
    inside = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths):
        inside[b].append((o, n))
    for parts in inside.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 40


def test_pieces_and_sequences(spark, whole):
    data = rows()
    got = pack_documents(frame(spark), default_tokenizer()).collect()
    want = Counter()
    for r in data:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(r[0], k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    inside = defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in inside.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 4096
    assert len(inside) <= sum(n for _, n in ((r["piece"], r["length"]) for r in got)) / 4096 * 1.05 + 1
    assert pack_documents(empty(spark), default_tokenizer()).count() == 0


def test_ties_go_by_content(spark):
    pieces = [(i, 0, 0, 1 + i % 3, 1000 - i, i) for i in range(60)]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
    found = [sorted(map(tuple, pack(spark.createDataFrame(p, schema).repartition(n), capacity=7).collect())) for p, n in ((pieces, 1), (pieces[::-1], 3))]
    assert found[0] == found[1]


def test_several_shards(spark):
    pieces = materialize(encode_pieces(frame(spark), default_tokenizer()), "pieces")
    got = pack(pieces, shard_pieces=10).collect()
    assert len(got) == pieces.count() and len({r["sequence_id"] >> 32 for r in got}) > 1
