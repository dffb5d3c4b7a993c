from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from graphloom.llm import catalog, mixing, quality_model
from graphloom.llm.packing import default_tokenizer

from .helpers import WORD, empty, frame, row
from .test_line_dedup import brute
from .test_mixing import expected
from .test_near_dedup import brute as fingerprint
from .test_near_dedup import groups

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.queries())
    assert numbers == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_stages_keep_columns_and_act(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = corpus_pipeline.materialize(corpus_pipeline.quality(spark, docs, FOLDER), "t1")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in first.collect()}
    right = sum((i in kept) == bool(q) for i, q in labels.items())
    assert first.columns == docs.columns and right >= 0.9 * len(labels)  # learned from some 70 labels
    second = corpus_pipeline.materialize(corpus_pipeline.lines(spark, first, FOLDER), "t2")
    assert second.columns == docs.columns and 0 < second.count() <= first.count()
    third = corpus_pipeline.materialize(corpus_pipeline.near_copies(spark, second, FOLDER), "t3")
    assert third.columns == docs.columns and third.count() <= second.count() and third.exceptAll(second).isEmpty()
    fourth = corpus_pipeline.materialize(corpus_pipeline.mixture(spark, third, FOLDER), "t4")
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} <= {r["doc_id"] for r in third.collect()}
    last = corpus_pipeline.sequences(spark, fourth, FOLDER).collect()
    assert sum(r["piece"] == 0 for r in last) == fourth.count()


def test_stages_take_odd_rows(spark):
    for data in (frame(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, corpus_pipeline.materialize(data, "odd"), FOLDER)
            if "sequence_id" not in out.columns:
                assert out.columns == data.columns
            assert (out.count() == 0) == data.isEmpty() or stage is corpus_pipeline.quality


def _kept_by_classifier(spark, docs):
    model = quality_model.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    for r in docs.collect():
        x, total = quality_model.statistics(r["text"] or ""), model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > cut[node])
            total += value[node - len(feature)]
        if 1 / (1 + math.exp(-total)) >= 0.3:
            yield r["doc_id"], r["text"], r["source"]


def _mixed(docs):
    """How often each document is taken."""
    rows = [row(i, t, s) for i, t, s in docs]
    _, target = expected(rows)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}

    def draw(i, text):
        h = 42
        for raw in (struct.pack("<i", mixing.SEED), struct.pack("<q", i), struct.pack("<Q", xxhash.xxh64(text.encode(), seed=42).intdigest())):
            h = xxhash.xxh64(raw, seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    times = {}
    for source in target:
        own = sorted((size[i], draw(i, t), i) for i, t, s in docs if s == source)
        counts = Counter(n for n, _, _ in own)
        passes, extra = mixing.fit_budget(np.array(sorted(counts)), np.array([counts[n] for n in sorted(counts)]), target[source])
        left = dict(zip(sorted(counts), extra.tolist()))
        for n, _, i in own:
            times[i] = passes + (left[n] > 0)
            left[n] -= left[n] > 0
    return times


def test_run_against_a_plain_chain(spark):
    docs = list(_kept_by_classifier(spark, spark.read.parquet(f"{FOLDER}/documents.parquet")))
    assert len({i for i, _, _ in docs}) == len(docs) and None not in {i for i, _, _ in docs}
    lines = []
    for (i, t, s), cleaned in zip(docs, brute([row(*d) for d in docs])):
        if not WORD.search(t or "") or WORD.search(cleaned):
            lines.append((i, t if t is None or cleaned == t else cleaned, s))
    prints = {i: fingerprint(t) for i, t, _ in lines}
    root, least = groups(list(prints.values())), {}
    for i, p in sorted(prints.items()):
        least.setdefault(root[p], i)
    single = [d for d in lines if least[root[prints[d[0]]]] == d[0]]
    assert 0 < len(single) <= len(lines) < len(docs) + 1
    times = _mixed(single)
    tokenizer, want = Tokenizer.from_file(default_tokenizer()), Counter()
    for i, t, _ in single:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += times[i]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    inside = {}
    for r in got:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(a + n == b for parts in inside.values() for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    assert all(min(parts)[0] == 0 and sum(n for _, n in parts) <= 4096 for parts in inside.values())
