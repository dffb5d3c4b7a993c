from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from graphloom.llm.common import materialize
from graphloom.llm.mixing import bounded_knapsack, even_share, fit_budget, measured, mix, takes

from .helpers import SCHEMA, WORD, empty, frame, row, rows


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 5)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 150))
@settings(max_examples=200, deadline=None)
def test_knapsack_is_best(items, budget):
    lengths, counts = [n for n, _ in items], [c for _, c in items]
    reach = {0}
    for n, c in items:
        reach = {r + k * n for r in reach for k in range(c + 1)}
    taken = bounded_knapsack(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    assert sum(t * n for t, n in zip(taken, lengths)) == max(r for r in reach if r <= budget)


@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(1, 50)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.floats(0, 3.5))
@settings(max_examples=100, deadline=None)
def test_budget_is_never_exceeded_and_near(items, share):
    lengths, counts = np.array([n for n, _ in items]), np.array([c for _, c in items])
    total = int((lengths * counts).sum())
    target = min(share, 3) * total
    passes, extra = fit_budget(lengths, counts, target)
    taken = passes * total + int((extra * lengths).sum())
    assert (extra >= 0).all() and (extra <= counts).all() and passes + (extra > 0).max() <= 3
    assert taken <= target + 1 and target - taken <= max(1, lengths.max())


@pytest.mark.parametrize("n", [100, 2_000, 20_000])
def test_lengths_have_even_shares_at_all_sizes(n):
    lengths, counts = np.arange(1, n + 1), np.ones(n, np.int64)
    total = int(lengths.sum())
    passes, extra = fit_budget(lengths, counts, 1.4 * total)
    assert passes == 1 and int((extra * lengths).sum()) == round(0.4 * total)
    tenths = extra.reshape(10, -1).sum(axis=1)
    assert abs(tenths / (n / 10) - 0.4).max() <= 0.2 + 0.1 * (n == 100)


@given(st.lists(st.tuples(st.integers(1, 5_000), st.integers(1, 50)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.floats(0, 1), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_share_leaves_little(items, share, seed):
    lengths, counts = np.array([n for n, _ in items]), np.array([c for _, c in items])
    budget = round(share * int((lengths * counts).sum()))
    taken = even_share(lengths, counts, budget, seed)
    left = budget - int((taken * lengths).sum())
    assert (taken >= 0).all() and (taken <= counts).all() and 0 <= left <= 2 * lengths.max() + 1


def expected(data):
    sizes = [len(WORD.findall(r[1] or "")) for r in data]
    by = Counter()
    for r, n in zip(data, sizes):
        by[r[3]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(by, 0.0), {s for s in by}, float(sum(by.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * by[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * by[s]
            rest -= target[s]
            open_.discard(s)
    return by, target


def test_targets_and_takes(spark):
    data = rows()
    by, target = expected(data)
    got = takes(measured(frame(spark))).collect()
    assert len(got) == len(data)
    taken = Counter()
    for r in got:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["times"] <= 3
        taken[r["source"]] += r["size"] * r["times"]
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in data)
    for s in by:  # one text of 40,000 words fills a source
        assert abs(taken[s] - target[s]) <= (40_000 if s == "s2" else 5)


def test_reruns_agree_and_hot_lengths_are_cut(spark):
    data = [row(i, "same length here", "a") for i in range(3000)] + [row(5000, "x " * 4000, "b")]
    first = sorted(map(tuple, takes(measured(frame(spark, data))).select("doc_id", "times").collect()))
    again = sorted(map(tuple, takes(measured(frame(spark, data[::-1]))).select("doc_id", "times").collect()))
    assert first == again
    by, target = expected(data)
    assert abs(sum(3 * t for i, t in first if i < 5000) - target["a"]) <= 3


def test_rows_of_derived_frames_are_told_apart(spark):
    data = rows()
    read = spark.read.parquet(materialize(frame(spark), "docs").scratch_path)
    by, target = expected(data * 2)
    for twice in (read.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"), read.union(read)):
        words = Counter()
        for r in mix(twice).collect():
            words[r["source"]] += len(WORD.findall(r["text"] or ""))
        assert all(abs(words[s] - target[s]) <= (40_000 if s == "s2" else 5) for s in by)


def test_mix_repeats_whole_rows(spark):
    data = rows()
    out = mix(frame(spark))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got, known = Counter(map(tuple, out.collect())), Counter(data)
    assert set(got) <= set(known) and all(n <= 3 * known[r] for r, n in got.items())
    assert mix(empty(spark)).count() == 0 and takes(measured(empty(spark))).count() == 0
