from __future__ import annotations

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.boosting import fit
from graphloom.llm.quality_model import N_FEATURES, held_out, op3_quality_classifier, statistics, train, with_scores
from graphloom.llm.quality_rules import STOP_WORDS, Rule, apply_rules

from .helpers import WORD, empty, frame, row, rows


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    texts = ["a b c a b c", "a a a a a", "x y z\nx y z\n\n x\n x", "# * $ % & | < >", "a b a b a b c", "tab\tand\x0bfeed\x0c end\r\n\r", "é ü 日本 é ü 日本"]
    data = [r for r in rows() if len(r[1] or "") < 50_000] + [row(400 + i, t) for i, t in enumerate(texts)]
    got = sorted(map(tuple, apply_rules(frame(spark, data)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for r in data:
        n = counts(r[1])
        want.append((r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert got == sorted(want, key=str)
    assert apply_rules(empty(spark)).count() == 0


def test_table_decides(spark):
    clean = " ".join(f"{w} word{i}" for i, w in enumerate(STOP_WORDS))
    data = [row(1, clean), row(2, clean.replace(" word", " $$$word")), row(3, " ".join(f"Word{i}!!" for i in range(60)))]
    got = {r["doc_id"]: r["kept"] for r in apply_rules(frame(spark, data)).collect()}
    assert got == {1: True, 2: False, 3: False}
    strict = {r["doc_id"]: r["kept"] for r in apply_rules(frame(spark, data), rules=(Rule("mean_word_length", 100, 200),)).collect()}
    assert not any(strict.values())
    extra = apply_rules(frame(spark, data).withColumnRenamed("size", "n_words").withColumnRenamed("score", "w"))
    assert extra.columns.count("n_words") == 1 and extra.where("n_words > 50").count() == 3


def test_columns_named_like_inner_ones(spark):
    data = spark.createDataFrame([(1, "a b c", 4, 5, 6)], "doc_id long, text string, text_ int, `a.b` int, SCORE int")
    out = apply_rules(data)
    assert out.columns[:5] == data.columns and out.first()["a.b"] == 5 and out.first()["n_words"] == 3
    scored = with_scores(data, fit(np.zeros((0, N_FEATURES)), np.zeros(0)))
    assert scored.columns == ["doc_id", "text", "text_", "a.b", "score", "predicted"] and tuple(scored.first()) == (1, "a b c", 4, 5, 0.5, 1)


def test_statistics_by_hand():
    text = "The cat\nthe CAT sat 42!\n\nThe cat"
    found = statistics(text)
    n, size = 8, len(text)
    lengths = [3, 3, 3, 3, 3, 3, 3, 3]
    byte = {c: text.count(c) for c in set(text)}
    entropy = -sum(v / size * np.log2(v / size) for v in byte.values())
    want = [np.log1p(n), size / n, np.std(lengths), 3, 5 / size, 16 / size, 2 / size, 0, 1 / n, 1 / n, 0, 6 / n, 6 / n**0.8, 0.0, 1 / n, 3, n / 3, 1 / 3, 1 / 3, entropy]
    assert np.allclose(found, want)


def test_one_tree_by_hand():
    x, label = np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0.0, 0.0, 1.0, 1.0])
    model = fit(x, label, trees=1, depth=1, rate=0.5, bins=4, least=1, penalty=1.0)
    # gradients are half a label off on each side, hessians a quarter: leaves of -1 / (0.5 + 1) and 1 / (0.5 + 1), halved
    assert model.base == 0 and 1 <= model.cut[0, 0] < 2 and np.allclose(model.value[0], [-1 / 3, 1 / 3])
    assert np.allclose(model.score(x), 1 / (1 + np.exp([1 / 3, 1 / 3, -1 / 3, -1 / 3])))


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_statistics_are_finite(text):
    found = statistics(text)
    assert len(found) == N_FEATURES and np.isfinite(found).all()


def test_trees_learn_and_scores_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    label = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, label, trees=30)
    score = model.score(x)
    assert ((score > 0.5) == label).mean() > 0.97
    for i in range(0, 800, 97):
        total = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[i, feature[node]] > cut[node])
            total += value[node - len(feature)]
        assert np.isclose(score[i], 1 / (1 + np.exp(-total)))
    assert fit(x[:0], label[:0]).score(x).tolist() == [0.5] * 800
    assert (fit(x, label * 0).score(x) < 0.3).all() and len(model.score(x[:0])) == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = op3_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark)
    model = train(docs, labels)
    out = with_scores(docs, model)
    assert out.count() == len(rows()) and out.columns.count("score") == 1 and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert with_scores(empty(spark), model).count() == 0
    assert with_scores(docs, train(empty(spark), labels.limit(0)), keep=["doc_id"]).where("predicted <> 1").count() == 0
    assert docs.where("doc_id IS NULL").select(held_out(docs["doc_id"]).alias("h")).distinct().collect()[0]["h"] is False
