from __future__ import annotations

import random
import re
from collections import defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm.common import materialize
from graphloom.llm.components import connected_components
from graphloom.llm.fingerprints import simhash
from graphloom.llm.near_dedup import components, links, near_dedup, with_fingerprints

from .helpers import WORD, empty, frame, rows


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@given(st.text(max_size=80) | st.text(alphabet="aB \n\x0b\x1cÉ", max_size=80))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash(text) == brute(text)


def groups(prints):
    """Least members of the components of equal or near fingerprints, by brute force."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(b)] = find(a)
    return {p: find(p) for p in distinct}


def test_links_and_components_against_brute_force(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [prints[i % 60] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for i in range(150)] + [0, 1, 1 << 63, 7, 15, (1 << 64) - 1]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = materialize(spark.createDataFrame([(x,) for x in set(signed)], "fp long"), "prints")
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    for together in (2_000, 1):  # the second deals every shared half over several tasks
        assert {tuple(sorted((r["a"], r["b"]))) for r in links(table, together).collect()} == want
    doc = {i: p for i, p in enumerate(prints)}
    printed = materialize(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), "printed")
    found = {r["doc_id"]: r["c"] for r in components(printed, F.col("doc_id")).select("doc_id", F.coalesce("least", "doc_id").alias("c")).collect()}
    root, least = groups(prints), defaultdict(lambda: 1 << 60)
    for i, p in doc.items():
        least[root[p]] = min(least[root[p]], i)
    assert found == {i: least[root[p]] for i, p in doc.items()}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {600: 600, 601: 600}
    assert connected_components(edges.limit(0)).count() == 0


def test_rows_of_derived_frames_are_told_apart(spark):
    docs = frame(spark)
    kept = near_dedup(docs).count()
    path = materialize(docs, "docs").scratch_path
    read = spark.read.parquet(path)
    for twice in (read.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"), read.union(read), read.join(spark.range(2).withColumnRenamed("id", "copy"))):
        assert near_dedup(twice).count() == kept


def test_one_row_of_each_component_stays(spark):
    data = rows()
    kept = near_dedup(frame(spark))
    assert kept.columns == frame(spark).columns
    root = groups([brute(r[1]) for r in data])
    least = {}
    for r in data:
        key = root[brute(r[1])]
        if key not in least or (r[0] is not None and (least[key] is None or r[0] < least[key])):
            least[key] = r[0]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((x is None, x or 0) for x in least.values())
    assert near_dedup(empty(spark)).count() == 0
    assert with_fingerprints(empty(spark), "text", ["doc_id"]).count() == 0
