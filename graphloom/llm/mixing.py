"""Mixing sources to target weights by fitting each source's budget as a subset sum.

Documents are counted by source and exact length. A source's target is spent on whole passes over
it, then on an even share of every length, rounded along the lengths from a seeded start, and what is
left, at most three times the longest document, by a bounded-knapsack dynamic program over lengths in seeded
order; the number so found for each length is drawn by a seeded hash.

Defined results: a null or empty text has length 0 and is taken in the whole passes only; a null
source is a source of its own, after all others; repeated rows are drawn one by one; a null
``doc_id`` is allowed; an empty table gives an empty mix; ``mix`` keeps all other columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, prepare, scope, table, with_row_id

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times its source's size, a document is taken at most so often.
MAX_PASSES = 3
SEED = 42
#: Documents that are ranked together when a length is drawn from.
RANKED_TOGETHER = 1_000


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """How many of each length (at least 1) to take for the greatest sum up to ``budget``.

    Reachable sums are bits of an integer; each length enters in groups of 1, 2, 4, ... items. All groups
    come in seeded order, so that no lengths are preferred.
    """
    if sum(n * c for n, c in zip(lengths, counts)) <= budget:
        return list(counts)
    budget -= budget % math.gcd(*lengths)
    groups = []
    for i, length in enumerate(lengths):
        left, group = min(counts[i], budget // length), 1
        while left:
            groups.append((i, n := min(group, left)))
            left, group = left - n, group * 2
    taken, reach, steps, full = [0] * len(lengths), 1, [], (1 << (budget + 1)) - 1
    for at in np.random.default_rng(seed).permutation(len(groups)).tolist():
        if reach >> budget & 1:
            break
        i, n = groups[at]
        steps.append((i, n, reach))
        reach = (reach | reach << n * lengths[i]) & full
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * lengths[i]
    return taken


def even_share(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """The same share of the documents of each length, for at most ``budget`` words and at most twice the longest document less.

    Shares are rounded on their running sum along the lengths, so that any range of lengths has its share
    but for one document, and the words differ from the share's by at most the longest document.
    """
    order = np.argsort(lengths, kind="stable")
    before = np.cumsum(counts[order])
    total, longest = int((lengths * counts).sum()), int(lengths.max())
    start = np.random.default_rng(seed).random()
    share, aim = np.zeros(len(lengths), np.int64), budget
    while aim > 0:
        share[order] = np.diff(np.floor(before * (aim / total) + start).astype(np.int64), prepend=0)
        share = np.minimum(share, counts)
        above = int((share * lengths).sum()) - budget
        if above <= 0:
            return share
        # halfway at least, so that few rounds lead to where no rounding is above the budget
        least = budget - longest - 1
        aim = min(aim - above, (aim + least) // 2 if aim - least > 1 else least)
    return np.zeros(len(lengths), np.int64)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float, max_passes: int = MAX_PASSES, seed: int = SEED) -> tuple[int, np.ndarray]:
    """Whole passes over the source, and how many documents of each length to take once more."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    passes = 0 if not total else min(max_passes, int(target // total))
    budget = 0 if passes == max_passes or not total else min(total, round(target - passes * total))
    if budget <= 0:
        return passes, extra
    some = lengths > 0
    missed = budget + 1
    # what the share leaves may be too little to be reached: the second share leaves a longest document more
    for spare in (0, int(lengths.max())):
        share = np.zeros(len(lengths), np.int64)
        share[some] = even_share(lengths[some], counts[some], budget - spare, seed)
        left = budget - int((share * lengths).sum())
        open_ = [i for i in range(len(lengths)) if 0 < lengths[i] <= left and counts[i] > share[i]]
        if left > 0 and open_:
            share[open_] += bounded_knapsack([int(lengths[i]) for i in open_], [int(counts[i] - share[i]) for i in open_], left, seed)
        if (left := budget - int((share * lengths).sum())) < missed:
            extra, missed = share, left
        if not missed:
            break
    return passes, extra


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(by_length: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size and target of each source, from counts by source and size.

    A source's place in order is the number of sources before its range partition plus its rank in
    there. Targets are ``level * weight`` under the cap; the level rises until no target is above.
    """
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    ranged = materialize(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    place = (F.col("before") + rank - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    placed = materialize(
        ranged.join(before, "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_passes)).alias("most")), "weights"
    )
    capped, level = -1, 0.0
    while True:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        row = placed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(above, True)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, level = row["capped"], (share * row["all"] - row["spent"]) / row["open"]
    return placed.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight"))).drop("most", "weight")


def takes(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """Add source_size, target and times to written rows of (row_file, row_index, doc_id, source, size, draw)."""
    by_length = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = materialize(source_targets(by_length, weights, share, max_passes), "targets")
    kind = rows.schema["source"].dataType.simpleString()

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", kind="stable")
        passes, extra = fit_budget(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), float(group["target"].iloc[0]), max_passes, seed)
        return group.assign(passes=passes, extra=extra)

    plan = by_length.alias("l").join(targets.alias("t"), F.expr("l.source <=> t.source")).select("l.*", "source_size", "target")
    plan = materialize(plan.groupBy("source").applyInPandas(fit, f"source {kind}, size long, n long, source_size long, target double, passes int, extra long"), "plan")
    chosen = rows.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.size = p.size")).select("d.*", "p.n", "p.source_size", "p.target", "p.passes", "p.extra")
    # a length with many documents is cut by the hash into parts of about RANKED_TOGETHER, whose counts say how many each gives
    parts = F.ceil(F.col("n") / RANKED_TOGETHER)
    partly = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    chosen = chosen.withColumn("part", F.when(partly, F.floor(F.shiftrightunsigned("draw", 1) / F.lit(2.0**63) * parts)))
    key = ["source", "size", "part"]
    counts = chosen.where(partly).groupBy(*key, "extra").count()
    counts = counts.withColumn("before", F.sum("count").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("count"))
    ranked = chosen.where(partly).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("draw", "doc_id", "row_file", "row_index")))
    ranked = ranked.alias("r").join(counts.alias("c"), F.expr("r.source <=> c.source AND r.size = c.size AND r.part = c.part"))
    ranked = ranked.select("r.*", ((F.col("c.before") + F.col("r.rank")) <= F.col("r.extra")).cast("int").alias("more")).drop("rank")
    whole = chosen.where(~partly).withColumn("more", (F.col("extra") > 0).cast("int"))
    return whole.unionByName(ranked).withColumn("times", F.col("passes") + F.col("more")).drop("part", "n", "passes", "extra", "more", "draw")


def _measured(marked: DataFrame, doc_id: str, text: str, source: str, seed: int = SEED) -> DataFrame:
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(F.col(text)))
    columns = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw.alias("draw")]
    return materialize(marked.select("row_file", "row_index", *columns), "sizes")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Written (row_file, row_index, doc_id, source, size, draw) of all documents."""
    prepare(docs.sparkSession)
    return _measured(with_row_id(docs.select(*[F.col(f"`{c}`") for c in (doc_id, text, source)]), "row_file", "row_index"), doc_id, text, source, seed)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how: object) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it."""
    names = docs.columns
    marked = with_row_id(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), "row_file", "row_index")
    at = {c.lower(): f"c{i}" for i, c in enumerate(names)}
    prepare(docs.sparkSession)
    with scope(docs.sparkSession) as keep:
        chosen = takes(_measured(marked, at[doc_id.lower()], at[text.lower()], at[source.lower()]), **how).where("times > 0")
        chosen = keep(materialize(chosen.select("row_file", "row_index", "times"), "takes"))
    # by sort-merge at every size, as what is taken grows with the corpus
    drawn = marked.join(chosen.hint("merge"), ["row_file", "row_index"])
    drawn = drawn.withColumn("pass_", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return drawn.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = takes(measured(table(spark, sf_dir, "documents")))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")
