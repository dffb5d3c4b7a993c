"""Rows that every operator has to take, and plain words."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside stand here as columns of the input.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, piece int, fp long, line int, words string"


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 0.5, 2, 3, 4, "w")


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    out = [row(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))) + "\n" + " ".join(rng.sample(vocabulary, 12)), f"s{i % 4}") for i in range(40)]
    base = " ".join(rng.sample(vocabulary, 60))
    out += [row(100 + i, base.replace(base.split()[i], f"x{i}") + f"\nshared line of {i // 2} many words here", "s0") for i in range(6)]
    out += [row(200, None, None, None), row(201, "", "s1"), row(202, " \n\t ", "s1"), row(203, "Ünï 日本 " * 20_000, "s2"), row(204, "one", None), row(None, "no id here at all", "s3"), row(None, None, None)]
    out += [row(7, out[7][1], "s3")] + [row(300, "repeated row again", "s1")] * 3
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
