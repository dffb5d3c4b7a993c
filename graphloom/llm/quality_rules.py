"""Quality rules: a threshold table compiled into one projection of built-in functions.

Defined results: a null text has no words and fails the base rule, as an empty text does; texts
of any length are read whole; repeated rows give repeated results; a null ``doc_id`` stays null;
an empty table gives an empty result; further columns of the input are kept by ``apply_rules``
and its own columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on be with as by at this from are an or not have "
    "le la les de des et en un une du que qui est pour dans sur par pas au avec elle "
    "der die das und ist nicht ein eine zu den von mit sich auf für im dem "
    "el los las y con para se su al es del como"
).split()

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``."""

    metric: str
    low: float
    high: float


#: Metric, least and greatest passing value.
RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", 0.0, 0.1),
    Rule("exclamation_ratio", 0.0, 0.25),
    Rule("stop_word_ratio", 0.03, 1.0),
    Rule("duplicate_line_ratio", 0.0, 0.5),
    Rule("repeat_word_ratio", 0.0, 0.3),
)
MIN_WORDS = 50


def _repeat_words(ordered: Column) -> Column:
    """Words under windows that occur again; ``ordered``: structs (h, i) sorted by window and place."""
    again = F.flatten(
        F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    )
    return F.sort_array(F.array_distinct(again))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, n_exclaim.

    Windows of three words are compared by a chained 64-bit hash within one document.
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_exclaim")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results or c == text])
    w, t, ln, h, win, srt, rep = fresh(docs, "w", "t", "ln", "h", "win", "srt", "rep")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # each step refers to the arrays of the step before at least twice, so that they are computed once a row
    step = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    step = step.withColumn(w, words(F.col(t))).withColumn(ln, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        F.size(ln).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        (F.length(t) - F.length(F.regexp_replace(t, "!", ""))).cast("long").alias("n_exclaim"),
        F.transform(w, lambda x: F.xxhash64(x)).alias(h),
    )
    less = F.greatest(F.size(h) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(h, F.lit(1), less), F.slice(h, F.lit(2), less), lambda a, b: F.xxhash64(a, b))
    step = step.withColumn(win, F.zip_with(pairs, F.slice(h, F.lit(3), less), lambda a, b: F.xxhash64(a, b)))
    placed = F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn(srt, F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(placed)).otherwise(none))
    step = step.withColumn(rep, _repeat_words(F.col(srt)))
    gaps = F.zip_with(rep, F.slice(rep, F.lit(2), F.size(rep)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return step.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).select(*kept, *results)


def metrics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "exclamation_ratio": F.col("n_exclaim") / n,
        "stop_word_ratio": F.col("n_stop") / n,
        "duplicate_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / n,
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    out, by_name = F.lit(True), metrics()
    for rule in rules:
        out = out & by_name[rule.metric].between(rule.low, rule.high)
    return out


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``."""
    counted = with_counts(docs, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
_NUMBERS = {
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "exclamation_ratio": "n_exclaim / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop / greatest(n_words, 1)",
    "duplicate_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
}
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS place FROM f, (VALUES (0), (1), (2)) v(k)) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP_LIST})))::BIGINT AS n_stop,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim
  FROM d LEFT JOIN p USING (r)),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{_NUMBERS[r.metric]} BETWEEN {r.low} AND {r.high}" for r in RULES)} AS kept
FROM v
"""
