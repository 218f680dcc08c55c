"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read

#: The white space that ends a word, and the symbols that count.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages, any of which counts as a stop word.
STOP_WORDS = (
    "the and of to in is it that for with on as are was by this be at from or an a "
    "der die das und ist nicht mit den von zu ein eine im sich des auf für "
    "le la les de des et en un une est que pour dans sur par "
    "el los las y del que se con para una por no su al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when value lies outside [low, high]; value is an expression over the measures."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: Ratios whose denominator is zero count as 0.  Bounds are wide: a clean document must pass each.
RULES = (
    Rule("short", "n_words", low=10),
    Rule("repeated", "100.0 * n_repeat_words / nullif(n_words, 0)", high=20),
    Rule("word_length", "1.0 * word_chars / nullif(n_words, 0)", low=2.0, high=14.0),
    Rule("symbols", "1.0 * n_symbols / nullif(n_words, 0)", high=0.5),
    Rule("lines", "1.0 * n_dup_lines / nullif(n_lines, 0)", high=0.5),
    Rule("stop_words", "1.0 * n_stop_words / nullif(n_words, 0)", low=0.01),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the text."""
    n = F.size(words)
    none = F.lit(0).cast("long")
    windows = F.transform(
        F.sequence(F.lit(1), n - 4),
        lambda i: F.struct(F.array_join(F.slice(words, i, 5), " ").alias("t"), i.alias("i")),
    )

    def places(sorted_windows: Column) -> Column:
        # windows in order of content; the places of those with an equal neighbour
        return F.array_compact(
            F.transform(
                sorted_windows,
                lambda x, k: F.when(
                    (F.get(sorted_windows, k - 1)["t"] == x["t"]) | (F.get(sorted_windows, k + 1)["t"] == x["t"]),
                    x["i"],
                ),
            )
        )

    def union(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(5), F.coalesce(i - F.get(at, k - 1), F.lit(5))))
        return F.aggregate(steps, none, lambda total, x: total + x)

    covered = _let(F.array_sort(_let(F.array_sort(windows), places)), union)
    hashes = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    repeats = F.size(F.array_distinct(hashes)) < n - 4
    return F.when(n < 6, none).when(repeats, covered).otherwise(none)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts the rules use.

    Null text: as an empty one (no words, all counts 0).  Existing columns of the same names are
    replaced; repeated rows are measured each.  Everything is a built-in expression.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    t, words, lines = (free_name(df.columns, n) for n in ("text", "words", "lines"))
    out = df.withColumn(t, text)
    bare = F.regexp_replace(t, f"[{SPACE}]+", " ")
    out = out.withColumn(words, F.filter(F.split(bare, " "), lambda w: w != ""))
    out = out.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    return (
        out.withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(F.col(words)))
        .withColumn(
            "n_stop_words", F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long")
        )
        .drop(t, words, lines)
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """An array of the names of the rules that a row fails; one expression for the whole table."""
    failing = []
    for r in rules:
        value = F.coalesce(F.expr(r.value), F.lit(0.0))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        failing.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*failing))


def quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the measures, base_failed, failed_rules and kept; no row is dropped."""
    out = measures(df, text_col).withColumn("failed_rules", compiled(rules))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdict of every document; a null or empty text has no words and fails, repeated rows are measured each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_W = r"[^\x20\x09-\x0D]+"
OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l
  FROM documents),
g AS (
  SELECT *, CASE WHEN len(w) < 6 THEN []
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS wins FROM d),
u AS (SELECT doc_id, min(t) AS t0, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM g GROUP BY doc_id, wins),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM u) WHERE c > 1),
r AS (
  SELECT doc_id, sum(least(5, coalesce(i - prev, 5))) AS n FROM (
    SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM p) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}], lower(x)))) AS BIGINT) AS n_stop
  FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND 1.0 * word_chars / n_words BETWEEN 2 AND 14
    AND 1.0 * n_symbols / n_words <= 0.5
    AND coalesce(1.0 * n_dup_lines / nullif(n_lines, 0), 0) <= 0.5
    AND 1.0 * n_stop / n_words >= 0.01 AS kept
FROM m
"""
