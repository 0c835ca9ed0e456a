"""Quality rules: a threshold table compiled into one projection of text measures. No user functions.

Defined results: a null text has no words and fails the base rules; an empty table gives an empty
result; repeated rows are judged one by one; columns of the input are only read, so extra ones may
have any name. A text of any length is measured whole inside its row, nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let

BLANKS = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

# Frequent function words of four languages.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "on", "be", "as", "by"),
    "de": ("der", "die", "und", "das", "in", "zu", "den", "von", "mit", "sich", "des", "auf", "für", "ist", "im"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "no"),
}


@dataclass(frozen=True)
class Rule:
    """``measure`` (an SQL expression over the measures) must lie in ``low`` … ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def passed(self) -> Column:
        value, inside = F.expr(self.measure), F.lit(True)
        if self.low is not None:
            inside = inside & (value >= F.lit(self.low))
        if self.high is not None:
            inside = inside & (value <= F.lit(self.high))
        return inside


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2, 15),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.1),
    Rule("shouts_per_word", "n_shouts / n_words", high=0.2),
    Rule("stop_words", "n_stop_words / n_words", low=0.01),
    Rule("capitals", "n_capitals / word_chars", high=0.5),
    Rule("repeated_words", "n_repeat_words / n_words", high=0.3),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.5),
)


def measures(docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` and the counts that rules are written over."""
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, BLANKS, -1), lambda w: w != "")
    base = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep],
        body.alias("body"),
        words.alias("words"),
        F.filter(F.split(body, "\n", -1), lambda s: s.rlike(WORD_CHAR)).alias("lines"),
    )
    hashed = base.select(
        "*",
        F.when(
            F.size("words") > window,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - (window - 1)),
                lambda i: F.xxhash64(F.slice(F.col("words"), i, window)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    found = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"), window)
        )
        .otherwise(F.lit(0))
        .cast("long")
        .alias("n_repeat_words"),
        F.size(F.filter(F.col("words"), lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.regexp_count("body", F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
        F.regexp_count("body", F.lit(r"[\p{Lu}]")).cast("long").alias("n_capitals"),
    )
    # As one generated row: a filter on a measure is then not pushed below it, where the measures would be
    # computed again, and the words anew for each of them.
    return hashed.select(*[F.col(f"k_{c}").alias(c) for c in keep], F.inline(F.array(found)))


def _covered(windows: Column, size: int) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(found: Column) -> Column:
        def twice(pair: Column, at: Column) -> Column:
            same = lambda other: F.coalesce(F.get(found, other)["h"] == pair["h"], F.lit(False))
            return same(at - 1) | same(at + 1)

        return F.sort_array(F.transform(F.filter(found, twice), lambda pair: pair["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(let(pairs, places), total)


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: the measures, ``base_failed``, ``kept`` and the names of failed ``rules``."""
    failed = F.array_compact(F.array(*[F.when(~r.passed(), F.lit(r.name)) for r in rules]))
    judged = measures(docs, [doc_id], text).withColumn(
        "base_failed",
        (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
    )
    return judged.withColumn(
        "failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed)
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
