"""Text columns. All of them stay inside one row, so a corpus is read once and never shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence ends in Chinese and Latin scripts.
SENTENCE_ENDS = "。！？.!?"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` loops over it."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, without the empty ones."""
    return F.filter(F.split(text, r"\n[ \t]*\n", -1), lambda p: F.trim(p) != "")


_LATIN = {"。": ".", "！": "!", "？": "?"}
_END, _INSIDE = "[.!?]", r"[^.!?\n]"


def _latin_ends(text: Column) -> Column:
    """The text with Latin end marks only, character for character.

    Character classes within ASCII are a table lookup; wider ones cost several times as much.
    """
    for mark, latin in _LATIN.items():
        text = F.replace(text, F.lit(mark), F.lit(latin))
    return text


def sentences(text: Column) -> Column:
    """Sentences with their end marks; a line break also ends a sentence."""
    pattern = rf"[^{SENTENCE_ENDS}\n]+[{SENTENCE_ENDS}]*"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def sentence_lengths(text: Column) -> Column:
    """The lengths of ``sentences``."""
    found = F.regexp_extract_all(_latin_ends(text), F.lit(f"{_INSIDE}+{_END}*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.length(F.trim(s))), lambda n: n > 0)


def sentence_count(text: Column) -> Column:
    """The number of ``sentences``, counted in one pass. Blanks alone are no sentence."""
    return count_pattern(_latin_ends(text), rf" *[^.!?\n ]{_INSIDE}*{_END}*| +{_END}+")


def question_count(text: Column) -> Column:
    """The number of ``sentences`` whose last end mark is a question mark."""
    latin = _latin_ends(text)
    return F.when(
        F.contains(latin, F.lit("?")), count_pattern(latin, rf"{_INSIDE}{_END}*\?(?!{_END})")
    ).otherwise(F.lit(0).cast("long"))


def count_literal(text: Column, phrase: str) -> Column:
    """How often ``phrase`` occurs without overlap."""
    bare = F.replace(text, F.lit(phrase), F.lit(""))
    return F.when(
        F.contains(text, F.lit(phrase)),
        ((F.length(text) - F.length(bare)) / F.lit(len(phrase))).cast("long"),
    ).otherwise(F.lit(0).cast("long"))


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_ordered(text: Column, words: tuple[str, ...]) -> Column:
    """How often ``words`` follow each other in this order, in one pass over their occurrences."""
    found = F.regexp_extract_all(text, F.lit("|".join(words)), F.lit(0))
    wanted = F.array(*[F.lit(w) for w in words])
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("hits"))

    def step(state: Column, word: Column) -> Column:
        moved = F.when(word == F.get(wanted, state["at"]), state["at"] + 1).otherwise(state["at"])
        full = moved == len(words)
        return F.struct(
            F.when(full, F.lit(0)).otherwise(moved).alias("at"),
            (state["hits"] + F.when(full, F.lit(1)).otherwise(F.lit(0))).alias("hits"),
        )

    return F.aggregate(found, start, step, lambda state: state["hits"])
