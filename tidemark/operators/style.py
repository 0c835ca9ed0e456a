"""Style checks over a corpus ``docs(doc_id, text, ...)``.

Every rule is an expression over one row, so a corpus is read once, in parallel, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx
from tidemark.functions.skew import even_join


class Phrase(NamedTuple):
    """A phrase to look for and what to write instead; several replacements are parted by ``|``."""

    rule_id: str
    phrase: str
    replacement: str | None = None


class Pattern(NamedTuple):
    """A regular expression; an opener counts in the first paragraph only."""

    rule_id: str
    regex: str
    opener: bool = False

    def hits(self, text: Column, opening: Column) -> Column:
        return tx.count_pattern(opening if self.opener else text, self.regex)


class Ordered(NamedTuple):
    """Words that follow each other in a text, at any distance and over any number of lines."""

    rule_id: str
    words: tuple[str, ...]

    def hits(self, text: Column, opening: Column) -> Column:
        return tx.count_ordered(text, self.words)


class Budget(NamedTuple):
    """The number of characters a section of a genre may have."""

    genre: str
    section: str
    low: int
    high: int


class Gate(NamedTuple):
    """How many checks of a layer must pass; None means all of them."""

    layer: str
    needed: int | None = None


# Banned phrases with their replacements.
BANNED = (
    Phrase("b01", "说白了", "坦率的讲|其实就是"),
    Phrase("b02", "意味着什么", "那结果会怎样呢|所以呢"),
    Phrase("b03", "这意味着", "那结果会怎样呢|所以呢"),
    Phrase("b04", "本质上", "说到底|其实"),
    Phrase("b05", "换句话说", "你想想看|也就是说"),
    Phrase("b06", "不可否认", ""),
    Phrase("b07", "综上所述", "具体的回扣句"),
    Phrase("b08", "总的来说", "具体的回扣句"),
    Phrase("b09", "值得注意的是", ""),
    Phrase("b10", "不难发现", ""),
)
# Banned marks with their replacements.
PUNCTUATION = (
    Phrase("p1", "：", "，"),
    Phrase("p2", "——", "，"),
    Phrase("p3", "“", "「"),
    Phrase("p4", "”", "」"),
    Phrase("p5", '"', "「」"),
)
# Structural clichés. The first may span paragraphs, the others stay within a sentence of any length.
CLICHES = (
    Ordered("s1", ("首先", "其次", "最后")),
    Pattern("s2", "(接下来)?让我们(来看看)?"),
    Pattern("s3", "在当今[^。！？\n]*?的?时代"),
    Pattern("s4", "随着[^。！？\n]*?的(不断)?(发展|进步)"),
)
OPENERS = (
    Pattern("o1", "^[ 　]*在当今[^。！？\n]*?时代", opener=True),
    Pattern("o2", "^[ 　]*随着[^。！？\n]*?的(不断)?(发展|进步)", opener=True),
)
# Vague names of tools.
VAGUE = (Phrase("v1", "AI工具"), Phrase("v2", "某个模型"), Phrase("v3", "相关技术"))
# Colloquial phrases; xxx stands for any words of the same sentence.
COLLOQUIAL = (
    "坦率的讲", "说真的", "我是真的觉得", "反正我觉得", "怎么说呢", "其实吧", "你想想看", "我跟你说", "回到xxx这块",
    "这块需要注意一下", "顺着上面的再聊聊",
    "我有时候觉得", "我一直觉得", "这话听着有点刺耳但", "不是说xxx不行而是说", "我自己的感受是", "我始终坚信", "我觉得还是挺重要的",
    "说实话我也不确定", "我自己也还在摸索", "可能有些想法还不成熟", "这个事儿我也踩过坑", "愚钝如我",
    '我说"理论上"是因为我自己还没完全跑通', "说实话我们还差得远",
    "这种感觉太爽了", "我当时就愣住了", "想想就觉得兴奋", "我真的被震撼到了", "搞得我现在还有点懵", "太离谱了", "太特么赤鸡了",
    "给我一下子整不会了", "这一下给我更干懵了", "一时间无语凝噎", "鬼使神差的", "你敢信？？？",
    "很多朋友可能不知道", "可能有小伙伴纳闷", "你如果关注这个领域的话", "大家也都知道", "看到的兄弟可以把公屏打在弹幕上",
    "这玩意", "不是哥们", "我寻思了一下我没寻思明白", "有个屁的xxx", "真的就是一声叹息", "这尼玛就是", "太牛逼了", "比较骚的事",
)
BLANK = lx.BLANK
EMOTION_MARKS = ("。。。", "？？？", "= =")
BULLET = r"^[^\S\n]*(([-*+•]|[0-9]+[.)])[^\S\n]+|[0-9]+、)"
HEADING = r"(?:^|\n)(?:#{1,6} |\*\*[^*\n]+\*\*[^\S\n]*(?=\n|$))"
# Length budgets per genre and section, in characters.
BUDGETS = (
    Budget("article", "total", 4000, 8000),
    Budget("report", "vertical", 6000, 15000),
    Budget("report", "horizontal", 3000, 10000),
    Budget("report", "crossing", 1500, 3000),
    Budget("report", "total", 10000, 30000),
)
GATES = (
    Gate("L1"), Gate("L2-1"), Gate("L2-2", 3), Gate("L2-3", 3), Gate("L2-4"), Gate("L3-1"), Gate("L3-2"),
)
META_MARKERS = ("研究时间", "所属领域", "研究对象类型")
EXEMPT_GENRES = ("report",)


def _hits(docs: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """The structs of ``rows`` with a positive ``hits`` as rows of ``doc_id``."""
    if not rows:
        raise ValueError("no rules given")
    return docs.select("doc_id", F.inline(F.filter(F.array(*rows), lambda row: row.hits > 0)))


def _where_positive(docs: DataFrame, row: Column, field: str) -> DataFrame:
    """The fields of ``row`` per document where ``field`` is positive.

    A filter behind a projection would be pushed below it, and the costly expression computed twice.
    """
    return docs.select("doc_id", F.inline(F.filter(F.array(row), lambda r: r[field] > 0)))


def phrase_hits(docs: DataFrame, lexicon: Sequence[Phrase] | DataFrame = BANNED) -> DataFrame:
    """Occurrences of each phrase per document: ``doc_id, rule_id, hits, replacement``.

    A short list is one expression per phrase over the text. A table ``rule_id, phrase, replacement`` of any
    length is joined by anchors (``functions.lexicon``); the rows are the same.
    """
    if isinstance(lexicon, DataFrame):
        rows = lx.counts(docs.select("doc_id", "text"), lexicon.select("rule_id", "phrase", "replacement"))
        return rows.select("doc_id", "rule_id", "hits", "replacement")
    return _hits(
        docs,
        [
            F.struct(
                F.lit(p.rule_id).alias("rule_id"),
                tx.count_literal(F.col("text"), p.phrase).alias("hits"),
                F.lit(p.replacement).cast("string").alias("replacement"),
            )
            for p in lexicon
        ],
    )


def punct_hits(
    docs: DataFrame, lexicon: Sequence[Phrase] | DataFrame = PUNCTUATION, *, exempt: Sequence[str] = EXEMPT_GENRES
) -> DataFrame:
    """Occurrences of banned marks in documents outside the exempt genres (column ``genre``)."""
    return phrase_hits(docs.filter(~F.coalesce("genre", F.lit("")).isin(*exempt)), lexicon)


def first_paragraph(text: Column) -> Column:
    return F.coalesce(F.try_element_at(tx.paragraphs(text), F.lit(1)), F.lit(""))


def pattern_hits(docs: DataFrame, patterns: Sequence[Pattern | Ordered] = CLICHES + OPENERS) -> DataFrame:
    """Matches of each pattern per document: ``doc_id, rule_id, hits``."""
    opening = docs.withColumn("__opening", first_paragraph(F.col("text")))
    return _hits(
        opening,
        [
            F.struct(
                F.lit(p.rule_id).alias("rule_id"),
                p.hits(F.col("text"), F.col("__opening")).alias("hits"),
            )
            for p in patterns
        ],
    )


def vague_names(docs: DataFrame, lexicon: Sequence[Phrase] | DataFrame = VAGUE) -> DataFrame:
    return phrase_hits(docs, lexicon)


def _long_runs(text: Column, longest: int, bullet: str) -> Column:
    """Runs of more than ``longest`` bullet lines, each as a string with one letter per line."""
    marks = F.array_join(
        F.transform(tx.lines(text), lambda line: F.when(line.rlike(bullet), "b").otherwise(".")), ""
    )
    runs = F.regexp_extract_all(marks, F.lit(f"b{{{longest + 1},}}"), F.lit(0))
    # Most texts have no bullet at all, which one search tells.
    return F.when(text.rlike("(?m)" + bullet), runs).otherwise(F.array().cast("array<string>"))


def bullet_runs(docs: DataFrame, *, longest: int = 3, bullet: str = BULLET) -> DataFrame:
    """Documents with more than ``longest`` bullet lines in a row: number of such runs, longest run."""
    row = tx.let(
        _long_runs(F.col("text"), longest, bullet),
        lambda runs: F.struct(
            F.size(runs).cast("long").alias("runs"),
            F.array_max(F.transform(runs, F.length)).cast("long").alias("longest"),
        ),
    )
    return _where_positive(docs, row, "runs")


def _long_bold(text: Column, max_lines: int) -> Column:
    spans = F.regexp_extract_all(text, F.lit(r"(?s)\*\*(.+?)\*\*"), F.lit(1))
    long = F.filter(spans, lambda s: F.size(F.split(s, "\n", -1)) > max_lines)
    return F.when(F.contains(text, F.lit("**")), long).otherwise(F.array().cast("array<string>"))


def bold_spans(docs: DataFrame, *, max_lines: int = 2) -> DataFrame:
    """Documents with bold text over more than ``max_lines`` lines."""
    spans = F.size(_long_bold(F.col("text"), max_lines)).cast("long")
    return _where_positive(docs, F.struct(spans.alias("spans")), "spans")


def _flat_places(text: Column, tol_percent: int) -> Column:
    zero = F.lit(0)
    start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("flat"))

    def step(seen: Column, n: Column) -> Column:
        top, low = F.greatest(seen.a, seen.b, n), F.least(seen.a, seen.b, n)
        # Lengths are positive, so a zero says that there are not three sentences yet.
        near = (low > 0) & ((top - low) * 100 <= top * tol_percent)
        flat = seen.flat + near.cast("int")
        return F.struct(seen.b.alias("a"), n.alias("b"), flat.alias("flat"))

    return F.aggregate(tx.sentence_lengths(text), start, step, lambda seen: seen.flat).cast("long")


def flat_rhythm(docs: DataFrame, *, tol_percent: int = 15) -> DataFrame:
    """Places where three sentences in a row differ in length by at most ``tol_percent`` of the longest."""
    places = _flat_places(F.col("text"), tol_percent)
    return _where_positive(docs, F.struct(places.alias("flat_places")), "flat_places")


def _single_sentence_paragraphs(paragraphs: Column) -> Column:
    return F.size(F.filter(paragraphs, lambda p: tx.sentence_count(p) == 1)).cast("long")


def break_paragraphs(docs: DataFrame, *, minimum: int = 3) -> DataFrame:
    """Paragraphs of one sentence per document and whether there are enough."""
    return docs.select("doc_id", _single_sentence_paragraphs(tx.paragraphs(F.col("text"))).alias("breaks")).withColumn(
        "enough", F.col("breaks") >= minimum
    )


def has_question(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.question_count(F.col("text")).alias("questions")).withColumn(
        "present", F.col("questions") > 0
    )


def _headings(text: Column) -> Column:
    return tx.count_pattern(text, HEADING)


def heading_hits(docs: DataFrame, *, itemised: Column | None = None) -> DataFrame:
    """Documents with headings or lines all in bold; ``itemised`` marks method articles, which may have them."""
    wanted = docs if itemised is None else docs.filter(~itemised)
    return _where_positive(wanted, F.struct(_headings(F.col("text")).alias("headings")), "headings")


def _present(text: Column, phrase: str) -> Column:
    """Whether a phrase occurs; ``BLANK`` in it stands for any words of the same sentence."""
    parts = [p for p in phrase.split(BLANK) if p]
    if len(parts) == 1:
        return F.contains(text, F.lit(parts[0]))
    return text.rlike(r"[^。！？\n]*?".join(re.escape(p) for p in parts))


def _variety(text: Column, phrases: Sequence[str]) -> Column:
    """Distinct phrases present; phrases repeated in the list count once."""
    present = [_present(text, p).cast("long") for p in dict.fromkeys(phrases)]
    total = present[0]
    for one in present[1:]:
        total = total + one
    return total


def phrase_variety(
    docs: DataFrame, phrases: Sequence[str] | DataFrame = COLLOQUIAL, *, minimum: int = 8
) -> DataFrame:
    """How many distinct phrases a document has and whether they are enough; ``phrases`` may be a table ``phrase``."""
    if isinstance(phrases, DataFrame):
        seen = lx.present(docs.select("doc_id", "text"), phrases).groupBy("doc_id", "row")
        most = seen.agg(F.count(F.lit(1)).alias("phrases")).groupBy("doc_id").agg(F.max("phrases").alias("phrases"))
        return even_join(docs.select("doc_id"), most, ["doc_id"]).select(
            "doc_id", F.coalesce("phrases", F.lit(0)).alias("phrases")
        ).withColumn("enough", F.col("phrases") >= minimum)
    return docs.select("doc_id", _variety(F.col("text"), phrases).alias("phrases")).withColumn(
        "enough", F.col("phrases") >= minimum
    )


def _emotion(text: Column, marks: Sequence[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def emotion_marks(docs: DataFrame, marks: Sequence[str] = EMOTION_MARKS) -> DataFrame:
    return docs.select("doc_id", _emotion(F.col("text"), marks).alias("present"))


def style_checks(
    docs: DataFrame,
    *,
    banned: Sequence[Phrase] = BANNED,
    punctuation: Sequence[Phrase] = PUNCTUATION,
    cliches: Sequence[Pattern] = CLICHES,
    openers: Sequence[Pattern] = OPENERS,
    vague: Sequence[Phrase] = VAGUE,
    colloquial: Sequence[str] = COLLOQUIAL,
    emotion: Sequence[str] = EMOTION_MARKS,
    tol_percent: int = 15,
) -> DataFrame:
    """All checks that need no judgement, ``doc_id, layer, rule, hits, passed``.

    Checks that a person or model judges have the same columns and are added with ``unionByName``.
    """
    text = F.col("text")

    def total(counts: list[Column]) -> Column:
        result = F.lit(0).cast("long")
        for one in counts:
            result = result + one
        return result

    marks = total([tx.count_literal(text, p.phrase) for p in punctuation])
    structure = total([p.hits(text, F.col("__opening")) for p in cliches])
    structure = structure + F.size(_long_runs(text, 3, BULLET)) + F.size(_long_bold(text, 2))
    opening = total([p.hits(text, F.col("__opening")) for p in openers])
    none = "none allowed"
    checks: list[tuple[str, str, Column, Column | str]] = [
        ("L1", "banned phrases", total([tx.count_literal(text, p.phrase) for p in banned]), none),
        ("L1", "banned marks", F.col("__marks"), none),
        ("L1", "structure", structure, none),
        ("L1", "vague names", total([tx.count_literal(text, p.phrase) for p in vague]), none),
        ("L2-1", "textbook opener", opening, none),
        ("L2-2", "flat rhythm", _flat_places(text, tol_percent), none),
        ("L2-2", "headings", _headings(text), none),
        ("L2-2", "breaks", _single_sentence_paragraphs(F.col("__paragraphs")), "3"),
        ("L2-2", "questions", tx.question_count(text), "1"),
        ("L2-3", "colloquial phrases", _variety(text, colloquial), "8"),
        ("L2-3", "emotion marks", _emotion(text, emotion).cast("long"), "1"),
        ("L2-4", "banned marks again", F.col("__marks"), none),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(layer).alias("layer"),
                F.lit(rule).alias("rule"),
                hits.cast("long").alias("hits"),
                F.lit(None if need == none else int(need)).cast("long").alias("need"),
            )
            for layer, rule, hits, need in checks
        ]
    )
    return (
        docs.withColumn("__paragraphs", tx.paragraphs(text))
        .withColumn("__opening", F.coalesce(F.try_element_at("__paragraphs", F.lit(1)), F.lit("")))
        .withColumn("__marks", marks)
        .select("doc_id", F.inline(rows))
        .select(
            "doc_id",
            "layer",
            "rule",
            "hits",
            F.when(F.col("need").isNull(), F.col("hits") == 0)
            .otherwise(F.col("hits") >= F.col("need"))
            .alias("passed"),
        )
    )


def layer_gate(checks: DataFrame, gates: Sequence[Gate] = GATES) -> DataFrame:
    """Per document and layer: checks passed, checks made, and whether the layer holds.

    A layer that asks for more checks than were made asks for all of them.
    """
    needed = F.lit(None).cast("long")
    for gate in gates:
        if gate.needed is not None:
            needed = F.when(F.col("layer") == gate.layer, F.lit(gate.needed).cast("long")).otherwise(needed)
    return (
        checks.filter(F.col("layer").isin(*[g.layer for g in gates]))
        .groupBy("doc_id", "layer")
        .agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("checks"))
        .withColumn(
            "holds", F.col("passed") >= F.least(F.coalesce(needed, F.col("checks")), F.col("checks"))
        )
    )


def qc_report(checks: DataFrame, gates: Sequence[Gate] = GATES) -> DataFrame:
    """One row per document: whether each layer holds (null: not checked), layers to redo, first repairs.

    Up to three repairs, ordered by layer, then by the number of hits. All of it is one aggregation
    over the few checks of a document.
    """
    def holds(gate: Gate) -> Column:
        here = F.col("layer") == gate.layer
        made, passed = F.count_if(here), F.count_if(here & F.col("passed"))
        needed = made if gate.needed is None else F.least(F.lit(gate.needed), made)
        return F.when(made > 0, passed >= needed)

    failed = F.when(~F.col("passed"), F.struct("layer", (-F.col("hits")).alias("fewer"), "rule"))
    wide = checks.groupBy("doc_id").agg(
        *[holds(g).alias(g.layer) for g in gates], F.sort_array(F.collect_list(failed)).alias("__failed")
    )
    redo = F.lit(0).cast("long")
    for gate in gates:
        redo = redo + F.when(F.col(f"`{gate.layer}`") == F.lit(False), 1).otherwise(0)
    repairs = F.array_join(F.transform(F.slice("__failed", 1, 3), lambda f: f.rule), "; ")
    return wide.withColumn("layers_to_redo", redo).withColumn("repairs", repairs).drop("__failed")


def reintroduced(hits_v1: DataFrame, hits_v2: DataFrame) -> DataFrame:
    """Rules that were clean in the first version of a document and are broken in the second."""
    before = hits_v1.select("doc_id", "rule_id", F.col("hits").alias("hits_v1"))
    after = hits_v2.select("doc_id", "rule_id", F.col("hits").alias("hits_v2"))
    return (
        after.filter("hits_v2 > 0")
        .join(before, ["doc_id", "rule_id"], "left")
        .fillna(0, ["hits_v1"])
        .filter("hits_v1 = 0")
        .select("doc_id", "rule_id", "hits_v2")
    )


def length_bands(sections: DataFrame, budgets: Sequence[Budget] = BUDGETS) -> DataFrame:
    """Sections ``(doc_id, genre, section, text)`` against their budget: ``below``, ``in`` or ``above``."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in b._asdict().items()]) for b in budgets])
    fits = F.filter(
        rows, lambda b: (b.genre == F.col("genre")) & (b.section == F.col("section"))
    )
    chars = F.length("text")
    return (
        sections.withColumn("__budget", F.try_element_at(fits, F.lit(1)))
        .filter(F.col("__budget").isNotNull())
        .select(
            "doc_id",
            "genre",
            "section",
            chars.cast("long").alias("chars"),
            F.when(chars < F.col("__budget.low"), "below")
            .when(chars > F.col("__budget.high"), "above")
            .otherwise("in")
            .alias("band"),
        )
    )


def hkr(topics: DataFrame) -> DataFrame:
    """Grade topics by their flags ``happy, knowledge, resonance``: S, pass, reconsider or drop."""
    score = F.lit(0)
    for flag in ("happy", "knowledge", "resonance"):
        score = score + F.coalesce(F.col(flag), F.lit(False)).cast("int")
    return topics.withColumn("score", score.cast("long")).withColumn(
        "grade",
        F.when(F.col("score") == 3, "S")
        .when(F.col("score") == 2, "pass")
        .when(F.col("score") == 1, "reconsider")
        .otherwise("drop"),
    )


def report_index(docs: DataFrame, *, markers: Sequence[str] = META_MARKERS) -> DataFrame:
    """Title (first level-one heading) and meta line (first line with a marker) of each document."""
    def has_marker(line: Column) -> Column:
        found = F.lit(False)
        for marker in markers:
            found = found | F.contains(line, F.lit(marker))
        return found

    first = F.try_element_at(F.filter(tx.lines(F.col("text")), has_marker), F.lit(1))
    title = F.regexp_extract("text", r"(?m)^#[ \t]+(.*)$", 1)
    return docs.select(
        "doc_id",
        *[c for c in ("source",) if c in docs.columns],
        F.when(title != "", F.trim(title)).alias("title"),
        F.regexp_replace(first, r"^\s*>*\s*|\s+$", "").alias("meta_line"),
    )


def index_gaps(index: DataFrame) -> DataFrame:
    """Documents without a title or meta line per source."""
    return index.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("title").isNull()).alias("no_title"),
        F.count_if(F.col("meta_line").isNull()).alias("no_meta"),
    )


def tail_present(docs: DataFrame, *, tail: str, exempt: Sequence[str] = EXEMPT_GENRES) -> DataFrame:
    """Whether documents outside the exempt genres end with the fixed closing block."""
    end = F.regexp_replace("text", r"\s+$", "")
    return docs.filter(~F.coalesce("genre", F.lit("")).isin(*exempt)).select(
        "doc_id", F.endswith(end, F.lit(tail.rstrip())).alias("present")
    )
