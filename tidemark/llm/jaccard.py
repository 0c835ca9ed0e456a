"""N-gram Jaccard join with vertical partitioning.

The global order of n-grams: those whose hash lies in the lowest quarter come first, by the number of sets they
are in and then by hash, those of one set before all others; the rest follow by hash. Four fragments of that order,
a quarter of the hashes each, cut every set; the overlap of a pair is counted in each fragment by itself, and the
partial counts are summed per pair.

Candidates share an n-gram in the first ``n - ceil(t n) + 1`` n-grams of that order, fit in length, and
leave enough n-grams after the shared one. The sets of an n-gram are counted over the whole corpus, and only
n-grams of several sets go on; a set whose first n-grams are all its own, as those of a text that shares a
passage with many, has no candidate. Equal sets are one node, so copies cost nothing. Links are needed only to
find the classes, which takes three steps:

1. every set is compared with a few of the sets it shares n-grams with, the first by several orders that are the
   same for all n-grams;
2. sets of which an n-gram's sets are still in different classes are compared with those that stand next to them when
   sorted by their bitmaps, in several orders, and again while a round finds enough links: in a large group of near
   copies most pairs do not link, and similar ones have to be found;
3. sets of one n-gram that are still in different classes are all compared, so no link is lost. Of n-grams
   with the same sets one is enough: that which is first in the order.

A fixed-size bitmap per set bounds the overlap of a pair from above, and one of at least two bits an n-gram for sets
that would fill it; pairs that they rule out are never made in the last round. Sets are identified by a 64-bit hash
together with their size.

Defined results: null, empty and blank texts have no set and are linked with nothing; a text of fewer than
``SHINGLE`` words is one n-gram; repeated rows are in one class; a null id is a document of its own class,
with a null class id unless it is linked to one that has an id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.components import components
from tidemark.llm.words import Words, chunks, rolled, row_tag
from tidemark.session import written

SHINGLE, PERCENT = 5, 80
FRAGMENTS = 4
#: Hashes below come first in the order; the first fragment.
LOW = 1 << 62
BITMAP = 16
NEEDED_BITS = 25
#: Others that a set is compared with in the first round, and neighbours per word of its bitmap in later ones.
ORDERS, NEIGHBOURS = 3, 4
#: Rounds of few before all pairs that are left, at most; from the second on they end when few links are found.
ROUNDS, WORTH = 3, 20


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z in lower case."""
    words = Words(texts, lower=True)
    flat, starts = words.flat, words.starts
    grams = rolled(flat, SHINGLE)
    found = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(grams[a : b - SHINGLE + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            found.append(own[new])
        elif b > a:
            salted = rolled(flat[a:b], b - a) ^ np.uint64(0xA5A5A5A5 + b - a)
            found.append(salted)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _name(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _least_overlap(x, y, percent: int):
    """The smallest overlap at which sets of ``x`` and ``y`` n-grams link."""
    return -(-percent * (x + y) // (100 + percent))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _bitmap(grams: np.ndarray) -> list[int]:
    odd = np.bincount((grams >> np.uint64(54)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _wide(grams: np.ndarray) -> list[int] | None:
    """A bitmap that grows with a set too large for the fixed one: at least twice as many bits as n-grams."""
    bits = 64 * BITMAP
    while bits < 2 * len(grams):
        bits *= 2
    if bits == 64 * BITMAP:
        return None
    odd = np.bincount((grams >> np.uint64(24) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _posted(grams: np.ndarray, percent: int) -> int:
    """How many n-grams of a set can stand in its prefix: the low ones, or so many of the first as a prefix has."""
    return max(int(np.searchsorted(grams, np.uint64(LOW))), _prefix(len(grams), percent)) if len(grams) else 0


def _summary(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n, posted, sid, bits, wide`` of every document, stored."""
    schema = "doc_id long, n long, posted long, sid long, bits array<long>, wide array<long>"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            sets = _sets(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "posted": pa.array([_posted(s, percent) for s in sets], pa.int64()),
                    "sid": pa.array([_name(s) for s in sets], pa.int64()),
                    "bits": pa.array([_bitmap(s) for s in sets], pa.list_(pa.int64())),
                    "wide": pa.array([_wide(s) for s in sets], pa.list_(pa.int64())),
                }
            )

    return written(docs.select("doc_id", "text").mapInArrow(summarise, schema), "sets")


def _candidates(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``gram, sid, n, pos``: the n-grams of every set's prefix that other sets may have in theirs; stored.

    The sets of an n-gram are counted by a window, which spills a hot one's rows; of a set only the n-grams
    that are not its own are brought together, and ``pos`` counts those before them.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # copies in one task are posted once
        for (texts,) in chunks(batches, ["text"]):
            heads, names = [], []
            for grams in _sets(texts):
                if len(grams) and (name := _name(grams)) not in known:
                    known.add(name)
                    names.append(name)
                    heads.append(grams[: _posted(grams, percent)])
            if names:
                sids = np.repeat(np.array(names, np.int64), [len(h) for h in heads])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), pa.array(sids)], names=["gram", "sid"]
                )

    postings = docs.select("text").mapInArrow(post, "gram long, sid long")
    every = W.partitionBy("gram")
    counted = postings.select(
        "gram", "sid", F.count(F.lit(1)).over(every).alias("df"),
        F.min("sid").over(every).alias("low"), F.max("sid").over(every).alias("high"),
    )
    late = ~F.col("gram").between(0, LOW - 1)
    order = F.struct(late.alias("late"), F.when(late, 0).otherwise(F.col("df")).alias("df"), "gram")
    shared = counted.filter("low <> high").groupBy("sid").agg(F.sort_array(F.collect_set(order)).alias("shared"))
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    before = (F.col("posted") - F.size("shared")).cast("int")
    first = F.transform(
        F.slice("shared", F.lit(1), F.greatest(prefix - before, F.lit(0))),
        lambda g, i: F.struct(g["gram"].alias("gram"), (before + i).alias("pos")),
    )
    rows = shared.join(sets, "sid").select("sid", F.col("n").cast("int").alias("n"), F.inline(first))
    return written(rows, "candidates")


def _first_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """For every set up to ``ORDERS`` others of another class with which it shares a candidate n-gram: ``x, y``."""
    member = F.struct("sid", "n", "pos", "root")
    rank = [F.xxhash64(F.lit(i), "sid") for i in range(ORDERS)]
    firsts = placed.groupBy("gram").agg(*[F.min(F.struct(r.alias("rank"), member.alias("set"))).alias(f"f{i}") for i, r in enumerate(rank)])
    met = placed.select("gram", *[F.col(c).alias(f"{c}_x") for c in ("sid", "n", "pos", "root")]).join(firsts, "gram")

    def chosen(first):
        fits = _fits(F.col("n_x"), F.col("pos_x"), first["set"]["n"], first["set"]["pos"], percent)
        return F.when(fits & (first["set"]["root"] != F.col("root_x")), F.struct(first["rank"].alias("rank"), first["set"]["sid"].alias("y")))

    best = met.groupBy(F.col("sid_x").alias("x")).agg(*[F.min(chosen(F.col(f"f{i}"))).alias(f"b{i}") for i in range(ORDERS)])
    others = F.array_distinct(F.array_compact(F.array(*[F.col(f"b{i}")["y"] for i in range(ORDERS)])))
    return best.select("x", F.explode(others).alias("y"))


def _neighbours(placed: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs ``x, y`` of open sets of different classes that stand close together in one of ``BITMAP`` orders.

    Sets that link differ in few bits, so that some word of their bitmaps is the same; among the sets with that word
    those with similar other words stand next to each other. Every set meets the next few in each order.
    """
    open_sets = placed.groupBy("sid").agg(F.first("root").alias("root")).join(sets.select("sid", "n", "bits"), "sid")
    rows = open_sets.select("*", F.posexplode("bits").alias("at", "word")).filter("word <> 0")
    words = [F.get("bits", (F.col("at") + turn * BITMAP // ROUNDS + i) % BITMAP) for i in range(BITMAP)]
    order = W.partitionBy("at", "word").orderBy(*words, "sid")
    own = F.struct("sid", "root", "n", "bits")
    near = F.array(*[F.lead(own, i).over(order) for i in range(1, NEIGHBOURS + 1)])

    def fits(other):
        total = F.col("n") + other["n"]
        sized = F.least(F.col("n"), other["n"]) * 100 >= F.greatest(F.col("n"), other["n"]) * percent
        narrow = total - _apart(F.col("bits"), other["bits"]) >= 2 * _least(total, percent)
        return other.isNotNull() & (other["root"] != F.col("root")) & sized & narrow

    met = rows.select("sid", "root", "n", "bits", near.alias("near"))
    chosen = F.transform(F.filter("near", fits), lambda other: other["sid"])
    return met.select(F.col("sid").alias("x"), F.explode(chosen).alias("y"))


def _apart(one, other):
    return sum((F.bit_count(one[i].bitwiseXOR(other[i])) for i in range(BITMAP)), F.lit(0))


def _wide_apart(one, other):
    """Differing bits of two wide bitmaps of which one may be twice as long as the other: it is folded."""
    size = F.least(F.size(one), F.size(other))

    def folded(wide):
        halves = F.zip_with(F.slice(wide, F.lit(1), size), F.slice(wide, size + 1, size), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(wide) > size, halves).otherwise(wide)

    differ = F.zip_with(folded(one), folded(other), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    return F.aggregate(differ, F.lit(0).cast("long"), lambda total, n: total + n)


def _may_link(n_a, n_b, bits_a, bits_b, wide_a, wide_b, percent: int):
    """Whether sizes and bitmaps allow a link."""
    total = n_a + n_b
    sized = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    narrow = total - _apart(bits_a, bits_b) >= 2 * _least(total, percent)
    # Sets whose sizes allow a link have bitmaps that differ by one doubling at most.
    wide = wide_a.isNull() | wide_b.isNull() | (total - _wide_apart(wide_a, wide_b) >= 2 * _least(total, percent))
    return F.when(sized & narrow, wide).otherwise(False)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a < b`` whose sizes and bitmaps allow a link, with their sizes; stored."""
    ordered = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
    side = lambda end: sets.select(F.col("sid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "bits", "wide")])
    both = ordered.join(side("a"), "a").join(side("b"), "b")
    fits = _may_link(*[F.col(f"{c}_{end}") for c in ("n", "bits", "wide") for end in "ab"], percent)
    return written(both.filter(fits).select("a", "b", "n_a", "n_b"), "pairs")


def _least(total, percent: int):
    return F.ceil(total * percent / F.lit(100.0 + percent))


def _linked(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: overlaps are counted per fragment of the order and summed per pair."""
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    needed = docs.sparkSession.sparkContext.broadcast(_marked(ids))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(needed.value, np.uint64)
        for (texts,) in chunks(batches, ["text"]):
            distinct = {_name(s): s for s in _sets(texts) if len(s)}
            rows = []
            for name, grams in distinct.items():
                place = (name & 0xFFFFFFFFFFFFFFFF) >> (64 - NEEDED_BITS)
                if not int(wanted[place >> 6]) >> (place & 63) & 1:
                    continue
                part = (grams >> np.uint64(32)).astype(np.int64) * FRAGMENTS >> 32
                for f in np.unique(part).tolist():
                    rows.append((name, f, grams[part == f].tobytes()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)],
                names=["sid", "fragment", "grams"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()
            common = [
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                for x, y in zip(mine, theirs, strict=True)
            ]
            kept = [batch.column(c) for c in ("a", "b", "need")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(common, pa.int64())], names=["a", "b", "need", "common"])

    found = docs.select("text").mapInArrow(cut, "sid long, fragment int, grams binary")
    # Copies in other batches send the same fragment again.
    fragments = found.groupBy("sid", "fragment").agg(F.first("grams").alias("grams"))
    need = _least(F.col("n_a") + F.col("n_b"), percent).cast("long").alias("need")
    # One question per fragment, so that the joins use the partitioning the fragments already have.
    each = F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment")
    asked = pairs.select("a", "b", need, each)
    side = lambda end: fragments.select(F.col("sid").alias(end), "fragment", F.col("grams").alias(f"grams_{end}"))
    met = asked.join(side("a"), ["a", "fragment"]).join(side("b"), ["b", "fragment"])
    partial = met.select("a", "b", "need", "grams_a", "grams_b").mapInArrow(count, "a long, b long, need long, common long")
    return partial.groupBy("a", "b", "need").agg(F.sum("common").alias("common")).filter("common >= need").select("a", "b")


def _marked(ids: DataFrame) -> bytes:
    """A bitmap of fixed size over set names."""
    place = F.shiftrightunsigned("sid", 64 - NEEDED_BITS)
    table = (
        ids.select(place.alias("place"))
        .groupBy(F.expr("place div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros((1 << NEEDED_BITS) // 64, np.int64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits.tobytes()


def _fits(n_x, pos_x, n_y, pos_y, percent: int):
    """Whether a shared n-gram leaves room for a link, as if it were the first one shared."""
    sized = F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent
    return sized & (F.least(n_x - pos_x, n_y - pos_y) >= _least(n_x + n_y, percent))


def jaccard_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(sets, links)``: the set of every document, and links ``a, b`` between sets (enough for all classes)."""
    members = _summary(docs, percent)
    sets = written(
        members.filter("n > 0").groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "posted", "bits", "wide")]), "distinct"
    )
    candidates = _candidates(docs, sets, percent)
    placed, tried, links = candidates.withColumn("root", F.col("sid")), None, None
    for turn in range(ROUNDS):
        few = _neighbours(placed, sets, percent, turn) if turn else _first_pairs(placed, percent)
        pairs = _likely(few, sets, percent)
        if tried is not None:
            pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty() and turn:
            break
        found = written(_linked(pairs, docs, percent), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        placed = _open(candidates, components(links))
        if turn and found.count() * WORTH < pairs.count():
            break
    open_sets = written(placed.join(sets.select("sid", "bits", "wide"), "sid"), "open")
    columns = ("sid", "n", "pos", "root", "bits", "wide")
    x = open_sets.select("gram", *[F.col(c).alias(f"{c}_x") for c in columns])
    y = open_sets.select("gram", *[F.col(c).alias(f"{c}_y") for c in columns])
    n_x, n_y = F.col("n_x"), F.col("n_y")
    apart = (F.col("sid_x") < F.col("sid_y")) & (F.col("root_x") != F.col("root_y"))
    near = _fits(n_x, F.col("pos_x"), n_y, F.col("pos_y"), percent)
    near &= _may_link(*[F.col(f"{c}_{end}") for c in ("n", "bits", "wide") for end in "xy"], percent)
    rest = x.join(y, (x["gram"] == y["gram"]) & apart & near)
    rest = rest.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b"), n_x.cast("long").alias("n_a"), n_y.cast("long").alias("n_b"))
    # Stored first, or else Spark compares the pairs with those tried once for every n-gram they share.
    rest = written(rest.distinct(), "rest")
    more = written(rest.join(tried, ["a", "b"], "left_anti"), "more-pairs")
    links = links.union(_linked(more, docs, percent)) if not more.isEmpty() else links
    return members.select("doc_id", "n", "sid"), written(links, "all-links")


def _open(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """``gram, sid, n, pos, root``: n-grams whose sets are in several classes; of those with the same sets one; stored."""
    placed = candidates.join(classes, F.col("sid") == F.col("node"), "left")
    placed = placed.select("gram", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
    member = F.xxhash64("sid")
    mixed_groups = (
        placed.groupBy("gram")
        .agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("pos").alias("pos"),
            F.bit_xor(member).alias("odd"), F.sum(F.shiftright(member, 24)).alias("total"),
        )
        .filter("low <> high")
        .groupBy("size", "odd", "total")
        .agg(F.min_by("gram", F.struct("pos", "gram")).alias("gram"))
    )
    return written(placed.join(mixed_groups.select("gram"), "gram", "left_semi"), "mixed")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest document id that links reach."""
    members, links = jaccard_links(docs, percent)
    roots = components(links)
    classed = members.join(roots, F.col("sid") == F.col("node"), "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("class")
    )
    least = classed.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    named = classed.filter(F.col("class").isNotNull()).withColumn("key", F.struct("class"))
    linked = named.join(least.select(F.struct("class").alias("key"), "least"), "key")
    alone = classed.filter(F.col("class").isNull()).select("doc_id", "n", F.col("doc_id").alias("least"))
    return (
        linked.select("doc_id", "n", "least")
        .union(alone)
        .select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: of each class the row with the smallest id stays.

    Of rows with that id and equal texts one stays. Rows without an id stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), percent)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__tag", row_tag()).dropDuplicates(["doc_id", "__tag"])
    return kept.drop("__tag").unionByName(docs.filter(F.col("doc_id").isNull()))
