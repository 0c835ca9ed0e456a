"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other parameters keeps its
template. Windows of ``WINDOW`` canonical words of documents and benchmark items are joined by hash; on
each diagonal of a pair, matched windows in a row are a run. A run is cut into its longest stretches whose
slots agree: one benchmark value always stands for one document value and the other way round. A stretch
counts if it covers ``ENOUGH`` words (or the whole item, if that is shorter) with enough plain words among
them; one without a changed slot counts whatever its words are.

Case and place do not tell every name, so each text is read in several ways (``STREAMS``) that are joined
each for itself: names as plain words, which finds copies in any case and with any line ends; capitals
inside sentences as names; all capitals as names, for sentences that open with one. The last two are also
read with names of several words as one place, so that a name may change its number of words.

A window with fewer than ``FEW`` plain words is looked up by its literal words: windows of placeholders alone would
all be one, and a table of numbers would meet every item that has numbers. So a stretch of such windows leaks only
as it stands.

Every window of every text is looked up. A filter of fixed size (``FILTER_BITS`` bits, whatever the size
of the benchmark) keeps most windows that match nothing out of the shuffle; the join itself is Spark's.

Defined results: null and empty texts and items match nothing; items and documents of fewer words than a
window match nothing; repeated documents and items are judged one by one by content, and one row per
document id and item id is returned. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, chunks, inside_texts, mixed, rolled

WINDOW, ENOUGH, PLAIN = 8, 13, 5
#: Windows of fewer plain words are looked up by their literal words.
FEW = 2
FILTER_BITS = 25
#: Names are plain words; names inside sentences are slots, each word or each name one; all capitals are, likewise.
STREAMS = ("no names", "inside", "inside, joined", "all", "all, joined")
_SALTS = mixed(np.arange(1, len(STREAMS) + 1, dtype=np.uint64))
LEAK = (
    "doc_id long, item_id long, start_word long, n_words long, n_slots long, n_changed long, exact boolean"
)

# Words for units of measure and money.
UNITS = frozenset(
    """m cm mm km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms ton tons
    tonne tonnes pound pounds lb lbs ounce ounces oz l ml liter liters litre litres gallon gallons second seconds
    sec minute minutes min hour hours hr hrs day days week weeks month months year years dollar dollars cent cents
    euro euros usd eur percent degrees degree celsius fahrenheit watt watts kw kwh volt volts joule joules newton
    newtons hz khz mhz mph kph""".split()
)
_MARKS = b".,;:!?()[]{}\"'`*#_<>|$%+-/"
PLACEHOLDERS = dict(zip(("number", "name", "unit", "quantity"), Words([b"\x01n\x01", b"\x01p\x01", b"\x01u\x01", b"\x01q\x01"]).flat, strict=True))
_UNIT_HASHES = Words([u.encode() for u in sorted(UNITS)], skip=_MARKS).flat


def _among(*values: int) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(values)] = True
    return flags


_DIGIT, _LETTER = _among(*b"0123456789"), _among(*range(65, 91), *range(97, 123), *range(128, 256))
_SMALL, _CAPITAL = _among(*range(97, 123), *range(128, 256)), _among(*range(65, 91))
_END, _CLOSING, _NEWLINE = _among(*b".!?"), _among(*b"\"')]*"), _among(10)
_KEPT = ~_among(*_MARKS)


def _folded(text: bytes) -> bytes:
    """Capitals beyond ASCII in lower case, where that takes as many bytes."""
    if text.isascii():
        return text
    body = text.decode("utf-8", "surrogateescape")
    for c in set(body):
        if c > "\x7f" and (low := c.lower()) != c and len(low.encode("utf-8", "surrogateescape")) == len(c.encode("utf-8", "surrogateescape")):
            body = body.replace(c, low)
    return body.encode("utf-8", "surrogateescape")


class _Read:
    """The words of some texts with what may be a slot: ``fixed`` by the word alone, ``capital`` as a name."""

    def __init__(self, texts: list[bytes]) -> None:
        words = Words([_folded(t) for t in texts], lower=True, skip=_MARKS)
        value, (begins, ends) = words.flat, words.edges
        self.value, self.starts = value, words.starts
        if not len(value):
            self.fixed = self.capital = self.opens = self.follows = np.zeros(0, bool)
            self.plain = value
            return
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        # Opens a sentence: the first word of a text or line, or the word before ends with an end mark.
        last, before = raw[ends - 1], raw[np.maximum(ends - 2, begins)]
        closed = _END[last] | (_CLOSING[last] & _END[before])
        lines = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_NEWLINE[raw], out=lines[1:], dtype=np.int32)
        opens = np.ones(len(value), bool)
        opens[1:] = closed[:-1] | (lines[begins[1:]] > lines[ends[:-1]])
        opens[words.starts[:-1][words.starts[:-1] < len(value)]] = True
        # The first byte that is no mark tells capitals; of letters beyond ASCII those of Latin-1.
        kept = np.flatnonzero(_KEPT[raw])
        first = kept[np.searchsorted(kept, begins)]
        wide = (raw[first] == 0xC3) & (raw[np.minimum(first + 1, len(raw) - 1)] < 0x9F)
        digits, letters = words.count_of(_DIGIT), words.count_of(_LETTER)
        small = words.count_of(_SMALL, raw) - 2 * wide
        number = (digits > 0) & (letters == 0)
        quantity = (digits > 0) & (letters > 0) & _DIGIT[raw[first]]
        unit = np.isin(value, _UNIT_HASHES)
        self.fixed, self.opens = number | quantity | unit, opens
        self.capital = (_CAPITAL[raw[first]] | wide) & (first < ends) & (small > 0) & (digits == 0) & ~unit
        #: Words right behind one of the same text that ends without a mark.
        self.follows = np.zeros(len(value), bool)
        self.follows[1:] = _KEPT[last[:-1]]
        self.follows[words.starts[:-1][words.starts[:-1] < len(value)]] = False
        marks = [PLACEHOLDERS[k] for k in ("number", "quantity", "unit")]
        self.plain = np.select([number, quantity, unit], marks, value)

    def template(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and slot values (0: a plain word) of all words if the words ``name`` are names."""
        slot = np.where(self.fixed | name, self.value | np.uint64(1), np.uint64(0))
        return np.where(name, PLACEHOLDERS["name"], self.plain), slot

    def streams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The texts in all ``STREAMS``: hashes, slot values, first words (one more at the end), starts of texts."""
        n = len(self.value)
        each = np.arange(n + 1)
        yield *self.template(np.zeros(n, bool)), each, self.starts
        for name in (self.capital & ~self.opens, self.capital):
            hashes, slots = self.template(name)
            yield hashes, slots, each, self.starts
            more = name & self.follows
            more[1:] &= name[:-1]
            at = np.flatnonzero(~more)
            if n:
                place = np.arange(n) - np.maximum.accumulate(np.where(more, 0, each[:-1]))
                value = np.where(more, mixed(self.value + place.astype(np.uint64)), slots)
                slots = np.add.reduceat(value, at)
                slots[slots != 0] |= np.uint64(1)
            yield hashes[at], slots, np.append(at, n), np.searchsorted(at, self.starts)


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical hashes and slot values (0: a plain word) of all words of the texts, and where each text starts.

    Words count in lower case and without marks. A capital makes a name, unless it opens a sentence or a
    line; words of digits are numbers, digits with letters behind them quantities.
    """
    read = _Read(texts)
    return *read.template(read.capital & ~read.opens), read.starts


def _windows(hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The hash of every window: of its template, or of its literal words where too few of them are plain."""
    places = np.zeros(len(slots) + 1, np.int64)
    np.cumsum(slots != 0, out=places[1:])
    bare = places[WINDOW:] - places[:-WINDOW] > WINDOW - FEW if len(slots) >= WINDOW else np.zeros(0, bool)
    literal = rolled(np.where(slots != 0, slots, hashes), WINDOW)
    return np.where(bare, mixed(literal), rolled(hashes, WINDOW))


_HIT = "id long, stream long, tag long, pos long, word long, length long, hash long, slots binary"
_ARROW = pa.schema([("id", pa.int64()), ("stream", pa.int64()), ("tag", pa.int64()), ("pos", pa.int64()), ("word", pa.int64()),
                    ("length", pa.int64()), ("hash", pa.int64()), ("slots", pa.binary())])


def _window_rows(rows: DataFrame, id_column: str, bits=None) -> DataFrame:
    """The windows of ``rows`` in all streams (only those that pass ``bits``, a broadcast filter).

    ``slots`` holds a slot value and a number of words for each place of the window.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None if bits is None else np.frombuffer(bits.value, np.uint64)
        for ids, texts in chunks(batches, [id_column, "text"]):
            read = _Read(texts)
            for stream, (hashes, slots, firsts, starts) in enumerate(read.streams()):
                grams = _windows(hashes, slots) ^ _SALTS[stream]
                good = inside_texts(starts, len(grams), WINDOW)
                if allowed is not None:
                    slot = grams >> np.uint64(64 - FILTER_BITS)
                    good &= (allowed[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                at = np.flatnonzero(good)
                doc = np.searchsorted(starts, at, "right") - 1
                tags = {d: xxhash.xxh3_64_intdigest(texts[d]) - (1 << 63) for d in np.unique(doc).tolist()}
                both = np.stack([slots, np.diff(firsts).astype(np.uint64)], 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d in doc], pa.int64()),
                        pa.array(np.full(len(at), stream), pa.int64()),
                        pa.array([tags[d] for d in doc.tolist()], pa.int64()),
                        pa.array(at - starts[doc], pa.int64()),
                        pa.array(firsts[at] - read.starts[doc], pa.int64()),
                        pa.array(read.starts[doc + 1] - read.starts[doc], pa.int64()),
                        pa.array(grams[at].view(np.int64), pa.int64()),
                        pa.array([both[p : p + WINDOW].tobytes() for p in at], pa.binary()),
                    ],
                    schema=_ARROW,
                )

    return rows.select(id_column, "text").mapInArrow(extract, _HIT)


def _filter_bits(windows: DataFrame) -> bytes:
    """A bitmap of the window hashes: at most ``2 ** FILTER_BITS / 64`` numbers reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    one = F.expr("shiftleft(1L, cast(place % 64 as int))")
    table = (
        windows.select(place.alias("place"))
        .groupBy(F.expr("place div 64").alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toArrow()
    )
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits.tobytes()


def runs_of(windows: list[tuple[int, int, bytes, bytes]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Windows of one diagonal as runs: first document word, then slot values and numbers of words of document and item."""
    runs, last = [], None
    for pos, word, mine, theirs in sorted(windows):
        if pos == last:
            continue
        a, b = np.frombuffer(mine, np.uint64).reshape(-1, 2), np.frombuffer(theirs, np.uint64).reshape(-1, 2)
        if last is not None and pos == last + 1:
            runs[-1][1].append(a[-1])
            runs[-1][2].append(b[-1])
        else:
            runs.append((word, list(a), list(b)))
        last = pos
    return [(word, np.array(x), np.array(y)) for word, x, y in runs]


def consistent(mine: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether the slot values map one to one."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    return all(
        there.setdefault(y, x) == x and back.setdefault(x, y) == y
        for x, y in zip(mine.tolist(), theirs.tolist(), strict=True)
        if x or y
    )


def agreeing(mine: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[int, int]]:
    """The longest stretches of a run whose slot values map one to one: where they begin and end."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    uses: dict[int, int] = {}
    pairs = list(zip(mine.tolist(), theirs.tolist(), strict=True))
    begin = 0
    for end, (x, y) in enumerate(pairs):
        if not (x or y):
            continue
        if there.get(y, x) != x or back.get(x, y) != y:
            yield begin, end
            while there.get(y, x) != x or back.get(x, y) != y:
                u, v = pairs[begin]
                begin += 1
                if u or v:
                    uses[u] -= 1
                    if not uses[u]:
                        del there[v], back[u], uses[u]
        there[y], back[x], uses[x] = x, y, uses.get(x, 0) + 1
    yield begin, len(pairs)


def verbatim(mine: np.ndarray, theirs: np.ndarray) -> list[list[int]]:
    """The longest stretches of a run without a changed slot: where they begin and end."""
    same = np.zeros(len(mine) + 2, bool)
    same[1:-1] = mine == theirs
    return np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, enough: int = ENOUGH, plain: int = PLAIN) -> DataFrame:
    """``LEAK`` rows: for each document and item its longest leaked run; ``exact`` if no slot was changed."""
    items = _window_rows(benchmark, "item_id").select(
        F.col("id").alias("item_id"), F.col("tag").alias("item_tag"), F.col("pos").alias("item_pos"),
        F.col("length").alias("item_length"), "hash", F.col("slots").alias("item_slots"),
    )
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(items))
    hits = _window_rows(docs, "doc_id", bits).withColumnRenamed("id", "doc_id").drop("length")
    pairs = (
        hits.join(items, "hash")
        .groupBy("doc_id", "tag", "item_id", "item_tag", "item_length", "stream", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .agg(F.collect_set(F.struct("pos", "word", "slots", "item_slots")).alias("windows"))
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = [(w["pos"], w["word"], w["slots"], w["item_slots"]) for w in row["windows"]]
                need = min(enough, row["item_length"])
                leaked = []
                for first, left, right in runs_of(found):
                    (mine, wide), (theirs, item_wide) = left.T, right.T
                    slot, other = (mine != 0) | (theirs != 0), mine != theirs
                    for least, stretches in ((plain, agreeing(mine, theirs)), (0, verbatim(mine, theirs))):
                        for begin, end in stretches:
                            slots = int(slot[begin:end].sum())
                            if item_wide[begin:end].sum() >= need and end - begin - slots >= least:
                                at, words = first + int(wide[:begin].sum()), int(wide[begin:end].sum())
                                leaked.append((words, -int(other[begin:end].sum()), -at, slots))
                if leaked:
                    words, like, early, slots = max(leaked)
                    rows.append((row["doc_id"], row["item_id"], -early, words, slots, -like, like == 0))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 6 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[f.split()[0] for f in LEAK.split(", ")],
            )

    judged = pairs.mapInArrow(judge, LEAK)
    rest = ["n_words", "n_slots", "n_changed", "exact", "start_word"]
    best = F.max(F.struct("n_words", (-F.col("n_changed")).alias("like"), (-F.col("start_word")).alias("early"), *rest[1:]))
    return judged.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.start_word", "b.n_words", "b.n_slots", "b.n_changed", "b.exact"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without an id are kept."""
    leaked = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti")
