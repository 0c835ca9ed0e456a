"""Lexicons as tables: where the phrases of a list of any length occur in texts.

A task sums the bytes of its texts once, so that the hash of any window is a difference of two sums. Windows of the
lengths that phrases have are told from others by a bitmap of fixed size; of windows of 8 and more (4 and more)
bytes only those are tried whose first 8 (4) bytes some phrase begins with. What a text may hold is counted where the
text is, so one row per text and phrase is made, and these rows meet the list by an equi-join on the phrase itself.
A list of up to ``HELD`` bytes goes to the tasks for that, so that the rows, whose number grows with texts times
phrases, stay where they are. A longer list goes there in blocks of ``PACKED`` times that, packed by length and hash
(``_Packed``): places are held against the phrases themselves in the task and nothing is shuffled. A task holds one block
at a time and looks through ``GATHERED`` bytes of texts for it. Only a list of more than ``SCANS`` blocks is joined by a
shuffle of those rows. A full bitmap only lets more rows through to the join, or more places to the comparison.

Phrases with blanks are decided where the text is. They come in blocks of ``BLOCK`` phrases, and texts are read once for
each block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpoint, with_package


#: Windows are tried by so many of their first bytes before they are tried whole.
ANCHORS = (8, 4)
#: Bits of a bitmap, as a power of two.
BITS = 25
#: Stands in a phrase for any characters of the same sentence.
BLANK = "xxx"
#: Phrases with blanks that are held in a task.
BLOCK = 1 << 15
#: Bytes of text that a task works on at a time; a text is never cut.
CHUNK = 1 << 19
#: Bytes of a list that is sent to every task, each phrase counted with ``ROW`` bytes more.
HELD = 1 << 25
ROW = 64
#: Blocks of a longer list, in lists of ``HELD`` bytes with all their columns, and how many of them texts are held against.
PACKED = 4
SCANS = 32
#: Bytes of text that a task holds against one block after the other, or the first batch beyond them.
GATHERED = 1 << 25
#: Rows that a task hands on at a time, or the first number beyond it.
HANDED = 1 << 16
# What ends a sentence for a blank.
STOPS = "。！？\n"

# A byte that no text has.
_END = b"\xff"
_LETTER = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_PROBES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHIFT = np.uint64(64 - BITS)


class _Powers:
    """Powers of an odd number and of its inverse modulo ``2 ** 64``, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            bases = (_BASE, pow(_BASE, -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in bases)
        return self.up[:n], self.down[:n]


_powers = _Powers()


class _Windows:
    """Hashes of the windows of some bytes."""

    def __init__(self, body: np.ndarray) -> None:
        up, self.down = _powers.upto(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_LETTER[body] * up[:-1], out=self.sums[1:])

    def of(self, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the windows of ``size`` bytes that begin ``at`` some places, else at every place."""
        if at is None:
            return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]
        return (self.sums[at + size] - self.sums[at]) * self.down[at]


def _hash(phrase: bytes) -> int:
    return int(_Windows(np.frombuffer(phrase, np.uint8)).of(len(phrase))[0])


def _bit(hashes: np.ndarray, salt: int, probe: np.uint64) -> np.ndarray:
    """The place of a bitmap that stands for each hash; ``salt`` tells anchors from phrases."""
    salted = hashes + np.uint64(salt) if salt else hashes
    return salted * probe >> _SHIFT


def _bits(hashes: np.ndarray, salt: int) -> list[np.ndarray]:
    return [_bit(hashes, salt, probe).astype(np.int64) for probe in _PROBES]


class _Bitmap:
    """Which windows may be phrases, or begin like one of at least so many bytes."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words.view(np.uint64)

    def holds(self, hashes: np.ndarray, salt: int = 0) -> np.ndarray:
        """Where in ``hashes`` one is that may be in the list."""
        at = None
        for probe in _PROBES:
            bits = _bit(hashes if at is None else hashes[at], salt, probe)
            set_bits = self.words[(bits >> np.uint64(6)).view(np.int64)] >> (bits & np.uint64(63)) & np.uint64(1)
            held = np.flatnonzero(set_bits)
            at = held if at is None else at[held]
        return at

    def found(self, windows: _Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per length where windows may be phrases, and their hashes."""
        begins: dict[int, np.ndarray] = {}
        for size in self.sizes:
            if size >= len(windows.sums):
                continue
            anchor = next((a for a in ANCHORS if a <= size), 0)
            if anchor and anchor not in begins:
                begins[anchor] = self.holds(windows.of(anchor), anchor)
            at = begins.get(anchor)
            if at is not None:
                at = at[at + size < len(windows.sums)]
            hashes = windows.of(size, at)
            held = self.holds(hashes)
            yield size, held if at is None else at[held], hashes[held]


def _lengths(phrases: DataFrame) -> dict[int, int]:
    """How many phrases there are of each number of bytes."""
    return {r[0]: r[1] for r in phrases.groupBy(F.octet_length("phrase")).count().collect()}


def _bitmap(phrases: DataFrame, sizes: list[int]) -> _Bitmap:
    """The bitmap of a column ``phrase``; at most ``2 ** BITS`` bits come to the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for phrase in batch.column(0).cast(pa.binary()).to_pylist():
                windows = _Windows(np.frombuffer(phrase, np.uint8))
                bits += _bits(windows.of(len(phrase))[:1], 0)
                anchor = next((a for a in ANCHORS if a <= len(phrase)), 0)
                if anchor:
                    bits += _bits(windows.of(anchor)[:1], anchor)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bits) if bits else [], pa.int64())], names=["bit"])

    with_package(phrases.sparkSession)
    table = (
        phrases.select("phrase").mapInArrow(place, "bit long")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros((1 << BITS) // 64, np.int64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy()
    return _Bitmap(sizes, words)


class _Texts:
    """Some texts side by side, and the rows they come from."""

    def __init__(self, texts: list[bytes]) -> None:
        self.body = _END.join(texts) + _END
        self.bytes = np.frombuffer(self.body, np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts]) - 1

    def places(self, held: _Bitmap) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length the places that may be phrases, in order of text, hash and place: ``size, text, hash, place``."""
        for size, at, hashes in held.found(_Windows(self.bytes)):
            text = np.searchsorted(self.ends, at)
            inside = at + size <= self.ends[text]
            at, hashes, text = at[inside], hashes[inside], text[inside]
            order = np.lexsort((at, hashes, text))
            yield size, text[order], hashes[order], at[order]

    def sentences(self) -> np.ndarray:
        """How many sentence ends lie before each place."""
        own, ended = self.bytes, np.zeros(len(self.bytes) + 1, np.int64)
        for stop in STOPS:
            marks = stop.encode()
            here = np.ones(max(len(own) - len(marks) + 1, 0), bool)
            for i, mark in enumerate(marks):
                here &= own[i : i + len(here)] == mark
            ended[np.flatnonzero(here) + len(marks)] += 1
        return np.cumsum(ended)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Texts]]:
    """The batches cut into pieces of about ``CHUNK`` bytes of the column ``text``."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        start, held = 0, 0
        for end, body in enumerate(texts, 1):
            held += len(body)
            if held >= CHUNK or end == len(texts):
                yield batch.slice(start, end - start), _Texts(texts[start:end])
                start, held = end, 0


def _runs(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of the same text and hash begin and end."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    begins = np.flatnonzero(new)
    return begins, np.r_[begins, len(text)][1:] if len(begins) else begins


def _apart(places: np.ndarray, size: int) -> int:
    """How many of the ``places`` are taken from the left without overlap."""
    taken, free = 0, -1
    for at in places.tolist():
        if at >= free:
            taken, free = taken + 1, at + size
    return taken


def _counted(text: np.ndarray, hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of the same text and hash begin, and how many of the places of each are taken."""
    begins, ends = _runs(text, hashes)
    hits = ends - begins
    # Only runs with neighbours that overlap are walked.
    close = np.flatnonzero((np.diff(at) < size) & (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1]))
    for run in np.unique(np.searchsorted(begins, close, "right") - 1).tolist():
        hits[run] = _apart(at[begins[run] : ends[run]], size)
    return begins, hits


def _rows(docs: DataFrame, key: str) -> DataFrame:
    with_package(docs.sparkSession)
    return docs.filter("text <> ''").select(key, F.monotonically_increasing_id().alias("row"), "text")


def _held(docs: DataFrame, phrases: DataFrame, key: str, lengths: dict[int, int] | None = None) -> DataFrame:
    """``key, row, phrase, hits`` of every phrase a text has, and of some strings that are no phrases."""
    rows = _rows(docs, key)
    schema = T.StructType(
        [rows.schema[key], rows.schema["row"], T.StructField("phrase", T.StringType()), T.StructField("hits", T.LongType())]
    )
    sizes = sorted(_lengths(phrases) if lengths is None else lengths)
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema)
    bitmap = _bitmap(phrases, sizes)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap.sizes, bitmap.words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Bitmap(*shared.value)
        for batch, texts in _chunks(batches):
            for size, text, hashes, at in texts.places(held):
                begins, hits = _counted(text, hashes, at, size)
                found = [texts.body[a : a + size] for a in at[begins].tolist()]
                whole = [i for i, f in enumerate(found) if _valid(f)]
                at_rows = pa.array(text[begins[whole]] if whole else [], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(at_rows), batch.column("row").take(at_rows),
                        pa.array([found[i].decode() for i in whole], pa.string()), pa.array(hits[whole] if whole else [], pa.int64()),
                    ],
                    names=[key, "row", "phrase", "hits"],
                )

    return rows.mapInArrow(count, schema)


class _Packed:
    """Phrases with the columns of their list, packed in order of length and hash."""

    def __init__(self, listed: pa.Table) -> None:
        coded = pa.chunked_array(listed.column("phrase")).combine_chunks().cast(pa.binary()).dictionary_encode()
        names = coded.dictionary
        starts = np.frombuffer(names.buffers()[1], np.int32)[names.offset :][: len(names) + 1].astype(np.int64)
        body, sizes = np.frombuffer(names.buffers()[2], np.uint8), np.diff(starts)
        hashes, words = np.zeros(len(names), np.uint64), np.zeros((1 << BITS) // 64, np.uint64)

        def tell(at: np.ndarray, size: int, salt: int) -> np.ndarray:
            """The hashes of the first ``size`` bytes of the phrases ``at``, which the bitmap now has."""
            up, _ = _powers.upto(size)
            own = np.zeros(len(at), np.uint64)
            for i in range(size):
                own += _LETTER[body[starts[at] + i]] * up[i]
            for bits in _bits(own, salt):
                np.bitwise_or.at(words, bits >> 6, np.uint64(1) << (bits & 63).view(np.uint64))
            return own

        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            hashes[at] = tell(at, size, 0)
            anchor = next((a for a in ANCHORS if a <= size), 0)
            if anchor:
                tell(at, anchor, anchor)
        order = np.lexsort((hashes, sizes))
        #: Per length the number of its first phrase, and in order the hashes and the phrases.
        self.known: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes).tolist():
            first, behind = np.searchsorted(sizes[order], (size, size + 1)).tolist()
            own = order[first:behind]
            self.known[size] = (first, hashes[own], body[starts[own][:, None] + np.arange(size)])
        self.bitmap = _Bitmap(sorted(self.known), words)
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        rows = number[coded.indices.to_numpy(zero_copy_only=False)]
        #: The rows of the list in order of their phrases, and where those of each phrase begin.
        self.rows = listed.take(np.argsort(rows, kind="stable")).combine_chunks()
        self.first = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(names)))]

    def places(self, texts: _Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length where phrases are, in order of phrase, text and place: ``size, phrase, text, place``."""
        for size, at, hashes in self.bitmap.found(_Windows(texts.bytes)):
            first, known, names = self.known[size]
            windows = np.lib.stride_tricks.sliding_window_view(texts.bytes, size)
            number, found = np.searchsorted(known, hashes), []
            # More than one round only if phrases of one length share a hash.
            while len(at):
                same = np.flatnonzero(known[np.minimum(number, len(known) - 1)] == hashes)
                same = same[number[same] < len(known)]
                at, hashes, number = at[same], hashes[same], number[same]
                equal = (windows[at] == names[number]).all(axis=1)
                found.append((at[equal], number[equal]))
                at, hashes, number = at[~equal], hashes[~equal], number[~equal] + 1
            if not found:
                continue
            at, number = (np.concatenate(x) for x in zip(*found, strict=True))
            text = np.searchsorted(texts.ends, at)
            inside = at + size <= texts.ends[text]
            at, number, text = at[inside], number[inside], text[inside]
            order = np.lexsort((at, number * len(texts.ends) + text))
            yield size, number[order] + first, text[order], at[order]

    def listed(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each phrase, and which of the phrases given each is of."""
        many = self.first[number + 1] - self.first[number]
        which = np.repeat(np.arange(len(number)), many)
        return np.arange(len(which)) + (self.first[number] - np.cumsum(many) + many)[which], which


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches in lists of about ``GATHERED`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _loaded(shared: Broadcast) -> _Packed:
    """A block of several, which the broadcast does not keep; one that is encrypted on disk comes into the task with it."""
    path = getattr(shared, "_path", None)
    return shared.load_from_path(path) if path else shared.value


def _packed(docs: DataFrame, blocks: list[DataFrame], key: str) -> DataFrame:
    """``key, row, hits`` and the columns of the list of every phrase a text has; a task holds one of the ``blocks`` at a time."""
    rows = _rows(docs, key)
    named = blocks[0].columns
    schema = T.StructType([rows.schema[key], rows.schema["row"], *blocks[0].schema.fields, T.StructField("hits", T.LongType())])
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(_Packed(table)) for table in (block.toArrow() for block in blocks) if len(table)]

    def found_in(held: _Packed, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):

            def rows_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                number, text, hits = (np.concatenate(x) for x in zip(*found, strict=True))
                at, which = held.listed(number)
                own, at_rows = held.rows.take(at), pa.array(text[which], pa.int64())
                columns = [own.column(c).combine_chunks() for c in named]
                return pa.RecordBatch.from_arrays(
                    [batch.column(key).take(at_rows), batch.column("row").take(at_rows), *columns, pa.array(hits[which], pa.int64())],
                    names=[key, "row", *named, "hits"],
                )

            found, many = [], 0
            for size, number, text, at in held.places(texts):
                begins, hits = _counted(number, text, at, size)
                found.append((number[begins], text[begins], hits))
                many += len(begins)
                if many >= HANDED:
                    yield rows_of(found)
                    found, many = [], 0
            if many:
                yield rows_of(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shared) == 1:
            yield from found_in(shared[0].value, batches)
        else:
            for texts in _gathered(batches):
                for block in shared:
                    yield from found_in(_loaded(block), iter(texts))

    return rows.mapInArrow(count, schema)


def _bytes(phrases: DataFrame) -> int:
    """The bytes of a list with all its columns, each row counted with ``ROW`` bytes more."""
    row = F.lit(ROW)
    for c in phrases.columns:
        row = row + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return phrases.agg(F.sum(row)).first()[0] or 0


def _met(docs: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """``_held`` without the strings that are no phrases, and the other columns of ``phrases``."""
    lengths = _lengths(phrases)
    if sum((size + ROW) * n for size, n in lengths.items()) <= HELD:
        return _held(docs, phrases, key, lengths).join(phrases.hint("broadcast"), "phrase")
    blocks = -(-_bytes(phrases) // (PACKED * HELD)) if HELD else SCANS + 1
    if blocks > SCANS:
        return _held(docs, phrases, key, lengths).join(phrases.hint("merge"), "phrase")
    if blocks == 1:
        return _packed(docs, [phrases], key)
    stored = checkpoint(phrases)
    return _packed(docs, [stored.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == n) for n in range(blocks)], key)


def _valid(found: bytes) -> bool:
    """Whether a string neither begins nor ends inside a character."""
    try:
        found.decode()
    except UnicodeDecodeError:
        return False
    return True


def counts(docs: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """How often each phrase occurs in each row without overlap, read from the left: the phrase's columns and ``hits``.

    ``row`` tells rows of ``docs(key, text)`` with one key apart. Null and empty texts and phrases have no
    occurrence; a phrase that is listed twice has all of them twice.
    """
    named = [c for c in phrases.columns if c != "phrase"]
    listed = phrases.filter("phrase <> ''")
    return _met(docs, listed, key).select(key, "row", *named, "phrase", "hits")


def _in_order(parts: list[list[tuple[int, int, int, int]]]) -> bool:
    """Whether places ``sentence, place, sentence behind, place behind`` of all parts follow each other in one sentence."""
    reached: dict[int, int] = {}
    for _, _, after, free in parts[0]:
        reached.setdefault(after, free)
    for places in parts[1:]:
        onward: dict[int, int] = {}
        for sentence, at, after, free in places:
            if at >= reached.get(sentence, at + 1):
                onward.setdefault(after, free)
        if not onward:
            return False
        reached = onward
    return True


class _Block:
    """Phrases of several parts, held in a task."""

    def __init__(self, wholes: list[str], split: list[list[str]]) -> None:
        self.wholes = wholes
        names = sorted({p.encode() for parts in split for p in parts})
        ids = {p: i for i, p in enumerate(names)}
        self.names = names
        hashes = [_hash(p) for p in names]
        self.known: dict[int, tuple[list[int], list[int]]] = {}
        for size in sorted({len(p) for p in names}):
            own = sorted((hashes[i], i) for i, p in enumerate(names) if len(p) == size)
            self.known[size] = ([h for h, _ in own], [i for _, i in own])
        self.after: dict[int, list[tuple[int, list[int]]]] = {}
        for number, parts in enumerate(split):
            first, *rest = (ids[p.encode()] for p in parts)
            self.after.setdefault(first, []).append((number, rest))
        words = np.zeros((1 << BITS) // 64, np.uint64)
        for name, own in zip(names, hashes, strict=True):
            bits = _bits(np.array([own], np.uint64), 0)
            anchor = next((a for a in ANCHORS if a <= len(name)), 0)
            if anchor:
                bits += _bits(np.array([_hash(name[:anchor])], np.uint64), anchor)
            for bit in np.concatenate(bits).tolist():
                words[bit >> 6] |= np.uint64(1 << (bit & 63))
        self.bitmap = _Bitmap(sorted(self.known), words)

    def found(self, texts: _Texts) -> dict[int, dict[int, np.ndarray]]:
        """Per text the parts it has and their places in order."""
        found: dict[int, dict[int, np.ndarray]] = {}
        for size, text, hashes, at in texts.places(self.bitmap):
            known, ids = self.known[size]
            begins, ends = _runs(text, hashes)
            for t, h, begin, end in zip(text[begins].tolist(), hashes[begins].tolist(), begins.tolist(), ends.tolist(), strict=True):
                i = bisect_left(known, h)
                first = int(at[begin])
                if i < len(known) and known[i] == h and self.names[ids[i]] == texts.body[first : first + size]:
                    found.setdefault(t, {})[ids[i]] = at[begin:end]
        return found

    def present(self, found: dict[int, np.ndarray], sentence: np.ndarray) -> list[int]:
        """The phrases of one text."""
        placed: dict[int, list[tuple[int, int, int, int]]] = {}

        def places(part: int) -> list[tuple[int, int, int, int]]:
            if part not in placed:
                at = found[part]
                free = at + len(self.names[part])
                placed[part] = list(zip(*(x.tolist() for x in (sentence[at], at, sentence[free], free)), strict=True))
            return placed[part]

        return [
            number
            for first in found.keys() & self.after.keys()
            for number, rest in self.after[first]
            if all(p in found for p in rest) and _in_order([places(p) for p in (first, *rest)])
        ]


def _with_blanks(docs: DataFrame, wholes: DataFrame, key: str) -> DataFrame:
    """``key, row, phrase`` of the phrases ``whole, parts`` of several parts that fit a block."""
    table = wholes.select("whole", "parts").toArrow()
    block = _Block(table["whole"].to_pylist(), table["parts"].to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(block)
    rows = _rows(docs, key)
    schema = T.StructType([rows.schema[key], rows.schema["row"], T.StructField("phrase", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch, texts in _chunks(batches):
            sentence = texts.sentences()
            pairs = [(t, n) for t, found in held.found(texts).items() for n in held.present(found, sentence)]
            at_rows = pa.array([t for t, _ in pairs], pa.int64())
            names = pa.array([held.wholes[n] for _, n in pairs], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(at_rows), batch.column("row").take(at_rows), names], names=[key, "row", "phrase"]
            )

    return rows.mapInArrow(find, schema)


def present(docs: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Which distinct phrases occur in which row: ``key, row, phrase``.

    A ``BLANK`` in a phrase stands for any characters of one sentence; the first place of each part behind the one
    before it, sentence by sentence, decides.
    """
    split = F.filter(F.split("whole", BLANK), lambda p: p != "")
    wholes = phrases.select(F.col("phrase").alias("whole")).distinct().select("whole", split.alias("parts"))
    alone = wholes.filter(F.size("parts") == 1).select("whole", F.col("parts")[0].alias("phrase"))
    found = _met(docs, alone, key).select(key, "row", F.col("whole").alias("phrase"))
    several = wholes.filter(F.size("parts") > 1)
    blocks = -(-several.count() // BLOCK)
    for n in range(blocks):
        block = several.filter(F.pmod(F.xxhash64("whole"), F.lit(blocks)) == n)
        found = found.unionByName(_with_blanks(docs, block, key))
    return found
