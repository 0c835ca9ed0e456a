"""Sequence packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens. How many pieces there are of each length is
a table of at most ``capacity`` rows, whatever the size of the corpus. Over it, bins are planned one by
one: the longest piece left is set, a subset-sum over the lengths still available (a bitset, multiples
bounded by their counts) finds the fullest combination with it, and that combination is removed. A
combination stays the best one until one of its lengths runs short, so it is taken as often as it can be
at once, and the plan also stays small: every step uses up a length.

The plan, a few rows per length, is broadcast (its size is bounded by ``capacity``); pieces find their
place in it by their number among the pieces of the same length. Nothing is dropped; token ids are not
shuffled.

Defined results: a null text is an empty document, i.e. the end token alone. An empty table gives an empty
result. Rows with an equal document id are separate documents. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.numbering import numbered
from tidemark.llm.words import chunks
from tidemark.session import written

CAPACITY, END = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_WORDS = 160_000  # remembered per worker in each of two halves, some 70 MB at most
_SEEN = (1 << 22) - 1
# Letters whose lower case is one letter in every library, with marks that are never joined to letters.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:|*#$%&]*)")
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_LAST_MARK = re.compile(rb"[.,!?;:](?<=[A-Za-z].)(?=[ \n])")
# First bytes of U+0300 to U+036F, the marks that the tokenizer may join to a letter of A-Z or a-z.
_JOINING = (b"\xcc", b"\xcd")


class TokenIds(dict):
    """Words (without blanks) to their ids as little-endian bytes.

    The tokenizer drops blanks and never joins across them, so a text's ids are its words' ids. The letters
    of a plain word and its marks are looked up apart, as the tokenizer also keeps them apart. Lower-case
    letters are one piece to the tokenizer and stay as they are, so its model gets them at once. A word is
    remembered when it comes the second time; when memory is full, the younger half stays, with what is asked
    for again.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelt = {ord(c): split(c)[0][0] for c in _LETTERS}
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.seen = bytearray(_SEEN + 1)

    def of(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        if not any(mark in text for mark in _JOINING):
            text = text.lower()
        return b"".join([self[w] for w in _LAST_MARK.sub(rb" \g<0>", text).split()])

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text)
        if not plain:
            return self._encoded(text)
        letters, marks = plain.groups()
        ids = [token.id for token in self.model.tokenize(letters.lower().translate(self.spelt))] if letters else []
        after = b""
        if marks and (after := self.marks.get(marks)) is None:
            after = self._encoded(marks)
            if len(marks) < 4:
                self.marks[marks] = after
        return struct.pack(f"<{len(ids)}I", *ids) + after

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._new(word)
            place = hash(word) & _SEEN
            if not self.seen[place]:
                self.seen[place] = 1
                return ids
        if len(self) >= _WORDS:
            self.older = dict(self)
            self.clear()
            self.seen = bytearray(_SEEN + 1)
        self[word] = ids
        return ids


_LOADED: dict[str, TokenIds] = {}


def _ids(path: str) -> TokenIds:
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False
) -> DataFrame:
    """``PIECES`` rows of all documents, with ``ids`` (little-endian 32-bit) if ``keep_ids``."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids(tokenizer)
        for doc_ids, texts in chunks(batches, ["doc_id", "text"]):
            rows: list[tuple] = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                body = known.of(text) + last
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    ids = body[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(ids) // 4, zlib.crc32(ids), ids))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = len(names) if keep_ids else len(names) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns[:n], types[:n], strict=True)], names=names[:n]
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, at most as often as ``counts`` has them) whose sum is the largest up to ``room``.

    Bit ``s`` of a state is set if sum ``s`` can be reached. Long lengths come first and the search ends
    when the room is filled exactly, so that short pieces stay for later bins.
    """
    mask = (1 << (room + 1)) - 1
    states, used = [1], []
    full = 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        times, power = min(counts[length], room // length), 1
        while times:  # a bounded multiple as powers of two
            take = min(power, times)
            state = states[-1] | (states[-1] << (length * take)) & mask
            states.append(state)
            used.append((length, take))
            times, power = times - take, power * 2
            if state & full:
                break
        if states[-1] & full:
            break
    total = states[-1].bit_length() - 1
    chosen: list[int] = []
    for i in range(len(used) - 1, -1, -1):
        if not states[i] >> total & 1:
            length, take = used[i]
            chosen += [length] * take
            total -= length * take
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[int]]]:
    """``(first bin, how many, lengths)``: equal bins that together hold every counted piece once."""
    left = {length: n for length, n in counts.items() if n}
    plan, first = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        lengths = [longest, *fullest(rest, capacity - longest)]
        need = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        plan.append((first, times, lengths))
        first += times
    return plan


def _by_length(plan: list[tuple[int, int, list[int]]]) -> dict[int, tuple[list[int], list[tuple]]]:
    """Per length: from which number on a run of places applies, and the run: first bin, copies, offsets."""
    places: dict[int, tuple[list[int], list[tuple]]] = {}
    for first, times, lengths in plan:
        offset = 0
        own: dict[int, list[int]] = {}
        for x in lengths:
            own.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in own.items():
            begins, runs = places.setdefault(x, ([], []))
            begins.append(runs[-1][3] if runs else 0)
            runs.append((first, begins[-1], offsets, begins[-1] + times * len(offsets)))
    return places


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; ``pieces`` must be cheap to read twice (a written table)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(_by_length(plan_bins(counts, capacity)))
    places_added = [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    schema = T.StructType([*pieces.schema.fields, *places_added])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            bins, offsets = [], []
            for length, number in zip(
                batch.column("length").to_pylist(), batch.column("__number").to_pylist(), strict=True
            ):
                begins, runs = known[length]
                first, begin, inside, _ = runs[bisect_right(begins, number) - 1]
                bins.append(first + (number - begin) // len(inside))
                offsets.append(inside[(number - begin) % len(inside)])
            kept = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=schema.names
            )

    return numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "__number").mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Where every piece of every document goes: ``PIECES``, ``sequence_id``, ``offset``."""
    return pack_pieces(written(token_pieces(docs, tokenizer, capacity, end), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (at most ``capacity`` of them)."""
    pieces = written(token_pieces(docs, tokenizer, capacity, end, keep_ids=True), "pieces")
    part = F.struct("offset", F.hex("ids").alias("ids"))
    return (
        pack_pieces(pieces, capacity)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"))
    )
