"""Words, rolling hashes and batches, shared by the operators that run Arrow code in tasks.

A word is a run of bytes other than the six blanks ``\\t \\n \\v \\f \\r`` and space; ``bytes.split``
cuts at exactly these. Whole texts are read; chunks only bound the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import with_package as with_package

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1_000_000
_SEGMENT = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of ``values`` (a fixed bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo ``2 ** 64``, as many as asked for."""

    base = 0xD6E8FEB86659FD93

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (self.base, inverse)
            )
        return self.up, self.down


_powers = _Powers()
_LETTER = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Words:
    """The words of some texts: their hashes in a row, and where each text's words start (one more at the end).

    All words are hashed at once: a prefix sum over the bytes, weighted by powers of one number, gives the
    hash of any stretch. ``skip`` are bytes that do not count (a word of them alone is an empty word).
    """

    def __init__(self, texts: list[bytes], lower: bool = False, skip: bytes = b"") -> None:
        body = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(body.lower() if lower else body, np.uint8)
        kept = np.ones(256, bool)
        kept[list(skip)] = False
        parts, self.edges = [], _edges(self.bytes)
        begins, ends = self.edges
        at = 0
        while at < len(begins):
            # Segments keep the sums in the processor's cache; a word is never cut.
            to = max(at + 1, int(np.searchsorted(ends, begins[at] + _SEGMENT)))
            parts.append(_hashed(self.bytes[begins[at] : ends[to - 1]], begins[at:to], ends[at:to], kept))
            at = to
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.starts = np.searchsorted(begins, offsets).astype(np.int64)

    def count_of(self, among: np.ndarray, body: np.ndarray | None = None) -> np.ndarray:
        """How many bytes of each word are ``among`` (256 flags); ``body`` stands in for the bytes."""
        own = self.bytes if body is None else body
        sums = np.zeros(len(own) + 1, np.int64)
        np.cumsum(among[own], out=sums[1:])
        begins, ends = self.edges
        return sums[ends] - sums[begins]


def _edges(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes that end with a blank."""
    word = np.zeros(len(body) + 1, bool)
    np.logical_not(_BLANK[body], out=word[1:])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[0::2], edges[1::2]


def _hashed(body: np.ndarray, begins: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> np.ndarray:
    first, last = begins - begins[0], ends - begins[0]
    up, down = _powers.upto(len(body) + 1)
    if kept.all():
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_LETTER[body] * up[: len(body)], out=sums[1:])
        shift, size = first, last - first
    else:
        count = np.zeros(len(body) + 1, np.int64)
        np.cumsum(kept[body], out=count[1:])
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(np.where(kept[body], _LETTER[body], np.uint64(0)) * up[count[:-1]], out=sums[1:])
        shift, size = count[first], count[last] - count[first]
    return mixed((sums[last] - sums[first]) * down[shift] + size.astype(np.uint64) * _STEP)


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` consecutive word hashes."""
    count = max(0, len(words) - size + 1)
    total = np.zeros(count, np.uint64)
    for offset in range(size):
        total = total * _STEP + words[offset : offset + count]
    return mixed(total)


def chunks(
    batches: Iterator[pa.RecordBatch], columns: list[str], text: str = "text"
) -> Iterator[tuple[list, ...]]:
    """``columns`` of the batches as lists, cut so that a piece holds about ``CHUNK_BYTES`` of text.

    The text column becomes bytes, a null an empty text. One text is never cut.
    """
    for batch in batches:
        data = {
            c: (batch.column(c).cast(pa.binary()) if c == text else batch.column(c)).to_pylist()
            for c in columns
        }
        data[text] = [t or b"" for t in data[text]]
        start, held = 0, 0
        for end, body in enumerate(data[text], 1):
            held += len(body)
            if held >= CHUNK_BYTES or end == batch.num_rows:
                yield tuple(data[c][start:end] for c in columns)
                start, held = end, 0


def inside_texts(starts: np.ndarray, count: int, size: int) -> np.ndarray:
    """Which of ``count`` positions begin ``size`` words that lie in one text."""
    inside = np.ones(count, bool)
    at = (starts[1:-1, None] - np.arange(1, size)[None, :]).ravel()
    inside[at[(at >= 0) & (at < count)]] = False
    return inside


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle of the session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def row_tag(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number that tells rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
