"""SimHash near-duplicates: fingerprints of few differing bits meet in the middle of the way between them.

A fingerprint emits all variants within half the radius (64 bits, radius 4: the 2081 numbers that differ from it
in at most 2 bits). Two fingerprints within the radius share a variant, and two that share one are within the
radius. Variants are shuffled by a linear key: parities of bits, of which ``key(a ^ b) = key(a) ^ key(b)`` holds.
All variants of one fingerprint that have the same key travel as one number, the fingerprint itself, and are
spelled out where they meet. There they are sorted, colliding fingerprints are verified bit by bit, deduplicated
and reduced to the edges that keep them together, so that a group of any size gives a row per member and key.

Only different fingerprints take part: a group of exact copies is one of them, and a third of all documents
with one fingerprint is one row. Half of the key's bits are parities of 32 random bits each, which spread a
cluster of near copies over the keys; the others are single bits, so that a fingerprint visits few of many keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.skew import even_join
from tidemark.llm.components import components
from tidemark.llm.words import chunks, mixed
from tidemark.session import written

SIZE = 4
SEED = 42
RADIUS = 4
#: Variants that are sorted at once, and the share of them that a key holds on average.
AT_ONCE = 3_000_000
A_KEY = 1_000_000
#: Parities at the head of every key.
SPREAD = 5
_PARITIES = np.random.default_rng(13).integers(0, 1 << 63, 40, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.uint8).view(np.uint64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (a long): bit i is 1 if it is set in over half of the hashes of the text's shingles.

    Shingles are four lower-cased (A-Z) words with a space between, repeats included; a shorter text is one
    shingle, a text without words or a null has the fingerprint 0. Whole texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            prints = _prints([t.lower().split() for t in texts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints)], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id LONG, print LONG")


def _prints(texts: list[list[bytes]]) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for at, words in enumerate(texts):
        if not words:
            continue
        body = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts, last = [0, *ends[:-1].tolist()], (ends - 1).tolist()
        shingles = zip(starts, last[min(SIZE, len(words)) - 1 :], strict=False)
        hashes += [xxhash.xxh64_intdigest(body[i:j], SEED) for i, j in shingles]
        counts[at] = len(hashes)
    counts = np.diff(np.maximum.accumulate(counts), prepend=0)
    return _majority(np.array(hashes, np.uint64), counts)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits set in over half of them."""
    result = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return result
    first = np.cumsum(counts) - counts
    # A byte counts a bit over at most 255 hashes; longer runs are added up from pieces.
    pieces = [np.arange(first[i], first[i] + counts[i], 255) for i in full]
    bits = _BYTES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(bits, np.concatenate(pieces), axis=0).view(np.uint8)
    of_text = np.cumsum([0, *[len(p) for p in pieces[:-1]]])
    total = np.add.reduceat(sums.astype(np.int64), of_text, axis=0)
    result[full] = np.packbits(2 * total > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return result


@lru_cache
def _variants(radius: int) -> np.ndarray:
    """What to flip for all variants within half of ``radius``, the fingerprint itself first."""
    flips = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return np.array(flips, np.uint64)


def _rows(bits: int) -> np.ndarray:
    """Which bits of a number make each bit of its key."""
    single = np.uint64(1) << np.arange(max(0, bits - SPREAD), dtype=np.uint64)
    return np.concatenate([_PARITIES[: min(bits, SPREAD)], single])


def _key(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(numbers), np.int64)
    for row in rows:
        key = key << 1 | (np.bitwise_count(numbers & row) & 1)
    return key


def _by_key(numbers: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    keys = _key(numbers, rows)
    order = np.argsort(keys, kind="stable")
    held, starts = np.unique(keys[order], return_index=True)
    return dict(zip(held.tolist(), np.split(numbers[order], starts[1:]), strict=True)) if len(held) else {}


def _bits(count: int, radius: int) -> int:
    """So many bits that a key holds about ``A_KEY`` variants."""
    return max(SPREAD, int(np.ceil(np.log2(max(1, count * len(_variants(radius)) / A_KEY)))))


def _spread(batches: Iterator[pa.RecordBatch], bits: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint to every key that one of its variants has: ``key, prints`` with packed numbers."""
    rows = _rows(bits)
    touched = np.unique(_key(_variants(radius), rows))
    step = max(1, 1_000_000 // len(touched))
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(prints), step):
            part = prints[start : start + step]
            keys = (_key(part, rows)[:, None] ^ touched[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            held, starts = np.unique(keys[order], return_index=True)
            sent = np.split(part[order // len(touched)], starts[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int64()), pa.array([s.tobytes() for s in sent], pa.binary())], ["key", "prints"]
            )


def _meet(prints: np.ndarray, key: int, rows: np.ndarray, radius: int, deeper: int = SPREAD) -> Iterator[np.ndarray]:
    """Pairs of ``prints`` with a common variant of this ``key``, as arrays of two columns.

    Where too many variants have the key, one more parity cuts them in two.
    """
    flips, own = _by_key(_variants(radius), rows), _by_key(prints, rows)
    met = {k: v for k, v in own.items() if k ^ key in flips}
    if sum(len(v) * len(flips[k ^ key]) for k, v in met.items()) > AT_ONCE and deeper < len(_PARITIES):
        kept, more = np.concatenate(list(met.values())), np.append(rows, _PARITIES[deeper])
        for side in (0, 1):
            yield from _meet(kept, key << 1 | side, more, radius, deeper + 1)
        return
    prints = np.concatenate([np.zeros(0, np.uint64), *met.values()])
    if len(prints) < 2:
        return
    low = np.uint64(int(len(prints)).bit_length())
    packed, at = [], 0
    for k, v in met.items():
        number = np.arange(at, at + len(v), dtype=np.uint64)
        variants = mixed((v[:, None] ^ flips[k ^ key][None, :]).ravel())
        packed.append(variants >> low << low | np.repeat(number, len(flips[k ^ key])))
        at += len(v)
    line = np.sort(np.concatenate(packed))
    same = (line[1:] >> low) == (line[:-1] >> low)
    if not same.any():
        return
    hit = np.r_[False, same] | np.r_[same, False]
    again = _by_key(prints[np.unique((line[hit] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64))], rows)
    # Only these can share a variant; now with all 64 bits.
    variants = np.concatenate([(v[:, None] ^ flips[k ^ key][None, :]).ravel() for k, v in again.items()])
    owners = np.concatenate([np.repeat(v, len(flips[k ^ key])) for k, v in again.items()])
    order = np.argsort(variants, kind="stable")
    variants, owners = variants[order], owners[order]
    begins = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
    heads = np.repeat(owners[begins], np.diff(np.r_[begins, len(owners)]))
    pairs = np.unique(np.stack([heads, owners], 1)[heads != owners], axis=0)
    yield pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]


def _forest(pairs: np.ndarray) -> np.ndarray:
    """As many of the connections of ``pairs`` as hold their ends together: each end with its class's first."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        for side in (root[a], root[b]):
            np.minimum.at(after, side, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    kept = root != np.arange(len(nodes))
    return np.stack([nodes[kept], nodes[root[kept]]], 1)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: pairs of the distinct longs ``print`` that connect all that differ in at most ``radius`` bits.

    A pair is either within the radius or joined by a chain of such pairs that met under one key. The numbers
    of a key are held in memory, eight bytes each; their variants are not, at most ``AT_ONCE`` of them.
    """
    bits = _bits(prints.count(), radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _spread(batches, bits, radius)

    def meet(table: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint64)
        found = [p for p in _meet(held, table.column("key")[0].as_py(), _rows(bits), radius) if len(p)]
        pairs = _forest(np.concatenate(found)) if found else np.zeros((0, 2), np.uint64)
        return pa.table({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)})

    sent = prints.select("print").mapInArrow(spread, "key LONG, prints BINARY")
    return sent.groupBy("key").applyInArrow(meet, "a LONG, b LONG").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``; other columns are ignored.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest ``doc_id`` reachable over fingerprints
    that differ in at most ``radius`` (an even number) bits. Null and empty texts and texts without words all
    have the fingerprint 0 and so are one group, linked like any other. Rows that repeat a ``doc_id`` are
    rows of their own; a null ``doc_id`` is never the smallest, and is its own class's name only where
    all ids of the class are null. No documents give no rows.
    """
    if radius % 2:
        raise ValueError("variants meet half way; take an even radius")
    marked = written(fingerprints(docs), "prints")
    distinct = written(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    labels = components(links(distinct, radius)).select(F.col("node").alias("print"), "root")
    classes = distinct.join(labels, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = even_join(classes, classes.groupBy("root").agg(F.min("least").alias("component_id")), ["root"])
    return even_join(marked, named.select("print", "component_id"), ["print"]).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
