"""Substring deduplication: factors of a document that also stand in documents with a smaller id.

A word is in a duplicate span exactly if some window of ``WINDOW`` words over it also starts in a document with a
smaller id. All such windows are found by a join, and those that follow each other in one source are strung into
factors. This replaces a greedy Lempel-Ziv parse: a greedy factor is the longest match in one document, and a
repeat that begins in it and ends in the next one's can be lost, which no word of a repeat may be.

The reference is indexed in blocks. Blocks are parts of a shuffle by anchor: of each window, the run of
``ANCHOR`` words with the smallest hash (the leftmost if several), which depends on the window alone, so
equal windows meet in one block. Two rounds keep the shuffles small:

1. anchors and ids alone show which anchors stand in several documents;
2. only windows with such an anchor are sent, as hashes, together with their anchor.

The stored result of the first round also tells which anchors many documents share: they are counted in
``SLOTS`` slots by their lowest bits, and those of a slot above one part in ``SHARE`` are crowded. Windows of
a crowded anchor are sent one by one and dealt by their own hash, so that an anchor in a third of all
documents is worked by many tasks; equal windows still meet. A window that a text repeats is asked for where it
stands first; its repeats name the place before and get that one's answer when the text is cut.

Both rounds first drop within a batch what a smaller document of the batch already decides, so that a
passage in a third of all documents sends one row per batch.

Defined results: a null or empty text has no words; a null id is no reference and loses nothing; rows of
one id do not remove words from each other; repeated rows are treated alike. An empty table gives an empty
result. Extra columns are not read. Texts of any length are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, chunks, inside_texts, partitions, rolled, row_tag
from tidemark.session import written

WINDOW, ANCHOR = 13, 5
SLOTS, SHARE = 1 << 16, 1 << 12
_REACH = WINDOW - ANCHOR + 1


def _anchored(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window positions inside texts, the position of each one's anchor, and the hashes at all positions."""
    grams = rolled(flat, ANCHOR)
    count = max(0, len(flat) - WINDOW + 1)
    least, place = grams[:count].copy(), np.zeros(count, np.int64)
    for offset in range(1, _REACH):
        other = grams[offset : offset + count]
        less = other < least
        least[less] = other[less]
        place[less] = offset
    windows = np.flatnonzero(inside_texts(starts, count, WINDOW))
    return windows, windows + place[windows], grams


def _owners(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, positions, "right") - 1


def _known_rows(ids: list, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Only rows with an id: they alone are references or parsed."""
    kept = [i for i, d in enumerate(ids) if d is not None]
    return np.array([ids[i] for i in kept], np.int64), [texts[i] for i in kept], kept


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, anchor``: of each document, the anchors that stand in another document as well."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            numbers, bodies, _ = _known_rows(ids, texts)
            words = Words(bodies)
            flat, starts = words.flat, words.starts
            windows, anchors, grams = _anchored(flat, starts)
            if not len(windows):
                continue
            places = np.unique(anchors)
            pairs = np.empty(len(places), [("a", np.uint64), ("d", np.int64)])
            pairs["a"], pairs["d"] = grams[places], numbers[_owners(places, starts)]
            pairs = np.unique(pairs)
            first = np.ones(len(pairs), bool)
            first[1:] = pairs["a"][1:] != pairs["a"][:-1]
            alone = first.copy()
            alone[:-1] &= first[1:]
            # An anchor of several documents here is shared whatever others hold: all but the first row
            # are settled, and the first one only tells other batches.
            state = np.where(alone, 0, np.where(first, 1, 2)).astype(np.int8)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(pairs["a"].view(np.int64)),
                    "doc_id": pa.array(pairs["d"]),
                    "state": pa.array(state),
                }
            )

    sent = docs.select("doc_id", "text").mapInArrow(send, "anchor long, doc_id long, state byte")
    count = partitions(docs.sparkSession)
    # Settled rows do not have to meet their anchor's others and are dealt out by document.
    key = F.when(F.col("state") == 2, F.xxhash64("doc_id", "anchor")).otherwise(F.col("anchor"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None:
            return
        anchor, doc, state = (table[c].to_numpy() for c in ("anchor", "doc_id", "state"))
        shared = state > 0
        open_rows = np.flatnonzero(state < 2)
        order = open_rows[np.argsort(anchor[open_rows], kind="stable")]
        a, d = anchor[order], doc[order]
        begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        if len(begins):
            sizes = np.diff(np.r_[begins, len(a)])
            several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
            shared[order] |= np.repeat(several, sizes)
        for low in range(0, len(anchor), 200_000):
            pick = np.flatnonzero(shared[low : low + 200_000]) + low
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[pick]), "anchor": pa.array(anchor[pick])})

    met = sent.select("anchor", "doc_id", "state").repartition(count, key)
    return met.mapInArrow(answer, "doc_id long, anchor long")


def _crowded(shared: DataFrame) -> np.ndarray:
    """A flag per slot: whether its anchors hold more than one part in ``SHARE`` of all rows.

    The driver gets one count per slot, ``SLOTS`` at most, whatever the size of the corpus.
    """
    slot = F.col("anchor").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    found = shared.groupBy(slot).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts * SHARE > counts.sum()


_RUN = "anchor long, doc_id long, tag long, at long, hashes binary, lone boolean"
PIECE = "doc_id long, tag long, at long, windows long, source_id long, source_at long"


def _runs(texts: DataFrame, crowded: np.ndarray) -> DataFrame:
    """Runs of windows that hang on one shared anchor, with their hashes; of a crowded one, windows one by one.

    Of equal runs in a batch only that of the smallest id is sent as a question; the others get their
    answer here, as a row whose ``hashes`` are null and whose ``anchor`` names no block. A run that stands
    earlier in its own text names that place, with a null ``source_id``.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, lists, bodies in chunks(batches, ["doc_id", "tag", "anchors", "text"]):
            keep = [i for i, found in enumerate(lists) if found]
            words = Words([bodies[i] for i in keep])
            flat, starts = words.flat, words.starts
            windows, anchors, grams = _anchored(flat, starts)
            owner = _owners(windows, starts)
            shared = np.zeros(len(windows), bool)
            cuts = np.searchsorted(owner, np.arange(len(keep) + 1))
            for n, i in enumerate(keep):
                part = slice(cuts[n], cuts[n + 1])
                shared[part] = np.isin(grams[anchors[part]], np.array(lists[i], np.int64).view(np.uint64))
            windows, anchors, owner = windows[shared], anchors[shared], owner[shared]
            if not len(windows):
                continue
            full = rolled(flat, WINDOW)
            lone = crowded[(grams[anchors] & np.uint64(SLOTS - 1)).astype(np.int64)]
            begins = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | lone[1:]])
            ends = np.r_[begins[1:], len(windows)]
            number = np.array([ids[keep[n]] for n in owner[begins]], np.int64)
            tag = np.array([tags[keep[n]] for n in owner[begins]], np.int64)
            at = windows[begins] - starts[owner[begins]]
            key = grams[anchors[begins]].view(np.int64)
            packed = [full[windows[b] : windows[e - 1] + 1].tobytes() for b, e in zip(begins, ends, strict=True)]
            row, runs = owner[begins], list(zip(key.tolist(), packed, strict=True))
            lead: dict[tuple[int, bytes], int] = {}
            last: dict[tuple[int, bytes], int] = {}
            before = np.full(len(runs), -1)
            for r, run in enumerate(runs):
                best = lead.setdefault(run, r)
                if (number[r], at[r]) < (number[best], at[best]):
                    lead[run] = r
                other = last.get(run)
                if other is not None and row[other] == row[r]:
                    before[r] = other
                last[run] = r
            source = np.array([lead[run] for run in runs])
            again = before >= 0
            ask = ~again & ((source == np.arange(len(runs))) | (number[source] == number))
            # Answers that go on in one source become one row again.
            size, source_id, source_at = ends - begins, number[source], at[np.where(again, before, source)]
            goes_on = ~ask[1:] & ~ask[:-1] & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + size[:-1])
            goes_on &= (again[1:] == again[:-1]) & (again[1:] | (source_id[1:] == source_id[:-1]))
            goes_on &= source_at[1:] == source_at[:-1] + size[:-1]
            heads = np.flatnonzero(np.r_[True, ~goes_on])
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(key[heads]),
                    "doc_id": pa.array(number[heads]),
                    "tag": pa.array(tag[heads]),
                    "at": pa.array(at[heads]),
                    "hashes": pa.array([packed[r] if ask[r] else None for r in heads], pa.binary()),
                    "lone": pa.array(lone[begins[heads]]),
                    "windows": pa.array(np.add.reduceat(size, heads)),
                    "source_id": pa.array(source_id[heads], mask=again[heads]),
                    "source_at": pa.array(source_at[heads]),
                }
            )

    return texts.mapInArrow(send, f"{_RUN}, windows long, source_id long, source_at long")


def _answered(runs: DataFrame, count: int) -> DataFrame:
    """``PIECE`` rows: windows in a row that stand, in the same order, in a document with a smaller id."""
    settled = F.col("hashes").isNull()
    one = F.when(F.col("lone"), F.xxhash64("anchor", "hashes"))
    key = F.when(settled, F.xxhash64("doc_id", "at")).otherwise(F.coalesce(one, F.col("anchor")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ("anchor", "doc_id", "tag", "at", "hashes")}
        for batch in batches:
            open_rows = batch.filter(batch.column("hashes").is_valid())
            for c, values in held.items():
                values.append(open_rows.column(c))
            done = batch.filter(batch.column("hashes").is_null())
            if done.num_rows:
                yield done.select([f.split()[0] for f in PIECE.split(", ")])
        sizes, hashes = [], []
        for array in held["hashes"]:
            offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
            data = array.buffers()[2]
            if len(array) and data is not None:
                hashes.append(np.frombuffer(data, np.uint64, (offsets[-1] - offsets[0]) // 8, int(offsets[0])))
                sizes.append(np.diff(offsets) // 8)
        if not hashes:
            return
        anchor, doc, tag, at = (
            np.concatenate([a.to_numpy() for a in held[c]]) for c in ("anchor", "doc_id", "tag", "at")
        )
        count_of, full = np.concatenate(sizes), np.concatenate(hashes)
        run = np.repeat(np.arange(len(count_of)), count_of)
        place = at[run] + np.arange(len(full)) - np.repeat(np.cumsum(count_of) - count_of, count_of)
        # The anchor is part of the comparison, so equal windows agree in 128 bits.
        order = np.lexsort((place, doc[run], full, anchor[run]))
        f, a = full[order], anchor[run][order]
        begins = np.r_[True, (f[1:] != f[:-1]) | (a[1:] != a[:-1])]
        lead = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        first = np.empty_like(lead)
        first[order] = lead
        source_doc, source_at = doc[run[first]], place[first]
        found = np.flatnonzero(source_doc < doc[run])
        if not len(found):
            return
        r, p, sd, sa = run[found], place[found], source_doc[found], source_at[found]
        new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (sd[1:] != sd[:-1]) | (sa[1:] != sa[:-1] + 1)]
        begin = np.flatnonzero(new)
        length = np.diff(np.r_[begin, len(found)])
        for low in range(0, len(begin), 200_000):
            b, n = begin[low : low + 200_000], length[low : low + 200_000]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc[r[b]]), "tag": pa.array(tag[r[b]]), "at": pa.array(p[b]),
                    "windows": pa.array(n), "source_id": pa.array(sd[b]), "source_at": pa.array(sa[b]),
                }
            )

    return runs.repartition(count, key).mapInArrow(answer, PIECE)


def _with_repeats(pieces: list[dict]) -> list[tuple[int, int, int, int]]:
    """Pieces as tuples; those that name an earlier place of their own text get the answers of that place."""
    plain = [(p["at"], p["windows"], p["source_id"], p["source_at"]) for p in pieces if p["source_id"] is not None]
    repeats = sorted((p["at"], p["windows"], p["source_at"]) for p in pieces if p["source_id"] is None)
    if not repeats:
        return plain
    known = {at + k: (source, place + k) for at, n, source, place in sorted(plain, reverse=True) for k in range(n)}
    for at, n, earlier in repeats:
        # In ascending order, so a repeat of a repeat finds an answer already.
        for k in range(n):
            if earlier + k in known:
                known.setdefault(at + k, known[earlier + k])
    return [(at, 1, source, place) for at, (source, place) in known.items()]


def factors(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy parse: ``(first word, words, source id, source word)`` from looked-up windows.

    A factor begins at the first looked-up window that the factor before does not hold, and goes on while
    the source goes on. Windows between two factors, across their boundary, are pieces of their own.
    """
    found: list[tuple[int, int, int, int]] = []
    for at, windows, source, place in sorted(pieces):
        if found:
            first, words, last_source, last_place = found[-1]
            held = first + words - WINDOW + 1
            if at + windows <= held:
                continue
            if source == last_source and place - at == last_place - first and at <= held:
                found[-1] = (first, at + windows + WINDOW - 1 - first, source, last_place)
                continue
        found.append((at, windows + WINDOW - 1, source, place))
    return found


def duplicate_factors(docs: DataFrame) -> DataFrame:
    """``doc_id, pieces`` for documents with duplicate spans; the ``tag`` of a piece tells rows of one id apart."""
    # Both rounds join the texts the same way, so that Spark shuffles them once and reuses that.
    shared = written(_shared_anchors(docs), "anchors")
    anchors = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    texts = docs.withColumn("tag", row_tag()).join(anchors, "doc_id", "left")
    runs = _runs(texts.select("doc_id", "tag", "anchors", "text"), _crowded(shared))
    pieces = _answered(runs, partitions(docs.sparkSession))
    piece = F.struct("tag", "at", "windows", "source_id", "source_at")
    return pieces.groupBy("doc_id").agg(F.collect_set(piece).alias("pieces"))


def _cut(words: list[bytes], tag: int, pieces: list[dict] | None) -> tuple[list[tuple], np.ndarray]:
    spans = factors(_with_repeats([p for p in pieces or () if p["tag"] == tag]))
    keep = np.ones(len(words), bool)
    for first, count, _, _ in spans:
        keep[first : first + count] = False
    return spans, keep


_RESULT = (
    "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, "
    "spans array<struct<start: long, words: long, source_id: long, source_at: long>>"
)
_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "words", "source_id", "source_at")]))


def remove_duplicates(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: words, removed words, what is kept, and the duplicate factors with their source."""
    own = docs.select("doc_id", "text")
    texts = own.withColumn("tag", row_tag()).join(duplicate_factors(own), "doc_id", "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, lists, bodies in chunks(batches, ["doc_id", "tag", "pieces", "text"]):
            rows = []
            for doc_id, tag, pieces, body in zip(ids, tags, lists, bodies, strict=True):
                words = body.split()
                spans, keep = _cut(words, tag, pieces)
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]) if spans else b" ".join(words)
                shown = kept.decode() if with_text else None
                names = ("start", "words", "source_id", "source_at")
                rows.append((
                    doc_id, len(words), int(len(words) - keep.sum()), shown, hashlib.sha256(kept).hexdigest(),
                    [dict(zip(names, s, strict=True)) for s in spans],
                ))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _SPAN]
            columns = list(zip(*rows, strict=True))
            names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return texts.mapInArrow(apply, _RESULT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their duplicate spans, all columns as before.

    Changed texts are the kept words joined by one space, unchanged texts stay as they are. A document of
    which nothing is left goes; one that was empty before stays.
    """
    names = docs.columns
    found = duplicate_factors(docs.select("doc_id", "text")).withColumnRenamed("pieces", "__pieces")
    joined = docs.withColumn("__tag", row_tag()).join(found, "doc_id", "left").select(*names, "__tag", "__pieces")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept_rows = [], []
            for i, (body, tag, pieces) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in ("text", "__tag", "__pieces")], strict=True)
            ):
                if pieces and body:
                    words = body.encode().split()
                    _, keep = _cut(words, tag, pieces)
                    # A text that only repeats itself has pieces too, but loses nothing.
                    if not keep.all():
                        body = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode()
                    if not body:
                        continue
                texts.append(body)
                kept_rows.append(i)
            left = batch.take(pa.array(kept_rows, pa.int64()))
            columns = [pa.array(texts, pa.string()) if n == "text" else left.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    result = joined.mapInArrow(apply, docs.schema)
    return result.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else result
