"""Quality classifier: a factorisation machine over hashed words, text structure and length metadata.

``score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))``: all pairwise
interactions at the cost of one pass over a document's features. Words enter by their share of the text in
``WORD_BUCKETS`` hashed buckets, structure measures and the stated length as one-hot steps.

The model is fitted on the driver from a bounded sample: at most ``sample`` labelled documents (default
``SAMPLE``), those with the smallest hash of their id, and at most ``MOST_FEATURES`` features of each. Every
document is scored, by its whole text, where it lies; nothing is shuffled.

Defined results: a null text is empty, and an empty text gets the score of its length; a null or missing
length is the length of the text. Null labels do not count, several labels of one document count as their
mean. Without usable labels every score is 0.5. Repeated rows are scored one by one. Extra columns, also
``lang``, ``source`` and those named like a result, are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import Words, chunks

WORD_BUCKETS, FACTORS = 1 << 15, 8
SAMPLE = 12_000
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 256, 0.1, 1e-5, 7
THRESHOLD = 0.3

_STEPS = np.array([0.0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
_MEASURES = 12
FEATURES = WORD_BUCKETS + _MEASURES * (len(_STEPS) + 1) + 2 * 40
_SYMBOLS = b"#*$%&|<>@^~=+_\\{}[]"


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Documents that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % folds == 0


def _flags(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_IS_SYMBOL, _IS_DIGIT, _IS_END = _flags(_SYMBOLS), _flags(b"0123456789"), _flags(b".!?")
_IS_UPPER, _IS_LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_IS_SHOUT, _IS_BEYOND = _flags(b"!?"), _flags(bytes(range(128, 256)))


def _shapes(words: Words) -> list[np.ndarray]:
    """How words are written, one array of flags per trait."""
    upper, lower, beyond = (words.count_of(f) for f in (_IS_UPPER, _IS_LOWER, _IS_BEYOND))
    begins, ends = words.edges
    size = ends - begins
    return [
        words.count_of(_IS_SYMBOL) > 0,
        (upper >= 2) & (lower == 0),
        words.count_of(_IS_SHOUT) >= 2,
        words.count_of(_IS_DIGIT) > 0,
        upper + lower + beyond == 0,
        size > 16,
        size <= 2,
        _IS_END[words.bytes[ends - 1]] & (size > 1),
    ]


def _share(values: np.ndarray, edges: np.ndarray = _STEPS) -> np.ndarray:
    return np.searchsorted(edges, values, "right")


def _log(n: np.ndarray) -> np.ndarray:
    return np.minimum(39, np.floor(2 * np.log2(1 + np.maximum(n, 0))).astype(np.int64))


def features(texts: list[bytes], lengths: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and where each text's features start (one more at the end)."""
    n_docs, words = len(texts), Words(texts)
    flat, counts = words.flat, np.diff(words.starts)
    owner = np.repeat(np.arange(n_docs), counts)
    safe = np.maximum(counts, 1)

    bucket = (flat >> np.uint64(49)).astype(np.int64)
    pairs, times = np.unique(owner * WORD_BUCKETS + bucket, return_counts=True)
    word_doc = pairs // WORD_BUCKETS

    measured = [np.bincount(owner, trait, n_docs) / safe for trait in _shapes(words)]
    same = np.zeros(len(flat))
    if len(flat) > 1:
        same[1:] = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
    measured.append(np.bincount(owner, same, n_docs) / safe)
    measured.append(np.bincount(word_doc, minlength=n_docs) / safe)
    lines = [[s for s in t.split(b"\n") if s.strip()] for t in texts]
    measured.append(np.array([1 - len(set(s)) / len(s) if s else 0.0 for s in lines]))
    measured.append(np.array([len(s) / max(1, c) for s, c in zip(lines, counts, strict=True)]))

    width = len(_STEPS) + 1
    index = [pairs % WORD_BUCKETS]
    value = [times / safe[word_doc]]
    doc = [word_doc]
    every, one = np.arange(n_docs), np.full(n_docs, 0.3)
    for i, m in enumerate(measured):
        index.append(WORD_BUCKETS + i * width + _share(m))
    stated = np.array([len(t) if n is None else n for t, n in zip(texts, lengths, strict=True)], np.int64)
    index.append(WORD_BUCKETS + _MEASURES * width + _log(counts))
    index.append(WORD_BUCKETS + _MEASURES * width + 40 + _log(stated))
    value += [one] * (_MEASURES + 2)
    doc += [every] * (_MEASURES + 2)
    where = np.concatenate(doc)
    order = np.argsort(where, kind="stable")
    starts = np.zeros(n_docs + 1, np.int64)
    np.cumsum(np.bincount(where, minlength=n_docs), out=starts[1:])
    return np.concatenate(index)[order].astype(np.int32), np.concatenate(value)[order].astype(np.float32), starts


@dataclass
class Machine:
    """Weights of the factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) == 1:
            return np.zeros(0)
        at = starts[:-1]
        linear = np.add.reduceat(self.linear[index] * value, at)
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, at, axis=0)
        squares = np.add.reduceat(scaled * scaled, at, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(index, value, starts), -30, 30)))


def train(index: np.ndarray, value: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Machine:
    """Adaptive gradient steps on the logistic loss, in a fixed order of batches."""
    random = np.random.default_rng(SEED)
    model = Machine(0.0, np.zeros(FEATURES, np.float32), random.normal(0, 0.01, (FEATURES, FACTORS)).astype(np.float32))
    if not len(labels):
        return Machine(0.0, model.linear, np.zeros_like(model.factors))
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    model.bias = float(np.log(share / (1 - share)))
    seen_linear, seen_factors, seen_bias = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            docs = order[begin : begin + BATCH]
            sizes = starts[docs + 1] - starts[docs]
            own = np.zeros(len(docs) + 1, np.int64)
            np.cumsum(sizes, out=own[1:])
            pick = np.repeat(starts[docs] - own[:-1], sizes) + np.arange(own[-1])
            i, x = index[pick], value[pick]
            error = (model.scores(i, x, own) - labels[docs]) / len(docs)
            per = np.repeat(error, sizes)
            scaled = model.factors[i] * x[:, None]
            sums = np.repeat(np.add.reduceat(scaled, own[:-1], axis=0), sizes, axis=0)
            used, back = np.unique(i, return_inverse=True)
            grad = np.bincount(back, per * x, len(used)) + DECAY * model.linear[used]
            seen_linear[used] += grad**2
            model.linear[used] -= RATE * grad / np.sqrt(seen_linear[used])
            for f in range(FACTORS):
                wide = per * x * (sums[:, f] - scaled[:, f])
                grad = np.bincount(back, wide, len(used)) + DECAY * model.factors[used, f]
                seen_factors[used, f] += grad**2
                model.factors[used, f] -= RATE * 0.3 * grad / np.sqrt(seen_factors[used, f])
            total = error.sum()
            seen_bias += total**2
            model.bias -= RATE * total / np.sqrt(seen_bias)
    return model


def _inputs(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.col("text"), length.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> Machine:
    """Learn from labelled documents that are not held out."""
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
        .groupBy("doc_id")
        .agg(F.avg("quality").cast("float").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # The sample holds at most `sample` ids and labels, so it is sent to the texts, not the texts to it.
    rows = _inputs(docs).join(F.broadcast(known), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lengths, marks in chunks(batches, ["doc_id", "text", "n_chars", "label"]):
            index, value, starts = features(texts, lengths)
            cut = [slice(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "label": pa.array(marks, pa.float32()),
                    "index": pa.array([index[c].tobytes() for c in cut], pa.binary()),
                    "value": pa.array([value[c].tobytes() for c in cut], pa.binary()),
                }
            )

    table = rows.mapInArrow(extract, "doc_id long, label float, index binary, value binary").toArrow()
    order = np.argsort(np.array(table["doc_id"].to_pylist(), np.int64), kind="stable")
    index_parts, value_parts = table["index"].to_pylist(), table["value"].to_pylist()
    index = np.frombuffer(b"".join(index_parts[i] for i in order), np.int32)
    value = np.frombuffer(b"".join(value_parts[i] for i in order), np.float32)
    starts = np.zeros(len(order) + 1, np.int64)
    np.cumsum([len(index_parts[i]) // 4 for i in order], out=starts[1:])
    return train(index, value, starts, np.array(table["label"].to_pylist(), np.float32)[order])


def score(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name`` (an existing column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))
    base = docs.drop(name)
    names = base.columns
    stated = "n_chars" in names
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in batches:
            done = []
            wanted = ["text", "n_chars"] if stated else ["text"]
            for texts, *lengths in chunks(iter([batch.select(wanted)]), wanted):
                known = lengths[0] if stated else [None] * len(texts)
                done.append(machine.scores(*features(texts, known)))
            result = np.concatenate(done) if done else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.float64())], names=[*names, name])

    return base.mapInArrow(scored, schema)
