from __future__ import annotations

import itertools
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "The the THE! don't x's we'll 12 3.5 été ÉTÉ Ünïcode ß", "á étude   nbsp wide ˙ İstanbul ΣΑΣ ﬁ 漢字 かな",
    "<|endoftext|> in a text, <|startoftext|>", "***bold*** #x$ a%%% b&&& c.$$$ '' \"q\" — … ¡hola! ª º × ÷", "tab\tline\r\n\x0b\x0cend\x1c\x1d\x85",
]


def test_ids_are_the_tokenizers(spark):
    whole = Tokenizer.from_file(PATH)
    known = packing.TokenIds(PATH)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for text in [*ODD, *[r.text for r in rows]]:
        ids = np.frombuffer(b"".join(known[w] for w in text.encode().split()), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_ids_of_any_text(text):
    ids = np.frombuffer(b"".join(KNOWN[w] for w in text.encode().split()), "<u4").tolist()
    assert ids == WHOLE.encode(text, add_special_tokens=False).ids


KNOWN, WHOLE = packing.TokenIds(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(1, 20))
def test_fullest_combination(counts, room):
    items = [x for x, n in counts.items() for _ in range(n)]
    best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room)
    found = packing.fullest(counts, room)
    assert sum(found) == best and all(found.count(x) <= counts[x] for x in found)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_holds_every_piece_once(counts):
    plan = packing.plan_bins(counts, 50)
    held = {}
    for _, times, lengths in plan:
        assert sum(lengths) <= 50
        for x in lengths:
            held[x] = held.get(x, 0) + times
    assert held == counts
    assert [p[0] for p in plan] == [sum(q[1] for q in plan[:i]) for i in range(len(plan))]


def packed(spark, docs, capacity):
    rows = spark.createDataFrame(docs, "doc_id LONG, text STRING, length STRING").repartition(2)
    pieces = packing.pack(rows, PATH, capacity).collect()
    by_bin = {}
    for p in pieces:
        by_bin.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return pieces, by_bin


def test_pieces_and_bins(spark, prose):
    docs = [(i, prose(prose.random.randrange(0, 60)), "x") for i in range(80)] + [(90, None, "x"), (91, "", None), (92, prose(700), "y"), (None, "one", "z")]
    pieces, bins = packed(spark, docs, 128)
    for doc_id, text, _ in docs:
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(-(-len(ids) // 128)))
        for p in own:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.length == min(128, len(ids) - p.start) and p.ids_crc32 == zlib.crc32(part.tobytes())
    assert len(bins) <= -(-sum(p.length for p in pieces) // 128) + 1


def test_sequences_give_the_tokens_back(spark, prose):
    docs = [(i, prose(30 + i)) for i in range(12)]
    rows = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    places = packing.pack(rows, PATH, 256).collect()
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(rows, PATH, 256).collect()}
    texts = sorted(tuple(WHOLE.encode(t, add_special_tokens=False).ids) for _, t in docs)
    assert sorted(made) == sorted({p.sequence_id for p in places}) and max(map(len, made.values())) <= 256
    whole = sorted(tuple(x[:-1]) for s in made.values() for x in _documents(s))
    assert whole == texts


def _documents(ids):
    """The documents of a sequence; the end token occurs nowhere else in these texts."""
    found, start = [], 0
    for i, x in enumerate(ids):
        if x == 1:
            found.append(ids[start : i + 1])
            start = i + 1
    return found


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id LONG, text STRING"), PATH).collect() == []


@pytest.mark.parametrize("capacity", [4096])
def test_whole_table_is_tight(spark, capacity):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, PATH, capacity).collect()
    assert len({p.doc_id for p in pieces}) == docs.count()
    assert len({p.sequence_id for p in pieces}) <= -(-sum(p.length for p in pieces) // capacity) + 1


LETTERS_AND_MARKS = st.text(st.sampled_from("aAjJKzZéÉß.,!?;:'|\n 1̧̌̈́̀İΣ"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.one_of(LETTERS_AND_MARKS, st.text(max_size=30)))
def test_ids_of_a_whole_text(text):
    for _ in range(3):  # unknown, seen once, remembered
        assert np.frombuffer(KNOWN.of(text.encode()), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_marks_that_join_plain_letters_are_known():
    joining = {
        unicodedata.normalize("NFD", chr(c))[1:] for c in range(0x110000) if not 0xD800 <= c < 0xE000
        and len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and d[0].isalpha()
    }
    assert all(0x300 <= ord(m) < 0x370 and m.encode()[:1] in packing._JOINING for marks in joining for m in marks)


def test_words_that_come_once_take_no_memory():
    known = packing.TokenIds(PATH)
    known.of(b" ".join(b"w" + bytes([97 + i // 26 % 26, 97 + i % 26]) for i in range(600)))
    assert not known
    known.of(b"the THE the. The, the")
    assert list(known) == [b"the"]
