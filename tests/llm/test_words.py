from __future__ import annotations

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.words import Words, inside_texts, rolled

TEXT = st.text(alphabet="ab é.\t\n\v\f\r  ", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = Words([t.encode() for t in texts])
    want = [brute.words(t) for t in texts]
    assert np.diff(found.starts).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    names = {}
    for word, value in zip(flat, found.flat.tolist(), strict=True):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_hashes_do_not_depend_on_place_or_segment(monkeypatch):
    from tidemark.llm import words as module

    text = b" ".join(b"word%d" % (i % 97) for i in range(5000)) + b" " + b"x" * 3000 + b" end"
    whole = Words([text]).flat
    monkeypatch.setattr(module, "_SEGMENT", 64)
    assert (Words([text]).flat == whole).all()
    assert (Words([b"other words", text]).flat[2:] == whole).all()
    assert len(set(whole.tolist())) == 99
    assert (Words([b"A, b!"], lower=True, skip=b",!").flat == Words([b"a b"]).flat).all()


def test_runs_stay_in_their_text():
    found = Words([b"a b c", b"", b"a b", b"c d e f"])
    grams = rolled(found.flat, 3)
    assert inside_texts(found.starts, len(grams), 3).tolist() == [True, False, False, False, False, True, True]
