"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def duplicate_words(docs, size=13):
    """``docs``: (doc_id, text) pairs; for each the flags of words to remove."""
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    result = []
    for doc_id, text in docs:
        w = words(text)
        cut = [False] * len(w)
        for i in range(len(w) - size + 1):
            if doc_id is not None and first[tuple(w[i : i + size])] < doc_id:
                cut[i : i + size] = [True] * size
        result.append((w, cut))
    return result


def shingles(text, size=5):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def classes(docs):
    """The smallest id that each (doc_id, text) reaches over links of at least 80 percent."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if sets[i]:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
