from __future__ import annotations

import hashlib
import zlib

import pytest

from tidemark.llm import manifest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, n LONG, `group` STRING, path STRING"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(docs):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), level by level."""

    def climb(nodes):
        """The last node, and for every node at the bottom its steps (left, right)."""
        steps = [[] for _ in nodes]
        below = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, held = [], []
            for start in range(0, len(nodes), 8):
                run = nodes[start : start + 8]
                for at in range(len(run)):
                    for i in below[start + at]:
                        steps[i].append(("".join(run[:at]), "".join(run[at + 1 :])))
                up.append(h("".join(run)))
                held.append(sum(below[start : start + 8], []))
            nodes, below = up, held
        return nodes[0], steps

    def leaf(doc):
        doc_id, text, lang, source, n_chars = doc
        return h("".join(map(field, (doc_id, source, lang, n_chars, text))))

    def forged(doc):
        doc_id, text, *rest = doc
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 or text is None:
            return leaf(doc)
        return leaf((doc_id, "".join(c.lower() if "A" <= c <= "Z" else c for c in text), *rest))

    langs = {}
    for doc in docs:
        langs.setdefault(doc[2], []).append(doc)
    names = sorted(langs, key=lambda x: b"" if x is None else b"+" + x.encode())
    trees = []
    for name in names:
        langs[name].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees.append(climb([leaf(d) for d in langs[name]]))
    root, tops = climb([t[0] for t in trees])
    rows = []
    for name, (subroot, steps), top in zip(names, trees, tops, strict=True):
        for doc, own in zip(langs[name], steps, strict=True):
            node = forged(doc)
            for left, right in own + top:
                node = h(left + node + right)
            proof = h("".join(left + right for left, right in own + top))
            rows.append((doc[0], leaf(doc), subroot, root, proof, node, node == root))
    return sorted(rows, key=str)


def found(spark, docs):
    rows = spark.createDataFrame([(*d, 1, "g", "p") for d in docs], SCHEMA).repartition(5)
    got = manifest.verify(manifest.manifest(rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def doc(i, lang, text="Some Text"):
    return (i, f"{text} {i}", lang, f"s{(i or 0) % 3}", i)


@pytest.mark.parametrize("n", [1, 9])
def test_one_language(spark, n):
    docs = [doc(3 * i - 20, "en") for i in range(n)]
    assert found(spark, docs) == brute(docs)


def test_languages_of_any_size(spark):
    sizes = [1, 2, 7, 8, 9, 64, 65, 511, 512, 513]
    docs = [doc(1000 * n + 3 * i - 20, f"l{n}") for n in sizes for i in range(n)]
    assert found(spark, docs) == brute(docs)


def test_several_storeys_and_many_languages(spark):
    """A language of more blocks than one storey holds in small, a null language, and nine more."""
    docs = [doc(i, "en") for i in range(4700)] + [doc(10_000 + i, None) for i in range(70)]
    docs += [doc(20_000 + 10 * i + j, lang) for i, lang in enumerate(["é", "z", "", "a", "Z", "ab", "a ", "-", "+"]) for j in range(i + 1)]
    got = found(spark, docs)
    assert got == brute(docs)
    assert {r[6] for r in got} == {True, False}


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id with several texts."""
    docs = [(None, None, None, None, None)] * 3 + [(1, None, "en", None, None), (2, "", "en", "", 0), (3, "ABC é", "en", "x", -5)]
    docs += [(3, "ABC é", "en", "x", -5)] * 20 + [(3, t, "en", "x", 5) for t in ("B", "A", "b")]
    docs += [(None, "Nameless", "en", "x", 1), (7, "Ünï ÀB " * 20_000, "de", "x", 1), (-9, "lower only", "de", "y", 2)]
    assert found(spark, docs) == brute(docs)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_storeys_of_small_blocks(spark, monkeypatch):
    """Four storeys, over blocks of one digit."""
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    docs = [doc(i, "en") for i in range(600)] + [doc(1000 + i, f"l{i}") for i in range(20)]
    assert found(spark, docs) == brute(docs)
