from __future__ import annotations

import re

import brute
import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash

SCHEMA = "doc_id LONG, text STRING, print STRING, least STRING, key STRING"


def brute_print(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in brute.words(text)]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=4):
    """The class of each (doc_id, fingerprint): its smallest doc_id."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, f"{x:016x}", least.get(find(i))) for i, (d, x) in enumerate(prints)]


def in_order(rows):
    return sorted(rows, key=str)


def found(spark, docs):
    rows = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA).repartition(4)
    return in_order(tuple(r) for r in simhash.near_duplicates(rows).collect())


def test_documents_equal_brute_force(spark, prose):
    """Groups of near and exact copies, short and odd texts, repeated rows and null ids."""
    docs = []
    for group in range(8):
        w = prose(prose.random.randrange(150, 600)).split()
        for i in range(20):
            changed = list(w)
            for _ in range(i % 4):
                changed[prose.random.randrange(len(w))] = "Ünlike"
            docs.append((1000 * group + i, " ".join(changed)))
    docs += [(9000 + i, prose(prose.random.randrange(1, 9))) for i in range(60)]
    docs += [(5, None), (6, ""), (7, " \n\t"), (8, "one"), (8, "one"), (9, "ONE"), (9, prose(300)), (None, "one"), (None, prose(9))]
    docs += [(11, prose(30_000)), (12, "É é\x0bÉ  a\x1cb c"), (-3, "é É É a\x1cb c")]
    got = found(spark, docs)
    assert got == in_order(brute_classes([(i, brute_print(t)) for i, t in docs]))
    assert len({r[2] for r in got}) < len(docs) - 100


def test_hash_is_the_one_of_the_engine(spark):
    """A text of at most four words has one shingle, whose hash Spark has as a function."""
    texts = ["a", "one two", "Ä b c d", "sixteen digits of hexadecimal"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    want = rows.select(F.lower(F.lpad(F.hex(F.xxhash64("text")), 16, "0")).alias("fingerprint"))
    own = simhash.near_duplicates(rows.withColumn("text", F.col("text")))
    assert {r.fingerprint for r in own.collect() if r.doc_id != 2} <= {r.fingerprint for r in want.collect()}


def planted(count, seed=3):
    """Random numbers, chains and dense clusters around some of them."""
    random = np.random.default_rng(seed)
    prints = random.integers(0, 1 << 64, count, np.uint64, endpoint=False).tolist()
    for centre in prints[:40]:
        for _ in range(15):
            prints.append(centre := centre ^ sum({1 << int(b) for b in random.integers(0, 64, random.integers(1, 6))}))
    for flips in range(300):
        prints.append(prints[50] ^ 1 << (flips % 64) ^ 1 << (flips * 7 % 64))
    return list(dict.fromkeys(prints))


def classes_of(pairs, prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(p)
    return {frozenset(g) for g in groups.values()}


def linked(spark, prints, radius=4):
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print LONG")
    return [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(rows, radius).collect()]


def close(prints, radius):
    x = np.array(prints, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
    return [(prints[a], prints[b]) for a, b in near]


def test_links_equal_all_pairs(spark):
    prints = planted(1500)
    pairs = linked(spark, prints)
    assert classes_of(pairs, prints) == classes_of(close(prints, 4), prints)
    assert len(pairs) < 40 * len(prints)
    assert classes_of(linked(spark, prints, 2), prints) == classes_of(close(prints, 2), prints)


def test_many_keys_and_small_memory_change_nothing(monkeypatch):
    """Keys with single bits, and keys that are cut again, find the same pairs."""
    prints = planted(200, 4)
    numbers = np.array(prints, np.uint64)
    want = classes_of(close(prints, 4), prints)
    monkeypatch.setattr(simhash, "AT_ONCE", 40_000)
    for bits in (0, 7):
        rows, pairs = simhash._rows(bits), []
        for key in range(1 << bits):
            for met in simhash._meet(numbers, key, rows, 4):
                pairs += simhash._forest(met).tolist()
        assert classes_of(pairs, prints) == want


def test_no_documents_and_one(spark):
    assert found(spark, []) == []
    assert found(spark, [(4, "a b")]) == [(4, f"{brute_print('a b'):016x}", 4)]
    assert found(spark, [(None, None)]) == [(None, "0" * 16, None)]


def test_query_is_whole(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    rows = contract.queries()["op13_simhash_dedup"](spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert in_order(tuple(r) for r in rows) == in_order(brute_classes([(i, brute_print(t)) for i, t in docs]))
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
