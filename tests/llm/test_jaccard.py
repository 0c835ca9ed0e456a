from __future__ import annotations

import brute
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.components import components

SCHEMA = "doc_id LONG, text STRING, n STRING, sid STRING"


def found(spark, docs):
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA).repartition(4)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows).collect())


def altered(prose, text, n):
    w = text.split()
    for _ in range(n):
        w[prose.random.randrange(len(w))] = prose(1)
    return " ".join(w)


def test_classes_are_those_of_all_pairs(spark, prose):
    """Groups of near copies, a shared passage, short texts, and odd rows, at once."""
    docs = []
    for group in range(6):
        base = prose(prose.random.randrange(60, 200))
        docs += [(1000 * group + i, altered(prose, base, i % 6)) for i in range(25)]
    shared = prose(40)
    docs += [(9000 + i, shared + " " + prose(25)) for i in range(30)]
    docs += [(9500 + i, docs[3][1].upper() if i % 2 else docs[3][1]) for i in range(6)]
    docs += [(10_000 + i, " ".join(prose.random.choice("ab") for _ in range(prose.random.randrange(0, 9)))) for i in range(80)]
    w = [f"x{i}" for i in range(200)]
    docs += [(20_001, " ".join(w[:104])), (20_002, " ".join(w[:84])), (20_003, "y " + " ".join(w[20:103]))]  # 100, 80 and 80, 79 of them shared
    text = prose(50)
    docs += [(5, None), (6, ""), (7, " \n"), (8, text), (8, text), (3, text), (9, "one"), (10, "ONE"), (11, prose(30_000)), (-4, text + " more")]
    got = found(spark, docs)
    assert got == sorted(brute.classes(docs))
    assert (20_002, 80, 20_001) in got and (20_003, 80, 20_003) in got


def test_null_ids_and_empty_tables(spark, prose):
    text = prose(20)
    rows = spark.createDataFrame([(None, text, "", ""), (4, text, "", ""), (None, None, "", "")], SCHEMA)
    got = jaccard.near_duplicates(rows).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (4, 4)]
    assert found(spark, []) == []


def test_one_of_each(spark, prose):
    text = prose(40)
    rows = [(2, text, "a", "x"), (1, text, "b", "x"), (1, text, "b", "x"), (3, prose(30), "c", "x"), (4, None, "d", "x"), (None, text, "e", "x")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "sid"]
    assert sorted((r.doc_id or 0, r.n) for r in kept.collect()) == [(0, "e"), (1, "b"), (3, "c"), (4, "d")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (100, 100), (300, 250), (250, 260), (7, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100, 200]}, 250: 250, 260: 250, 300: 250}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []


def test_bitmaps_of_large_sets_rule_out_other_sets(spark):
    """One of fixed size is full for large sets and lets every pair through."""
    random = np.random.default_rng(3)
    mine, other = (np.sort(random.integers(0, 1 << 63, n, np.uint64)) for n in (4000, 4200))
    near = np.sort(np.r_[mine[:3900], other[:300]])
    rows = [(len(s), jaccard._bitmap(s), jaccard._wide(s)) for s in (mine, other, near)]
    sets = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id INT, n LONG, bits ARRAY<LONG>, wide ARRAY<LONG>")
    a, b = sets.toDF(*[f"{c}_a" for c in sets.columns]), sets.toDF(*[f"{c}_b" for c in sets.columns])
    sides = [F.col(f"{c}_{end}") for c in ("n", "bits", "wide") for end in "ab"]
    may = {(r.id_a, r.id_b): r.may for r in a.crossJoin(b).select("id_a", "id_b", jaccard._may_link(*sides, 80).alias("may")).collect()}
    assert may[0, 2] and may[2, 0] and may[0, 0]
    assert not may[0, 1] and not may[1, 2]
    assert len(rows[0][2]) == len(rows[2][2]) // 2 or len(rows[0][2]) == len(rows[2][2])


def test_a_large_group_of_near_copies_leaves_few_pairs(spark):
    """Neighbours by bitmap, a few for every set, leave few classes of which all pairs are compared."""
    random = np.random.default_rng(3)
    family = [[f"w{i}" for i in range(150)]]
    while len(family) < 400:  # copies of copies, so that few of all pairs link
        child = list(family[random.integers(max(0, len(family) - 40), len(family))])
        for at in random.integers(0, 150, 2):
            child[at] = f"x{random.integers(1 << 30)}"
        family.append(child)
    sets = jaccard._sets([" ".join(words).encode() for words in family])
    rows = [(i, len(s), jaccard._bitmap(s)) for i, s in enumerate(sets)]
    stored = spark.createDataFrame(rows, "sid long, n long, bits array<long>").repartition(1).cache()
    placed = stored.select("sid", F.col("sid").alias("root"))
    pairs = {tuple(sorted((r.x, r.y))) for r in jaccard._neighbours(placed, stored, 80, 1).collect()}
    assert len(pairs) <= jaccard.BITMAP * jaccard.NEIGHBOURS * len(family)
    link = lambda a, b: 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))
    least = list(range(len(family)))
    for a, b in sorted(pairs):
        if least[a] != least[b] and link(a, b):
            low, high = sorted((least[a], least[b]))
            least = [low if x == high else x for x in least]
    left = [(a, b) for b in range(len(family)) for a in range(b) if least[a] != least[b] and link(a, b)]
    linking = sum(link(a, b) for b in range(len(family)) for a in range(b))
    assert linking > 500 and len(left) < 10
    joined = placed.withColumn("root", F.lit(0).cast("long"))
    assert jaccard._neighbours(joined, stored, 80, 1).isEmpty()
