from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import decontaminate

ITEM = "A train leaves the station at Boston with 120 passengers and drives 45 miles before it stops in Albany for 12 minutes, how fast was it?"
DOC, BENCH = "doc_id LONG, text STRING, slots STRING", "item_id LONG, text STRING, tag STRING"


def leaks(spark, docs, items=((7, ITEM),)):
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], DOC).repartition(2)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(rows, bench).collect()}


def test_copies_and_changed_questions(spark, prose):
    other = ITEM.replace("Boston", "Denver").replace("Albany", "Omaha").replace("120", "77").replace("45", "9").replace("12 minutes", "3 hours")
    mixed = ITEM.replace("Boston", "Albany")  # one value for two slots
    docs = [
        (1, f"{prose(30)} {ITEM} {prose(30)}"), (2, f"{prose(30)}\n{other}\n{prose(20)}"), (3, prose(300)), (4, " ".join(ITEM.split()[:9])),
        (5, " ".join(ITEM.split()[3:18]) + " " + prose(40)), (6, mixed), (8, ITEM.replace("drives", "flies")),
    ]
    found = leaks(spark, docs)
    assert (1, 7) in found and found[1, 7].exact and found[1, 7].start_word == 30 and found[1, 7].n_words == len(ITEM.split())
    assert (2, 7) in found and not found[2, 7].exact and found[2, 7].n_changed >= 5
    assert (5, 7) in found and found[5, 7].n_words == 15
    assert not {(3, 7), (4, 7)} & set(found)
    assert (6, 7) not in found or found[6, 7].n_words < len(ITEM.split())
    assert (8, 7) in found and found[8, 7].n_words < len(ITEM.split())


def test_slots_must_agree():
    a = np.array([0, 5, 0, 6, 5], np.uint64)
    assert decontaminate.consistent(a, np.array([0, 8, 0, 9, 8], np.uint64))
    assert not decontaminate.consistent(a, np.array([0, 8, 0, 9, 7], np.uint64))
    assert not decontaminate.consistent(a, np.array([0, 8, 0, 8, 8], np.uint64))


def test_a_contradiction_costs_only_its_own_words(spark, prose):
    passage = f"Again 12 of {prose(20)} and then 12 of {prose(5)}"
    numbers = " ".join(str(n) for n in range(100, 120))
    docs = [(1, ITEM.replace("Boston", "Albany")), (2, passage.replace("then 12", "then 13")), (3, numbers), (4, numbers.replace("109", "108"))]
    found = leaks(spark, docs, [(7, ITEM), (8, passage), (9, numbers)])
    assert set(found) == {(1, 7), (2, 8), (3, 9)}
    # The item without the words up to Boston, as only its name contradicts the other.
    assert found[1, 7].exact and found[1, 7].start_word == 7 and found[1, 7].n_words == len(ITEM.split()) - 7
    assert found[2, 8].n_words == 30 and found[2, 8].n_changed == 1 and found[3, 9].n_words == 20


QUESTION = "Tom has 5 apples. Tom buys 3 more apples. Tom eats 2 of them at home. How many apples does Tom have left now?"
CITY = "A coach takes 3 hours from Paris to the sea and 9 hours from Paris to the hills, how long does it take from Paris to both?"
ACCENT = "Hier sahen wir in Éa und in Ürz viele Leute, die am Abend nach Éa und nach Ürz zu den Bergen gehen wollten."


def test_names_in_any_case_and_place(spark, prose):
    renamed, longer = QUESTION.replace("Tom", "Anna").replace("5", "8"), CITY.replace("Paris", "New York")
    docs = [
        (1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.replace("at Boston", "at\nBoston").replace("in Albany", "in\nAlbany")),
        (4, f"{prose(20)}. {renamed}"), (5, f"{prose(9)} {longer} {prose(9)}"), (6, longer.replace("to the sea", "to the\nsea").replace("from New", "from\nNew")),
        (7, ACCENT.lower()), (8, ACCENT.upper()), (9, ITEM.lower().replace("120", "77").replace("12 minutes", "3 hours")), (10, renamed.replace("Anna eats", "Otto eats")),
    ]
    found = leaks(spark, docs, [(20, ITEM), (21, QUESTION), (22, CITY), (23, ACCENT)])
    assert {1: 20, 2: 20, 3: 20, 4: 21, 5: 22, 6: 22, 7: 23, 8: 23, 9: 20} == {d: i for d, i in found if d < 10}
    for doc_id, item_id in ((1, 20), (2, 20), (3, 20), (7, 23), (8, 23)):
        row = found[doc_id, item_id]
        assert row.exact and row.start_word == 0 and row.n_words == len({20: ITEM, 23: ACCENT}[item_id].split())
    assert found[4, 21].start_word == 20 and found[4, 21].n_words == len(QUESTION.split()) and not found[4, 21].exact
    assert found[5, 22].start_word == 9 and found[5, 22].n_words == len(longer.split()) and found[6, 22].n_words == len(longer.split())
    assert found[9, 20].n_words == len(ITEM.split()) and found[9, 20].n_changed == 3
    assert (10, 21) not in found or found[10, 21].n_words < len(QUESTION.split())


def test_stretches_that_agree():
    random = np.random.default_rng(3)
    for _ in range(300):
        a, b = (random.integers(0, 4, 12).astype(np.uint64) for _ in range(2))
        a[b == 0] = b[a == 0] = 0
        good = {(i, j) for i in range(12) for j in range(i + 1, 13) if decontaminate.consistent(a[i:j], b[i:j])}
        longest = {(i, j) for i, j in good if (i - 1, j) not in good and (i, j + 1) not in good}
        assert set(decontaminate.agreeing(a, b)) == longest
        assert all((a[i:j] == b[i:j]).all() for i, j in decontaminate.verbatim(a, b))


def test_kinds_of_words():
    kinds = {int(v): k for k, v in decontaminate.PLACEHOLDERS.items()}
    text = "We saw Anna pay 3.50 dollars, in 1,200 shops. Then É went 5km to Éa and NASA 3rd"
    hashes, slots, _ = decontaminate.canonical([text.encode()])
    got = [kinds.get(int(h)) for h in hashes]
    assert got == [
        None, None, "name", None, "number", "unit", None, "number", None, None, None, None, "quantity", None, "name", None, None, "quantity",
    ]
    assert [bool(s) for s in slots] == [k is not None for k in got]


def brute_leaks(docs, items):
    """Exact runs of at least 13 words (or the whole item) that an item shares with a document."""
    found = set()
    for item_id, item in items:
        w = [x.lower().strip(".,") for x in item.split()]
        need = min(13, len(w))
        grams = {tuple(w[i : i + need]) for i in range(len(w) - need + 1)}
        for doc_id, text in docs:
            v = [x.lower().strip(".,") for x in (text or "").split()]
            if any(tuple(v[i : i + need]) in grams for i in range(len(v) - need + 1)):
                found.add((doc_id, item_id))
    return found


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    bench = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = brute_leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert want and want <= got and len(got) <= len(want) + 1


def test_odd_rows(spark, prose):
    docs = [(1, None), (2, ""), (3, ITEM), (3, ITEM), (None, ITEM), (4, prose(60_000) + " " + ITEM), (5, ITEM + " " + ITEM)]
    found = leaks(spark, docs, [(7, ITEM), (8, None), (9, ""), (10, "too short"), (7, ITEM)])
    assert {k for k in found if k[0] is not None} == {(3, 7), (4, 7), (5, 7)} and found[4, 7].start_word == 60_000
    assert leaks(spark, [(1, ITEM)], []) == {} and leaks(spark, []) == {}
    rows = spark.createDataFrame([(1, ITEM, "x"), (2, "clean", "y"), (None, "none", "z")], DOC)
    bench = spark.createDataFrame([(7, ITEM, "x")], BENCH)
    kept = decontaminate.without_leaks(rows, bench)
    assert kept.columns == rows.columns and sorted(r.text for r in kept.collect()) == ["clean", "none"]


def test_tables_of_numbers_meet_only_themselves(spark, prose):
    """Windows of placeholders only: rows in proportion to the input, copies found, others not."""
    numbers = [str(prose.random.randrange(10**6)) for _ in range(3000)]
    item = [str(prose.random.randrange(10**6)) for _ in range(200)]
    docs = [(1, " ".join(numbers)), (2, " ".join(numbers[:500] + item[20:80] + numbers[500:900])), (3, prose(30) + " " + " ".join(item))]
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], DOC)
    bench = spark.createDataFrame([(7, " ".join(item), "x")], BENCH)
    windows = [decontaminate._window_rows(rows, "doc_id"), decontaminate._window_rows(bench, "item_id")]
    assert windows[0].join(windows[1], "hash").count() < 5 * 300
    found = {r.doc_id: r for r in decontaminate.find_leaks(rows, bench).collect()}
    assert set(found) == {2, 3} and found[2].n_words == 60 and found[2].start_word == 500 and found[3].n_words == 200
    assert found[2].exact and found[3].exact
