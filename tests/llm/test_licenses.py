from __future__ import annotations

from tidemark.llm import licenses

SCHEMA = "doc_id LONG, text STRING, license STRING"
DASH = str.maketrans("", "", licenses.MARKS.decode())


def bare(text):
    return [x.lower().translate(DASH) for x in text.split()]


def grams(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def scan(spark, docs):
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA).repartition(2)
    return sorted((r.doc_id, r.license, r.start_word, r.n_words, round(r.containment, 6)) for r in licenses.scan_licenses(rows).collect() if r.doc_id is not None)


def test_every_template_is_found_where_it_stands(spark, prose):
    for at, before in enumerate((0, 1, 7, 33)):
        docs = [(i, f"{prose(before)} {text} {prose(40)}") for i, text in enumerate(licenses.TEMPLATES.values())]
        got = {(d, name): (start, n) for d, name, start, n, share in scan(spark, docs) if share == 1}
        for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
            start, n = got[i, name]
            assert start <= before + 1 and start + n >= before + len(text.split()), (at, name)


def test_altered_licenses(spark, prose):
    name, text = "GPL-3.0-or-later", licenses.TEMPLATES["GPL-3.0-or-later"]
    w = text.split()
    near = [*w[:10], "changed", *w[11:]]
    far = [x if i % 6 else "changed" for i, x in enumerate(w)]
    docs = [(1, " ".join(w).upper()), (2, " ".join(near)), (3, " ".join(far)), (4, prose(20) + "\n" + "\n".join(w)), (5, "> " + text.replace(" ", "  "))]
    got = {d: share for d, n, _, _, share in scan(spark, docs) if n == name}
    share = len(grams(bare(" ".join(near))) & grams(bare(text))) / len(grams(bare(text)))
    assert got == {1: 1.0, 2: round(share, 6), 4: 1.0, 5: 1.0}


def test_brute_force(spark, prose):
    notices = [t for t in licenses.TEMPLATES.values() if len(t.split()) < 13]
    docs = []
    for i in range(60):
        parts = [prose(prose.random.randrange(0, 12)), prose.random.choice(notices), prose(5)]
        prose.random.shuffle(parts)
        docs.append((i, "\n".join(parts)))
    got = {(d, n) for d, n, *_ in scan(spark, docs)}
    for doc_id, text in docs:
        w = bare(text)
        for name, template in licenses.TEMPLATES.items():
            own = grams(bare(template))
            best = max((len(grams(w[i : i + len(template.split()) + 4]) & own) for i in range(len(w))), default=0)
            assert ((doc_id, name) in got) == (best >= 0.8 * len(own)), (text, name)


def test_no_match_across_documents_and_odd_rows(spark, prose):
    docs = [(1, "Released under"), (2, "the MIT License."), (3, None), (4, ""), (5, "MIT"), (6, prose(40_000) + " Released under the MIT License. " + prose(9))]
    docs += [(7, "Released under the MIT License. x Released under the MIT License."), (7, "Released under the MIT License."), (None, "Released under the MIT License.")]
    got = scan(spark, docs)
    assert [g[:3] for g in got] == [(6, "MIT-notice", 40_000), (7, "MIT-notice", 0), (7, "MIT-notice", 0), (7, "MIT-notice", 6)]
    assert scan(spark, []) == []


def test_bands():
    assert 0.4 ** licenses.bands_for(0.6, 1e-6) <= 1e-6
    for s in range(1, 200):
        w = licenses.window_width(s)
        assert w + w // 2 - (w > 1) <= s


def test_adjacent_copies_and_relatives(spark, prose):
    """Copies that touch, altered ones among them, and notices whose wording differs in a few words only."""
    mit = licenses.TEMPLATES["MIT"]
    n = len(mit.split())
    altered = mit.replace("modify", "mend")
    docs = [(1, f"{mit} {mit}"), (2, f"{mit}\n{altered}\n{mit}"), (3, f"{prose(4)} {altered} {mit} {prose(3)} {mit}")]
    got = scan(spark, docs)
    assert [(d, name, start, words) for d, name, start, words, _ in got] == [
        (1, "MIT", 0, n), (1, "MIT", n, n), (2, "MIT", 0, n), (2, "MIT", n, n), (2, "MIT", 2 * n, n),
        (3, "MIT", 4, n), (3, "MIT", 4 + n, n), (3, "MIT", 7 + 2 * n, n),
    ]
    assert len(licenses.TEMPLATES) >= 30
    names = list(licenses.TEMPLATES)
    alone = scan(spark, [(i, f"{prose(9)}\n{licenses.TEMPLATES[name]}\n{prose(9)}") for i, name in enumerate(names)])
    assert [(d, name, share) for d, name, _, _, share in alone] == [(i, name, 1.0) for i, name in enumerate(names)]
    pairs = [(i, licenses.TEMPLATES[name] + "\n" + licenses.TEMPLATES[names[i - 1]]) for i, name in enumerate(names)]
    both = scan(spark, pairs)
    for i, name in enumerate(names):
        assert {name, names[i - 1]} <= {x for d, x, *_ in both if d == i}, name
