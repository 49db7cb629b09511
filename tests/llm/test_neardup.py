import random

from cardweave.llm import neardup
from cardweave.llm.components import components
from cardweave.llm.neardup import near_duplicates, near_duplicates_digest
from tests.llm.docs import clashing, table


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    rows = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in rows}


def test_query_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = near_duplicates_digest(docs).collect()
    assert len(got) == docs.count()
    assert {tuple(r) for r in got} == brute([(r.doc_id, r.text) for r in docs.collect()], 2, 80)


def test_near_copies_and_chains(spark):
    rnd = random.Random(3)
    rows, words = [], [f"w{x}" for x in range(4000)]
    for g in range(12):
        base = rnd.choices(words, k=rnd.choice([12, 60, 200]))
        for c in range(14):
            text = list(base)
            for _ in range(rnd.randrange(0, max(2, len(text) // 12))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((g * 100 + c, " ".join(text), "en", "s", 0))
    rnd.shuffle(rows)
    for k in (2, 5):
        got = {tuple(r) for r in near_duplicates(table(spark, rows), k).collect()}
        assert got == brute([r[:2] for r in rows], k, 80)


def test_families_below_and_above_the_threshold(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{x}" for x in range(900)]
    base, rows = rnd.choices(words, k=90), []
    for c in range(160):  # from near copies to texts that are only somewhat alike
        text = list(base)
        for _ in range(rnd.randrange(2, 22)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((c, " ".join(text), "en", "s", 0))
    want = brute([r[:2] for r in rows], 2, 80)
    assert 3 < len({x[2] for x in want}) < 150
    assert {tuple(r) for r in near_duplicates(table(spark, rows), 2).collect()} == want
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(neardup, "AT_ONCE", 2)
    assert {tuple(r) for r in near_duplicates(table(spark, rows), 2).collect()} == want


def test_recall_of_links(spark):
    """Links found against all links of brute force, between different texts: at least 0.9, and here all."""
    rnd = random.Random(4)
    words = [f"w{x}" for x in range(3000)]
    rows = []
    for g in range(150):
        base = rnd.choices(words, k=80)
        near = list(base)
        for _ in range(rnd.randrange(1, 5)):
            near[rnd.randrange(80)] = rnd.choice(words)
        rows += [(2 * g, " ".join(base), "en", "s", 0), (2 * g + 1, " ".join(near), "en", "s", 0)]
    want = {x[0]: x[2] for x in brute([r[:2] for r in rows], 2, 80)}
    got = {r["id"]: r.component_id for r in near_duplicates(table(spark, rows), 2).collect()}
    linked = [i for i, c in want.items() if c != i]
    assert len(linked) > 100
    assert sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked) and got == want


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in table(spark).collect()]
    got = near_duplicates(clashing(spark), 2).collect()
    assert {tuple(r) for r in got} == brute(rows, 2, 80)
    assert len(got) == len(rows)
    assert near_duplicates(table(spark, []), 2).count() == 0
    # Rows of one id with different texts, and many equal rows.
    shared = [(1, "a b c d e f g h", "en", "s", 0), (1, "p q r s t u v w", "en", "s", 0), (2, "p q r s t u v w", "en", "s", 0), (3, "a b c d e f g h i", "en", "s", 0)] + [(4, "a b c d e f g h i", "en", "s", 0)] * 40
    assert {tuple(r) for r in near_duplicates(table(spark, shared), 2).collect()} == {(1, 7, 1, True), (2, 7, 1, False), (3, 8, 1, False), (4, 8, 1, False)}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 80)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert got == {(x, find(x)) for x in root}
