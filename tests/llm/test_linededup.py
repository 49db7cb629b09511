import random
import re

from cardweave.llm import linededup
from cardweave.llm.linededup import LONG_UNIT, MIN_WORDS, dedup_lines
from tests.llm.docs import clashing, table

#: Shapes of repeats to look for.
WINDOW, LEAST_WORDS = 4, 5
CUT = re.compile(r"(?<=\n)|(?<=[.!?]\x20)")


def brute(rows):
    """By (id, text): units, their keys, and their words."""
    texts = {(i, t or "") for i, t in rows}
    units = {k: CUT.split(k[1]) for k in texts}
    keys = {k: [u.rstrip(" \t\n\x0b\x0c\r") for u in us] for k, us in units.items()}
    words = {k: [len(u.encode().split()) for u in us] for k, us in units.items()}
    return texts, units, keys, words


def leftover_runs(rows, texts_after):
    """Runs of WINDOW units, or long units, of the inputs that occur more than once after the dedup."""
    seen, again = {}, []
    for i, t in texts_after:
        us = [u.rstrip(" \t\n\x0b\x0c\r") for u in CUT.split(t or "")]
        for k in range(len(us) - WINDOW + 1):
            run = tuple(us[k : k + WINDOW])
            n = [len(u.encode().split()) for u in run]
            if sum(n) >= MIN_WORDS and max(n) >= LEAST_WORDS:
                if run in seen:
                    again.append((i, run))
                seen[run] = i
        for u in us:
            if len(u.encode().split()) >= LONG_UNIT:
                if u in seen:
                    again.append((i, u))
                seen[u] = i
    return again


def check_deletions(rows, got):
    """Every deleted unit lies in a run of enough words that also stands in an earlier place of the input."""
    texts, units, keys, words = brute(rows)
    pairs = {}
    for k in texts:
        for a, b in zip(keys[k], keys[k][1:]):
            pairs.setdefault((a, b), set()).add(k)
    for i, before, after in got:
        k = (i, before or "")
        if (after or "") == (before or ""):
            continue
        us, at, deleted = units[k], 0, []
        rest = after
        for n, u in enumerate(us):  # greedy alignment: units are kept or deleted whole
            if rest.startswith(u) and u:
                rest = rest[len(u):]
            else:
                deleted.append(n)
        assert rest == ""
        assert sum(words[k][n] for n in deleted) >= MIN_WORDS or not deleted
        for n in deleted:
            if words[k][n] >= LONG_UNIT:
                continue
            near = [p for p in ((keys[k][n - 1], keys[k][n]) if n else None, (keys[k][n], keys[k][n + 1]) if n + 1 < len(us) else None) if p]
            assert any(pairs[p] - {k} or sum(1 for x in zip(keys[k], keys[k][1:]) if x == p) > 1 for p in near), (k, n)


def run(spark, df):
    cols = df.withColumn("before", df["text"])
    return [(r.doc_id, r.before, r.text) for r in dedup_lines(cols).collect()]


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = run(spark, docs)
    assert sorted(r[0] for r in got) == sorted(r[0] for r in rows)
    check_deletions(rows, got)
    assert leftover_runs(rows, {(i, t) for i, _, t in got}) == []


def sentence(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) + "."


def test_planted_passages(spark):
    rnd = random.Random(4)
    passage = " ".join(sentence(rnd, 9) for _ in range(7))
    long_one = sentence(rnd, 70)
    rows, clean = [], {}
    for i in range(120):
        own = [sentence(rnd, rnd.randrange(3, 15)) for _ in range(rnd.randrange(4, 12))]
        clean[i] = list(own)
        if i % 3 == 0:
            own.insert(2, passage)
        if i % 7 == 0:
            own.insert(1, "\n" + long_one)
        own.insert(0, "A short common line.\n")
        rows.append((i, " ".join(own), "en", "s", 0))
    got = {i: t for i, _, t in run(spark, table(spark, rows))}
    assert passage in got[0] and long_one in got[0]
    inner = passage.split(". ")[3]
    for i in range(1, 120):
        assert all(s in got[i] for s in clean[i])
        assert got[i].startswith("A short common line.\n")
        if i % 3 == 0:
            assert inner not in got[i]
        if i % 7 == 0:
            assert long_one not in got[i]


def test_within_one_document(spark):
    rnd = random.Random(5)
    block = " ".join(sentence(rnd, 10) for _ in range(6)) + "\n"
    got = run(spark, table(spark, [(1, block + "Between these two.\n" + block, "en", "s", 0)]))
    assert got[0][2] == block + "Between these two.\n"


def test_odd_rows(spark):
    rows = table(spark).collect()
    got = run(spark, clashing(spark))
    assert sorted(map(repr, ((r.doc_id, r.text, r.text) for r in rows))) == sorted(map(repr, got))
    assert dedup_lines(table(spark, [])).count() == 0
    lengths = [(1, "Some words that are one line here.\n" * 50, "en", "s", 0), (2, None, "en", "s", 0)]
    assert len(run(spark, table(spark, lengths))) == 2


def kept_by_brute_force(rows, min_words=MIN_WORDS, long_unit=LONG_UNIT):
    """Units left when all that lie in a run that counts and stands at an earlier place too are deleted."""
    docs = sorted({(i, t or "") for i, t in rows})
    cut = {d: CUT.split(d[1]) for d in docs}
    seen, gone = set(), {d: set() for d in docs}
    for d in docs:
        us = [u.rstrip(" \t\n\x0b\x0c\r") for u in cut[d]]
        n = [len(u.split()) for u in us]
        for a in range(len(us)):
            for z in range(a, len(us)):
                if (sum(n[a : z + 1]) >= min_words and z > a) or (z == a and n[a] >= long_unit):
                    if tuple(us[a : z + 1]) in seen:
                        gone[d].update(range(a, z + 1))
                    seen.add(tuple(us[a : z + 1]))
    return sorted((i, "".join(u for k, u in enumerate(cut[i, t]) if k not in gone[i, t])) for i, t in docs)


def test_all_repeats_like_brute_force(spark):
    """Passages of two or three units, of short and blank lines, and runs that their first document ends early."""
    rnd = random.Random(8)
    verse = "".join(sentence(rnd, rnd.randrange(1, 5)) + "\n" * rnd.randrange(1, 3) for _ in range(20))
    two, three = (" ".join(sentence(rnd, n) for n in ns) + " " for ns in ((22, 30), (20, 24, 26)))
    common, more = sentence(rnd, 9) + " " + sentence(rnd, 11) + " ", sentence(rnd, 30) + " " + sentence(rnd, 4) + " "
    alone = sentence(rnd, 40) + "\n"
    rows = []
    for i in range(60):
        own = [sentence(rnd, rnd.randrange(1, 30)) + rnd.choice([" ", "\n", "\n\n", "\n \n\n"]) for _ in range(rnd.randrange(2, 7))]
        shared = [common] if i == 0 else rnd.sample([verse, two, three, common + more, common, alone, "\n" * 3, verse[: len(verse) // 2]], 2)
        for p in shared:
            own.insert(rnd.randrange(len(own) + 1), p)
        rows.append((i, "".join(own)))
    rows += [(60, "x\n" * 70), (61, rows[5][1]), (62, "\n" * 40), (63, "\n" * 40 + rows[6][1])]
    want = kept_by_brute_force(rows)
    got = sorted((i, t) for i, _, t in run(spark, table(spark, [(i, t, "en", "s", 0) for i, t in rows])))
    assert got == want
    assert sum(t != dict(rows)[i] for i, t in want) > 30


def test_odd_white_space_like_brute_force(spark):
    """Tabs, carriage returns, double and leading spaces, and the mark's own character, in texts and repeats."""
    rnd = random.Random(10)
    passages = ["".join(sentence(rnd, 14).replace(" ", rnd.choice(gaps)) + end for _ in range(3)) for gaps in ([" "], [" ", "  "], ["\t", " "], [" ", "\x00"]) for end in (" ", "\n", "\r\n", " \n", "\n ")]
    rows = []
    for i in range(50):
        own = [sentence(rnd, rnd.randrange(1, 20)) + rnd.choice([" ", "\n", "\t\n", "\n  "]) for _ in range(4)]
        own.insert(2, rnd.choice(passages))
        rows.append((i, "".join(own)))
    got = sorted((i, t) for i, _, t in run(spark, table(spark, [(i, t, "en", "s", 0) for i, t in rows])))
    assert got == kept_by_brute_force(rows)


def test_hot_hashes_and_shuffled_results_alike(spark, monkeypatch):
    rnd = random.Random(12)
    verse, long_one = "".join(sentence(rnd, 6) + "\n" for _ in range(9)), sentence(rnd, 60) + "\n"
    rows = [(i, sentence(rnd, 9) + "\n" + rnd.choice([verse, long_one, verse + long_one, long_one * 2]) + sentence(rnd, 7)) for i in range(60)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (70, None), *rows[:3]]
    want = sorted((i, t or "") for i, _, t in run(spark, table(spark, [(i, t, "en", "s", 0) for i, t in rows if i is not None])))
    assert sorted(set(want)) == sorted(set(kept_by_brute_force([r for r in rows if r[0] is not None])))
    monkeypatch.setattr(linededup, "SHARE", 1)
    monkeypatch.setattr(linededup, "PARTS", 3)
    monkeypatch.setattr(linededup, "HOT", 2)
    monkeypatch.setattr(linededup, "BROADCAST_RUNS", 0)
    assert sorted((i, t or "") for i, _, t in run(spark, table(spark, [(i, t, "en", "s", 0) for i, t in rows if i is not None]))) == want


def test_first_holder_of_a_pair_has_no_more(spark):
    """The first document holds only a pair under MIN_WORDS, two later ones a longer repeat that begins with it."""
    rnd = random.Random(9)
    rows, want = [], {}
    for k in range(30):
        pair = sentence(rnd, 10) + " " + sentence(rnd, 10) + " "
        rest = sentence(rnd, 3) + " " + sentence(rnd, 4) + " "
        for i in range(3):
            before, after = sentence(rnd, 8) + " ", sentence(rnd, 8)
            rows.append((3 * k + i, before + pair + (rest if i else "") + after, "en", "s", 0))
            want[3 * k + i] = before + after if i == 2 else rows[-1][1]
    assert {i: t for i, _, t in run(spark, table(spark, rows))} == want


def test_other_limits_like_brute_force(spark):
    """Windows of many units, and of one: the shortest rows that reach a few words, or very many."""
    rnd = random.Random(21)
    verse = ["".join(sentence(rnd, rnd.randrange(1, 6)) + rnd.choice(["\n", " ", "\n\n"]) for _ in range(n)) for n in (4, 30, 60)]
    rows = []
    for i in range(40):
        own = [sentence(rnd, rnd.randrange(1, 20)) + rnd.choice([" ", "\n"]) for _ in range(4)]
        own.insert(rnd.randrange(4), rnd.choice(verse))
        rows.append((i, "".join(own)))
    for min_words, long_unit in ((5, 8), (70, 90), (25, 20)):
        got = dedup_lines(table(spark, [(i, t, "en", "s", 0) for i, t in rows]), min_words=min_words, long_unit=long_unit).collect()
        assert sorted((r.doc_id, r.text) for r in got) == kept_by_brute_force(rows, min_words, long_unit)


def test_windows_select_few_and_the_same(spark):
    """Any shared row of enough words has the fingerprints of its windows in both texts; fewer are selected than there are units."""
    rnd = random.Random(22)
    passage = " ".join(sentence(rnd, rnd.randrange(4, 12)) for _ in range(12)) + " "
    texts = [" ".join(sentence(rnd, rnd.randrange(4, 12)) for _ in range(20)) + " " + passage + sentence(rnd, 9) for _ in range(6)]
    src = spark.createDataFrame(list(enumerate([*texts, passage])), "id long, _text string")
    found = {}
    for r in linededup._fingerprints(src, MIN_WORDS, True).collect():
        found.setdefault(r.id, []).append(r.f)
    assert all(set(found[6]) <= set(found[i]) for i in range(6))
    assert all(len(set(found[i])) == len(found[i]) < 0.75 * len(CUT.split(t)) for i, t in enumerate(texts))
