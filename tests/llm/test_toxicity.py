import itertools
import random
import zlib

from cardweave.llm.toxicity import Automaton, Lexicon, edits_allowed, features, learn_lexicon, score_texts, toxicity, train_model
from tests.llm.docs import clashing, table


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(6)
    terms = [("idiot", False), ("moron", False), ("trash", False), ("worthless", False), ("abominable", False), ("disgusting", False), ("clown", False), ("é" * 6, False), ("abcabcabc", False), ("detest", True), ("horrid", True), ("scum", True)]
    machine = Automaton(Lexicon([(t, stem, 2.0, 0.001) for t, stem in terms]))
    words = {t for t, _ in terms} | {t + "able" for t, stem in terms if stem}
    for t in sorted(words):
        for _ in range(120):
            w = list(t)
            for _ in range(rnd.randrange(0, 4)):
                i = rnd.randrange(len(w) + 1)
                kind = rnd.randrange(3)
                if kind == 0:
                    w.insert(i, rnd.choice("abcdeiot"))
                elif w and i < len(w):
                    if kind == 1:
                        del w[i]
                    else:
                        w[i] = rnd.choice("abcdeiot")
            words.add("".join(w))

    def apart(w, t, stem):
        return min(edits(w[:n], t) for n in range(len(w) + 1)) if stem else edits(w, t)

    for w in words:
        fits = [(d, k) for k, (t, stem) in enumerate(terms) if edits_allowed(t, stem) and (d := apart(w, t, stem)) <= edits_allowed(t, stem)]
        got = machine.fuzzy(w) if w else None
        assert got == (min(fits)[1] if fits and w else None), w
        if got is not None:
            assert machine.match(w) is not None, w
    assert [edits_allowed(t, stem) for t, stem in terms] == [1, 1, 1, 2, 2, 2, 1, 1, 2, 1, 1, 0]


def test_misspelled_terms_are_caught(spark):
    """Words of documents that match, each matched word misspelled by one edit: matches stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train_model(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    machine, rnd = Automaton(model.lexicon), random.Random(3)
    known = [w for w in sorted({w for r in docs.limit(400).collect() for w in (r.text or "").lower().split()}) if w.isalpha() and len(w) >= 5]
    hits = [w for w in known if (hit := machine.match(w)) and not hit[1] and edits_allowed(*model.lexicon.terms[hit[0]][:2])]
    wrong = []
    for w in hits:
        i = rnd.randrange(len(model.lexicon.terms[machine.match(w)[0]][0]))
        wrong.append(w[:i] + "#" + w[i + 1 :])
    assert len(wrong) >= 8 and all(machine.match(w) is not None for w in wrong)


def test_words_of_copies_are_no_terms(spark):
    """A word of very many copies of one toxic text, each with some words changed, is no evidence; one in independent texts is."""
    rnd = random.Random(9)
    some = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    base, rows = some(40) + ["quorvane"] + some(40), []
    for _ in range(400):
        copy = [w if rnd.random() < 0.96 or w == "quorvane" else rnd.choice(some(1)) for w in base]
        rows.append((" ".join(copy), 1))
    rows += [(" ".join([*some(30), "blightful", *some(30)]), 1) for _ in range(30)]
    rows += [(" ".join(some(80)), 0) for _ in range(800)]
    terms = {t for t, *_ in learn_lexicon(spark.createDataFrame(rows, "text string, label int")).terms}
    assert "blightful" in terms and not any(t.startswith("quor") for t in terms)


def test_words_of_any_length():
    long_word = "pneumono" * 30
    machine = Automaton(Lexicon([(long_word, False, 2.0, 0.001), ("detestab", True, 2.0, 0.001)]))
    assert machine.match(long_word[:100] + "#" + long_word[101:]) == (0, True)
    assert machine.match("det#stab" + "z" * 500_000) == (1, True)
    assert machine.match("x" * 500_000) is None and machine.match(long_word + "abc") is None


def test_context_separates_quotation():
    terms = [("idiot", False, 3.0, 0.0001)]
    machine = Automaton(Lexicon(terms))
    see = lambda t: features(t, machine, terms, {})
    plain, quoted, said = see("you are an idiot and that is that"), see('the word "idiot" is old and long'), see("he said the term idiot is old")
    assert plain[0] > quoted[0] and plain[0] > said[0]
    assert plain[6] > 0 and quoted[5] > 0 and said[5] > 0
    assert see("an idi0t here")[4] > 0


def auc(pairs):
    ones = [s for s, y in pairs if y == 1]
    zeros = [s for s, y in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(ones, zeros)) / (len(ones) * len(zeros))


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["id"]: r for r in toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    pairs = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(pairs) > 0.85


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (None, 0, 1), (2, 0, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(clashing(spark), labels).collect()
    assert len(got) == clashing(spark).count()
    assert all(0 <= r.score <= 1 for r in got)
    none = toxicity(table(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity(table(spark, []), labels).count() == 0


def test_very_long_texts_on_a_fitted_model(spark):
    sf = "/root/testdata/sf0.01"
    model = train_model(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    assert model.weights.any()
    rows = [(1, "idiot " * 200_000, "en", "s", 0), (2, "a quiet word " * 200_000, "en", "s", 0), (3, "x" * 2_000_000, "en", "s", 0), (4, None, "en", "s", 0)]
    got = {r["id"]: r.score for r in score_texts(table(spark, rows), model).collect()}
    assert len(got) == 4 and all(0 <= s <= 1 for s in got.values()) and got[1] > max(got[2], got[3], got[4])
