import random

from cardweave.llm.decontaminate import Index, contaminated, remove_contaminated, template
from tests.llm.docs import clashing, table

ITEM = "A train leaves Boston at 9 and travels 120 km before it meets the other train near Albany. How many km did Boston's train cover before 9 o'clock?"
SCHEMA = "item_id long, text string, doc_id string"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def test_template_kinds():
    code, _ = template("He paid 30 euros to Anna. Then She saw École, 12km and 5 km")
    low, _ = template("he paid 7 dollars to Berta. then Mary saw Paris, 12km and 9 miles")
    assert (code == low).all()
    assert code[2] == 1 and code[3] == 3 and code[5] == 2


def test_reparameterised_questions():
    index = Index([(7, ITEM)])
    again = ITEM.replace("Boston", "Denver").replace("Albany", "Omaha").replace("9", "11").replace("120", "75").replace("km", "miles")
    mixed = again.replace("near Omaha", "near Denver")  # two names have become one
    assert index.matches(ITEM)[0][0] == 7
    assert index.matches("Some words first. " + again.upper().lower().replace("denver", "Denver").replace("omaha", "Omaha").replace("11 o", "11 o") + " And more after.")
    assert index.matches("Words. " + again)
    whole = index.matches(mixed)
    assert all(n < len(template(ITEM)[0]) for *_, n in whole) or not whole
    assert index.matches("Nothing of the kind is asked here at all, and 9 and 120 km are not enough.") == []


def brute(docs, items):
    """Windows compared as tuples, without hashes of windows or an index."""
    out = {}
    ts = [(i, *map(list, template(t))) for i, t in items]
    for key, text in docs:
        code, value = map(list, template(text))
        got = set()
        for i, c, v in ts:
            for shift in {a - b for a in range(len(code) - 7) for b in range(len(c) - 7) if code[a] == c[b] and code[a + 7] == c[b + 7]}:
                ok = [a for a in range(max(0, shift), min(len(code), len(c) + shift) - 7) if code[a : a + 8] == c[a - shift : a - shift + 8] and sum(x > 3 for x in code[a : a + 8]) >= 5]
                k = 0
                while k < len(ok):
                    m = k
                    while m + 1 < len(ok) and ok[m + 1] - ok[m] <= 8:
                        m += 1
                    s, e = ok[k], ok[m] + 8
                    pairs = {(value[x], v[x - shift]) for x in range(s, e) if code[x] <= 3}
                    if e - s >= min(13, len(c)) and len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs}) and code[s:e] == c[s - shift : e - shift]:
                        got.add(i)
                    k = m + 1
        out.setdefault(key, set()).update(got)
    return out


def test_query_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: len(r[1]))[:120]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    rnd = random.Random(1)
    for k in range(25):
        words = rnd.choice(items)[1].split()
        a = rnd.randrange(max(1, len(words) - 20))
        rows.append((10000 + k, "Words before this " + " ".join(words[a : a + rnd.randrange(6, 25)]) + " and after it."))
    df = table(spark, [(i, t, "en", "s", 0) for i, t in rows])
    want = brute(rows, items)
    assert any(want.values())
    for limit in (500_000, 0):
        got = {r["id"]: set(r["items"]) for r in contaminated(df, bench(spark, items), broadcast_windows=limit).collect()}
        assert got == want


def test_both_ways_agree_and_odd_rows(spark):
    df = clashing(spark)
    item = bench(spark, [(1, ITEM), (2, None), (None, "x"), (3, "word " * 30), (3, "word " * 30)])
    one = sorted(map(repr, contaminated(df, item).collect()))
    assert one == sorted(map(repr, contaminated(df, item, broadcast_windows=0).collect()))
    left = remove_contaminated(df, item)
    assert left.columns == df.columns and left.count() == df.count() - 1
    assert contaminated(table(spark, []), item).count() == 0
    assert remove_contaminated(df, bench(spark, [])).count() == df.count()


def both_ways(spark, docs, items):
    df = table(spark, [(i, t, "en", "s", 0) for i, t in docs])
    one, two = (sorted((r["id"], sorted(r["items"]), r["n_matched"]) for r in contaminated(df, bench(spark, items), broadcast_windows=limit).collect()) for limit in (500_000, 0))
    assert one == two
    return {i: found for i, found, _ in one}


def test_short_items_are_found_both_ways(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join(f"q{rnd.randrange(10**6)}z" for _ in range(n))
    items = [(k, words(8 + k % 5)) for k in range(60)]
    docs = [(k, f"{words(40)} {t} {words(40)}") for k, t in items] + [(99, words(90))]
    assert both_ways(spark, docs, items) == {**{k: [k] for k, _ in items}, 99: []}


def test_verbatim_text_of_any_kind(spark):
    """Sums, names, whole short items, a first word that is a name inside a sentence, one slot that does not agree."""
    items = [
        (1, "12 + 7 * 31 - 5 + 88 * 4 - 19 + 23 * 6 + 71 - 3"),
        (2, "List Anna Berta Clara Dora Emma Frieda Greta Hanna Ida Jutta Karla Lena Mona"),
        (3, "Name seven odd primes"),
        (4, "Anna walks along the river until evening"),
        (5, "Boston is where every old train stops for water and coal today"),
        (6, "the first 5 words here are plain and then the other words go on for some while until the 9 is seen at last"),
    ]
    docs = [(k, f"Some of it: they wrote that {t} and no more of it.") for k, t in items]
    docs += [(7, f"They say {items[4][1].replace('Boston', 'Denver')} and more"), (8, items[5][1].replace("9", "5")), (9, "Name seven even primes and walk along the river with 12 + 7 * 30")]
    assert both_ways(spark, docs, items) == {**{k: [k] for k, _ in items}, 7: [5], 8: [6], 9: []}


def test_hot_window_joins_positions(spark):
    """Eight words that all items and texts share, some texts with a whole item, one with all, and one that repeats a word."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bcdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
    some = lambda n: " ".join(word() for _ in range(n))
    common = "what is the value of the whole expression"
    items = [(i, f"{some(7)} {common} {some(7)}") for i in range(150)] + [(900, "word " * 20), (901, "Four odd words here"), (902, None)]
    rows = [(i, f"{some(9)} {common} {some(9)}") for i in range(150)]
    rows += [(200 + i, f"{some(5)}. {items[i][1]} {some(5)}") for i in range(0, 150, 10)]
    rows += [(500, ". ".join(t for _, t in items[:150])), (501, "word " * 60), (502, "So four odd words here stand"), (503, None), (504, items[3][1][: len(items[3][1]) // 2])]
    docs, of = table(spark, [(i, t, "en", "s", 0) for i, t in rows]), bench(spark, items)
    got = [{r["id"]: (sorted(r["items"]), r["n_matched"]) for r in contaminated(docs, of, broadcast_windows=n).collect()} for n in (500_000, 0)]
    assert got[0] == got[1]
    assert got[1][500][0] == list(range(150)) and got[1][501][0] == [900] and got[1][502][0] == [901] and got[1][503] == ([], 0)
    assert all(got[1][200 + i][0] == [i] for i in range(0, 150, 10)) and not any(got[1][i][0] for i in range(150))
