"""Operators of large pages, dictionaries and plans as tables, likeness in the JVM, recursive hops: against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cardweave.functions.text import canonical, canonical_of
from cardweave.functions.similarity import lcs_length, lcs_ratio
from cardweave.operators import lookups, pages, rows, tokens

TOKEN = "card_id long, tok_idx int, pass_name string, text string, score double, box array<array<double>>"


def _box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def _page(seed, n, words=("the", "of", "q"), card=1, spread=400.0):
    """Tokens of few texts all over a page, many of them twice or more in nearly one place and of other sizes."""
    rnd, out = random.Random(seed), []
    while len(out) < n:
        w, x, y = rnd.choice(words), rnd.uniform(-spread, spread), rnd.choice([rnd.uniform(0, spread), 20.0 * rnd.randrange(20)])
        wide, high = rnd.choice([4.0, 9.5, 30.0, 31.0]), rnd.choice([0.2, 8.0, 20.0])
        for _ in range(rnd.choice([1, 1, 2, 3])):
            out.append((card, len(out), "n", w, round(rnd.random(), 3), _box(x + rnd.uniform(-1, 1), y + rnd.uniform(-1, 1), wide * rnd.uniform(0.8, 1.3), high * rnd.uniform(0.8, 1.3))))
    return out[:n]


def test_grid_pairs_and_islands_equal_all_pairs(spark):
    df = spark.createDataFrame(_page(1, 900) + _page(2, 300, card=2, spread=40.0), TOKEN)
    key = lambda d: sorted((r.card_id, r.a, r.b, r.iou) for r in d.collect())
    want = key(tokens.overlap_pairs(df))
    assert len(want) > 300 and key(pages.overlaps(df)) == want
    kept = lambda d: sorted(map(repr, d.select("card_id", "tok_idx", "text", "score").collect()))
    want = kept(tokens.dedupe(df))
    assert len(want) < 1150 and kept(pages.dedupe_pages(df)) == want


def test_a_page_of_fifty_thousand_tokens(spark):
    """All of one text, in pairs on a lattice: all pairs would be 1.2 thousand million."""
    n = 50_000
    cell = F.floor(F.col("id") / 2)
    x, y = (cell % 250) * 40.0 + F.col("id") % 2, F.floor(cell / 250) * 30.0
    df = spark.range(n).select(F.lit(1).cast("long").alias("card_id"), F.col("id").cast("int").alias("tok_idx"), F.lit("n").alias("pass_name"), F.lit("the").alias("text"), (0.5 + (F.col("id") % 2) * 0.1).alias("score"), F.array(F.array(x, y), F.array(x + 30, y), F.array(x + 30, y + 20), F.array(x, y + 20)).alias("box"))
    assert pages.overlaps(df).agg(F.count("*"), F.sum((F.col("b") == F.col("a") + 1).cast("int"))).first() == (n // 2, n // 2)
    assert pages.dedupe_pages(df).agg(F.count("*"), F.sum(F.col("tok_idx") % 2)).first() == (n // 2, n // 2)
    with pytest.raises(Exception, match="use the operators of pages"):
        tokens.dedupe(df).count()
    column = df.select("card_id", F.col("tok_idx").alias("row_id"), (F.col("tok_idx") % 500 * 100.0).alias("x1"), (F.col("tok_idx") % 500 * 100.0 + 60).alias("x2"), F.floor(F.col("tok_idx") / 500).cast("double").alias("y_center"))
    assert pages.reading_edges(column).count() == 500 * 100 * 99 // 2


def test_strips_equal_all_pairs(spark):
    rnd = random.Random(8)
    data = [(c, i, x, x + rnd.choice([0.0, 5.0, 60.0, 300.0]), rnd.choice([0.0, 10.0, 20.0, rnd.uniform(0, 50)])) for c in range(4) for i in range(120) for x in [rnd.uniform(-200, 200)]]
    df = spark.createDataFrame(data, "card_id long, row_id int, x1 double, x2 double, y_center double")
    key = lambda d: sorted((r.card_id, r.src, r.dst) for r in d.collect())
    want = key(rows.reading_order(df))
    assert len(want) > 500 and key(pages.reading_edges(df)) == want


def test_hints_equal_nested_loops(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(1, 7)))
    texts = [(i, " ".join(rnd.choice([word(), word().upper()]) for _ in range(rnd.randrange(0, 12)))) for i in range(300)] + [(900, None), (901, "")]
    hints = sorted({rnd.choice([word(), f"{word()} {word()}"]) for _ in range(10_000)}) + [""]
    lines = spark.createDataFrame(texts, "id int, text string")
    got = {(r.id, r.hint) for r in lookups.match_hints(lines, spark.createDataFrame([(h,) for h in hints] + [(hints[0].upper(),)], "hint string")).collect()}
    want = {(i, h) for i, t in texts if t for h in hints if h and h in t.lower()}
    assert len(want) > 5000 and got == want
    assert lookups.match_hints(lines, spark.createDataFrame([], "hint string")).count() == 0


def test_longest_plan_and_ranked_patterns(spark):
    plans = [(str(c), f"r{c}", 4, 9) for c in range(1, 1500)] + [("12", "aa", 4, 9), ("7", "r0", 1, 20)]
    rnd = random.Random(2)
    numbers = [("+" if rnd.random() < 0.9 else "") + "".join(rnd.choices("0123456789", k=rnd.randrange(1, 14))) for _ in range(500)] + ["+", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "id int, phone string")
    want = {}
    for i, n in enumerate(numbers):
        fits = [(-len(c), r, c) for c, r, low, high in plans if n and n.startswith(f"+{c}") and low <= len(n) - 1 - len(c) <= high]
        want[i] = (min(fits)[1], f"+{min(fits)[2]} {n[1 + len(min(fits)[2]):]}") if fits else (None, None)
    table = spark.createDataFrame(plans, "code string, region string, low int, high int")
    assert {r.id: (r.region, r.number) for r in lookups.longest_plan(df, table).collect()} == want
    assert all(r.region is None for r in lookups.longest_plan(df, table.limit(0)).collect())
    patterns = spark.createDataFrame([(2, "b", r"\d{4}"), (1, "z", r"\d{6}"), (1, "c", r"\d{5,6}")], "rank int, region string, pattern string")
    lines = spark.createDataFrame([("at 123456",), ("1234 x",), ("12",), (None,)], "text string")
    assert [(r.region, r.match) for r in lookups.ranked_region(lines, patterns).collect()] == [("c", "123456"), ("b", "1234"), (None, None), (None, None)]
    with pytest.raises(ValueError, match="more than"):
        lookups.ranked_region(lines, spark.range(2000).selectExpr("cast(id as int) rank", "'r' region", "'x' pattern"))


def test_common_subsequence_in_the_jvm(spark):
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("abé1 ", k=rnd.choice([0, 1, 5, 59, 60, 61, 120, 150]))), "".join(rnd.choices("abé1x", k=rnd.choice([0, 1, 6, 60, 130])))) for _ in range(120)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lcs_length(F.col("a"), F.col("b")).alias("n"), lcs_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r.n == brute(r.a, r.b), (r.a, r.b)
        true, bound = 200.0 * r.n / (len(r.a) + len(r.b)) if r.a or r.b else 100.0, 200.0 * min(len(r.a), len(r.b)) / max(1, len(r.a) + len(r.b))
        assert abs(r.r - (true if bound >= 60 or true == 100 else bound)) < 1e-9


def test_hops_by_recursion(spark):
    rnd = random.Random(6)
    edges = {(c, a, b) for c in range(12) for _ in range(30) for a, b in [sorted(rnd.sample(range(14), 2))]}
    targets = {(c, rnd.randrange(14)) for c in range(13) for _ in range(2)}
    e, t = spark.createDataFrame(sorted(edges), "card_id long, src int, dst int"), spark.createDataFrame(sorted(targets), "card_id long, row_id int")
    for up in (True, False):
        for hops in (0, 1, 3):
            want, front = set(), set(targets)
            for _ in range(hops):
                front = {(c, a if up else b) for c, a, b in edges if (c, b if up else a) in front}
                want |= front
            assert {(r.card_id, r.row_id) for r in rows.within_hops(e, t, hops, up).collect()} == want


@pytest.mark.parametrize("up", [True, False])
def test_hops_have_no_bound_on_rows_of_all_cards(spark, up):
    """A recursive query fails beyond ``spark.sql.cteRecursionRowLimit`` rows, a million unless set: 1.8 million come of 900,000 cards."""
    edges = spark.range(200).selectExpr("id AS card_id", "explode(array(struct(0 AS src, 1 AS dst), struct(1 AS src, 2 AS dst), struct(2 AS src, 3 AS dst))) AS e").select("card_id", "e.*")
    targets = spark.range(200).selectExpr("id AS card_id", f"{3 if up else 0} AS row_id")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = rows.within_hops(edges, targets, 2, up).groupBy("row_id").count().collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(map(tuple, got)) == [(1, 200), (2, 200)]


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastExchange" in plan, plan.count("SortMergeJoin") > 0


def test_pairs_of_exploded_tokens_are_not_broadcast(spark):
    """A plan weighs a small table whose arrays are exploded by the table alone, whatever the arrays hold: 24 million tokens went through the driver."""
    df = spark.range(50).selectExpr("id AS card_id", "explode(sequence(1, 500)) AS tok_idx", "'n' AS pass_name", "'a' AS text", "0.5D AS score", "array(array(0D, 0D), array(9D, 9D)) AS box")
    assert _joins(tokens.overlap_pairs(df)) == (False, True)


def test_reading_edges_of_exploded_rows_are_not_broadcast(spark):
    df = spark.range(50).selectExpr("id AS card_id", "explode(sequence(1, 500)) AS row_id", "0D AS x1", "9D AS x2").withColumn("y_center", F.col("row_id") * 1.0)
    assert _joins(pages.reading_edges(df)) == (False, True)


def test_prominent_fields_deal_rows_by_card(spark):
    """Each choice read all rows with roles anew and was joined with the others: 57 exchanges and 28 joins with both parts of the plan, whatever their rows weigh."""
    lines = spark.range(5).selectExpr("id AS card_id", "explode(sequence(0, 3)) AS row_id", "'Ana Silva' AS text", "0D AS x1", "72D AS x2").withColumns({"y_center": F.col("row_id") * 30.0, "height": F.lit(20.0), "confidence": F.lit(0.9)})
    df = rows.prominent_fields(rows.roles(lines))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 3 and "BroadcastExchange" not in plan
    assert sorted(map(tuple, df.collect())) == [(c, "Ana Silva", None, None) for c in range(5)]


def test_counts_of_hints_equal_nested_loops_and_deal_no_lines(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(1, 7)))
    line = lambda: " ".join(rnd.choice([word(), word().upper(), ""]) for _ in range(rnd.randrange(0, 12)))
    texts = [(rnd.choice([None, i, i // 3]), "\n".join(line() for _ in range(rnd.randrange(0, 6)))) for i in range(200)] + [(900, None), (901, "  \n\n")]
    hints = sorted({rnd.choice([word(), f"{word()} {word()}", f"{word()}  {word()} "]) for _ in range(3000)}) + ["", "  ", "ABC", "abc"]
    docs, table = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(h,) for h in hints], "hint string")
    lines = [(i, x.lower()) for i, t in texts if t for x in t.split("\n") if x.strip(" ")]
    want = {}
    for h in {h.lower() for h in hints if h}:
        ids = [i for i, x in lines if h in x]
        if ids:
            want[h] = (len(ids), len({i for i in ids if i is not None}))
    got = lookups.count_hints(docs, table)
    assert len(want) > 300 and {r.hint: (r.n_lines, r.n_docs) for r in got.collect()} == want
    plan = lookups.count_hints(docs.filter("id = 901"), table)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hash") <= 2  # counts alone, in both parts of the plan
    monkeypatch.setattr(lookups, "SMALL", 10)  # a dictionary too large for it is joined
    assert {r.hint: (r.n_lines, r.n_docs) for r in lookups.count_hints(docs, table).collect()} == want


def test_pages_where_they_are_read_equal_all_pairs_and_deal_nothing(spark, monkeypatch):
    data = [t for c, n in ((1, 700), (2, 150), (3, 1), (4, 400)) for t in _page(c, n, card=c, spread=40.0 * c)]
    df = spark.createDataFrame(data, TOKEN).coalesce(1)
    key = lambda d: sorted((r.card_id, r.a, r.b, r.iou) for r in d.collect())
    kept = lambda d: sorted(map(repr, d.select("card_id", F.col("tok_idx").cast("long").alias("tok_idx"), "text", "score").collect()))
    pairs, stay = key(tokens.overlap_pairs(df)), kept(tokens.dedupe(df))
    assert len(pairs) > 300 and len(stay) < 1200
    for rows_of in ([1, 2, 3, 4], [1, 2, 2, 3, 4]):  # a page read from two rows is dealt
        sources = spark.createDataFrame([(c,) for c in rows_of], "card_id long")
        assert key(pages.overlaps_where_read(df, sources)) == pairs
        assert kept(pages.dedupe_where_read(df, sources)) == stay
    one = spark.createDataFrame([(c,) for c in range(1, 5)], "card_id long")
    for df2 in (pages.overlaps_where_read(df, one), pages.dedupe_where_read(df, one)):
        assert "Exchange" not in df2._jdf.queryExecution().executedPlan().toString()
    # Pages go on from batch to batch, and are worked out whole.
    monkeypatch.setattr(pages, "AT_ONCE", 50)
    table = pages._placed(df).toArrow()
    got = [r for b in pages._page_by_page(pages._pairs(0.58))(iter(table.to_batches(max_chunksize=30))) for r in b.to_pylist()]
    assert sorted((r["card_id"], r["a"], r["b"]) for r in got) == [p[:3] for p in pairs]


def test_canonical_texts_are_the_same_in_python(spark):
    odd = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + ["Bell|oQsz", "", "İK-9", "ΑΣ Σ", "a\n\tB", "ＡＢ１", "²½"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select("t", canonical(F.col("t")).alias("c")).collect()
    assert [r.t for r in got if r.c != canonical_of(r.t)] == []
