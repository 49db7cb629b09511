"""Reference operators: the given SQL at the smallest size, literal cases, and invariants."""

import math
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from cardweave import oracles, queries
from cardweave.functions import text as X
from cardweave.operators import extract, master, rows, tokens
from cardweave.plans import pipelines
from cardweave.sources import fixtures, payload
from cardweave.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return None if math.isnan(float(v)) else round(float(v), 5)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_equals_sql(spark, tiny, duck, name):
    got = queries.queries()[name](spark, tiny)
    ran = duck.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in ran.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in ran.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect()), key=repr) == want


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "text string").select(fn(F.col("text"))).first()[0]


def lines(spark, *texts):
    return tokens.lines_as_layout(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "card_id long, line_no int, text string"))


def test_literal_texts(spark):
    assert one(spark, "VERTEX AI LABS PTE.LTD,", X.strip_trailing_punct) == "VERTEX AI LABS PTE.LTD"
    assert one(spark, "ARMA NI G R 0 U P S.P.A.", X.repair_digits) == "ARMA NI G R O U P S.P.A."
    assert [one(spark, t, X.collapse_spaced_letters) for t in ("S E N I O R", "S e n i o r  S y s t e m s", "S E NIOR", "S")] == ["SENIOR", "SeniorSystems", "S E NIOR", "S"]
    assert [one(spark, t, X.spaced_letters) for t in ("J. P. M", "a b", "a", "a bc", "1 2")] == [True, True, False, False, False]
    assert [one(spark, t, X.word_of_line) for t in (" R0AD., ", "R0ad", "+65", "S10")] == ["ROAD", "R0ad", "+65", "SIO"]
    assert one(spark, "Johannesburq", X.canonical) == one(spark, "Johannesburg", X.canonical)
    assert one(spark, "I", X.canonical) == "i"  # quirk Q8
    assert one(spark, "", X.fidelity) == -100.0
    assert [one(spark, t, X.is_title) for t in ("O'Neil Mary-Ann", "O'neil Mary-Ann", "ABC")] == [True, False, False]
    assert one(spark, "Dave", lambda c: X.has_hint(c, ["ave"])) is True  # quirk Q3
    assert one(spark, "+65 9123 4567", X.phone_normal) == "+6591234567"


def test_literal_fields(spark):
    assert extract.names(lines(spark, "ADITYA V. VARMA", "Senior Engineer")).first().name == "ADITYA V. VARMA"
    got = extract.emails(lines(spark, "a@b.example and x@y.co.uk, A@B.example")).collect()
    assert sorted(r.email for r in got) == ["a@b.ex", "x@y.co.uk"]  # quirk Q6
    card = lines(spark, "+65 9123 4567", "71 Ayer Rajah Crescent, #03-18, Singapore 139951")
    flags = extract.address_lines(card)
    assert [(r.row_id, r.region, r.postal) for r in flags.filter("is_address").collect()] == [(1, "SG", "139951")]
    assert "+65 91234567" in {r.phone for r in extract.phones(card, extract.blocked(flags)).collect()}
    two = extract.phones(lines(spark, "+971 4 321 9900", "+971 50 800 1234"), extract.blocked(flags)).collect()
    assert {"+971 43219900", "+971 508001234"} <= {r.phone for r in two}
    merged = extract.fuzzy_merge(lines(spark, "1 Sturdee Avenue, Rosebank, Johannesburg 2196, South Africa", "other").unionByName(
        lines(spark, "1 Sturdee Avenue, Rosebank, Johannesburq 2l96, South Africa").withColumn("row_id", F.lit(5))))
    assert sorted(r.text for r in merged.collect()) == ["1 Sturdee Avenue, Rosebank, Johannesburg 2196, South Africa", "other"]


def test_invariants(spark, tiny):
    t = fixtures.contact_tokens(spark, tiny)
    once = tokens.dedupe(t)
    key = lambda df: sorted((r.card_id, r.tok_idx) for r in df.collect())
    assert key(tokens.dedupe(once)) == key(once)
    assert key(tokens.dedupe(t.repartition(7, F.rand(3)))) == key(once)
    ids = tokens.cluster_rows(once).groupBy("card_id").agg(F.max("row_id").alias("top"), F.countDistinct("row_id").alias("n")).collect()
    assert all(r.top + 1 == r.n for r in ids)


def test_master_is_idempotent(spark, tiny, tmp_path):
    old, new = queries._batches(spark, tiny)
    first = master.upsert(old, new)
    again = master.upsert(first.drop("signature"), new)
    strip = lambda df: sorted(map(repr, df.select("card_id", "month", "run_id", "email").collect()))
    assert strip(first) == strip(again)
    assert master.append_new(first.drop("signature"), new).count() == 0
    path = str(tmp_path / "master")
    master.merge_master(old, path)
    master.merge_master(new, path)
    assert strip(master.read_master(spark, path)) == strip(first)


def test_stream_equals_batch(spark, tiny, tmp_path):
    source = str(tmp_path / "lines")
    batch = fixtures.contact_lines(spark, tiny).withColumn("line_no", F.col("line_no").cast("int"))
    batch.repartition(4).write.parquet(source)
    target = str(tmp_path / "emails")

    def merge(df, n):
        rows.first_email(df.filter("line_no = 3")).write.mode("append").parquet(target)

    jobs.incremental_lines(spark, source, "card_id long, line_no int, text string", str(tmp_path / "progress"), merge, files=1)
    assert sorted(map(repr, spark.read.parquet(target).collect())) == sorted(map(repr, rows.first_email(batch).collect()))
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = jobs.first_seen(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), ["user_id", "event_type"], "ts", "3650 days")
    stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == events.select("user_id", "event_type").distinct().count()


def test_inputs(spark, tmp_path):
    inner = tmp_path / "b.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.png", b"3")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("2.jpg", b"2")
        z.writestr("1.PNG", b"1")
        z.writestr(".hidden.png", b"0")
        z.writestr("notes.txt", b"0")
        z.write(inner, "z/b.zip")
    inner.unlink()
    (tmp_path / "c.jpeg").write_bytes(b"4")
    assets = payload.expand_archives(spark, str(tmp_path))
    assert sorted(bytes(r.content) for r in assets.collect()) == [b"1", b"2", b"3"]
    assert [r.path.rsplit("/", 1)[1] for r in payload.discover_assets(spark, str(tmp_path)).collect()] == ["c.jpeg"]

    def read(blob, name):
        if name == "bright" and blob == b"2":
            raise ValueError("no such page")
        return [(blob.decode(), 0.9, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])]

    passes = spark.createDataFrame([("normal",), ("bright",)], "pass_name string")
    assert payload.recognise(assets, passes, read).count() == 5
    items = '[{"poly":[[0,0],[8,0],[8,4],[0,4]],"rec_text":"a","rec_score":0.5},{"bbox":[0,0,8,0,8,4,0,4],"label":"b"},{"bbox":[0,1,2],"text":"bad"},{"box":[],"poly":[[0,0],[4,4]],"text":"","label":"c","score":0,"rec_score":0.25},[[[0,0],[8,4]],["d, \\"e\\"",0.75]],[[0,0,8,0,8,4,0,4],{"text":"f","score":0.5}],[[[1,2]],"g"],[[[1,2]]],{"text":"no box"},[[[1,2]],["h","x"]]]'
    got = payload.tokens_from_items(spark.createDataFrame([(1, "normal", items)], "card_id long, pass_name string, items string")).collect()
    assert [(r.text, r.score) for r in got] == [("a", 0.5), ("b", 0.0), ("c", 0.25), ('d, "e"', 0.75), ("f", 0.5), ("g", 0.0)]
    assert got[1].box == [[0.0, 0.0], [8.0, 0.0], [8.0, 4.0], [0.0, 4.0]] and got[4].box == got[1].box
    with pytest.raises(ValueError):
        payload.recognise(assets, spark.createDataFrame([(str(i),) for i in range(20)], "pass_name string"), read)


def test_custom_quality(spark):
    rec = spark.createDataFrame([("Ana Moreno", "", "", "x", None, None, None)], "name string, company string, title string, email string, phone string, website string, address string")
    assert extract.quality(rec).first().quality_badge == "RED"
    assert extract.quality(rec, {"email": lambda c: c == "x"}, {"name": 9.0}).first().quality_score == 1.0
    out = pipelines.contacts_from_lines(lines(spark, "Ana Moreno", "Sales Manager", "ORBIT LTD", "ana@orbit.com"))
    assert out.select("name", "company", "title", "email").first() == ("Ana Moreno", "ORBIT LTD", "Sales Manager", "ana@orbit.com")


def test_persist_bundle(spark, tmp_path):
    out = pipelines.contacts_from_lines(lines(spark, "Ana Moreno", "Sales Manager", "ORBIT LTD", "ana@orbit.com"))
    master.persist_bundle(out, str(tmp_path), "r1")
    assert spark.read.text(master.bundle_folder(spark, str(tmp_path)) + "/vcards").count() == 10
    assert spark.read.parquet(master.bundle_folder(spark, str(tmp_path), "r1") + "/fields").count() == 8


def test_likeness(spark):
    from cardweave.functions.similarity import confusion_likeness, edit_likeness, lcs_likeness

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    pairs = [("john smith", "j0hn smith"), ("abcabba", "cbabac"), ("", "x"), ("", ""), ("vertex ai", "vertex al labs")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lcs_likeness("a", "b").alias("l"), confusion_likeness(F.col("a"), F.col("b"), edit_likeness(F.col("a"), F.col("b"))).alias("c")).collect()
    for r in got:
        assert abs(r.l - (200.0 * brute(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 100.0)) < 1e-9
    assert {(r.a, r.c) for r in got} >= {("john smith", 95.0), ("", 100.0)}
