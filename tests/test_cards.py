"""Records from one array a card: equal to the choices as tables, in a plan of one exchange; texts of hard lines; layout vCards."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardweave.operators import extract, master, rows, tokens
from cardweave.operators.cards import layout_records, records
from cardweave.plans import pipelines
from cardweave.sources import fixtures

PLACES = ["12 North Road, Singapore 123456", "Suite 4, London SW1A 1AA", "+65 9123 4567", "tel 91234567 or 9123-4567", "+44 2079460958 / +65 91234567", "Ana Moreno", "BEN NOVAK", "Dave", "Sales Manager", "Head of 2 Labs", "ORBIT LTD", "Vertex Labs", "a@b.co.uk", "x@y.example;", "www.orbit.com", "https://a.io/b.", "@ana_m @ben", "123456789012345678", "", "1 Main Ave 2000", "ana@orbit.comx or b@c.io", "0065 9123 4567", "Product Designer", "Group"]


def _cards(spark, seed, n=150):
    rnd = random.Random(seed)
    data = []
    for c in range(n):
        y = 0.0
        for i in range(rnd.randrange(1, 9)):
            x, h = rnd.choice([0.0, 0.0, 30.0]), rnd.choice([18.0, 20.0, 30.0])
            y += rnd.choice([0.0, 20.0, 24.0, 60.0])
            text = rnd.choice(PLACES)
            data.append((c, rnd.choice([i, 20 - i]), text, x, y, x + 8.0 * len(text), y + h, h))
    return spark.createDataFrame(data, "card_id long, row_id int, text string, x1 double, y1 double, x2 double, y2 double, height double").dropDuplicates(["card_id", "row_id"])


def test_records_equal_choices_as_tables(spark):
    lines = _cards(spark, 3)
    got = {r.card_id: r for r in records(lines).collect()}
    flagged = extract.address_lines(lines)
    address = extract.addresses(flagged)
    email, url, handle = (f.filter("rank = 1") for f in (extract.emails(lines), extract.urls(lines), extract.handles(lines)))
    phone = extract.phones(lines, extract.blocked(flagged), address).filter("rank = 1")
    claim = lambda df, col: df.select("card_id", F.col(col).alias("value"))
    name = extract.names(lines, claim(email, "email").unionByName(claim(phone, "phone")))
    company = extract.companies(lines, claim(name, "name").unionByName(claim(address, "address")))
    title = extract.titles(tokens.merge_blocks(lines), claim(company, "company").unionByName(claim(name, "name")))
    for table, fields in ((email, ["email"]), (url, [("url", "website")]), (handle, [("handle", "social")]), (phone, ["phone"]), (address, ["address", "region", ("evidence", "address_evidence")])):
        pairs = [f if isinstance(f, tuple) else (f, f) for f in fields]
        want = {r.card_id: [r[a] for a, _ in pairs] for r in table.collect()}
        assert len(want) > 20
        assert {c: [r[b] for _, b in pairs] for c, r in got.items() if r[pairs[0][1]] is not None} == want
    for f, table in (("name", name), ("company", company), ("title", title)):
        want = {r.card_id: (r[f], r[f"{f}_confidence"], r[f"{f}_evidence"]) for r in table.collect()}
        assert len(want) > 20
        assert {c: (r[f], r[f"{f}_confidence"], r[f"{f}_evidence"]) for c, r in got.items() if r[f] is not None} == want


def test_contacts_take_one_exchange(spark, tiny):
    t = fixtures.contact_tokens(spark, tiny)
    plan = pipelines.contacts(t)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(card_id", plan)) == len(re.findall("Exchange", plan)) == 1
    assert "Join" not in plan and "Python" not in plan


def test_layout_records_equal_choices_as_tables(spark):
    lines = _cards(spark, 7).withColumns({"y_center": (F.col("y1") + F.col("y2")) / 2, "confidence": F.lit(0.5) + F.col("row_id") / 100})
    lines = lines.withColumn("row_id", F.row_number().over(Window.partitionBy("card_id").orderBy("y_center", "row_id")))
    r = rows.roles(lines)
    numbered = r.withColumn("line_no", F.col("row_id"))
    mail = rows.first_email(numbered)
    places = r.filter("role = 'address'").groupBy("card_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y_center", "row_id", "text"))), lambda s: s["text"]), ", ").alias("address"))
    want = rows.prominent_fields(r)
    for part in (mail, rows.websites(numbered, mail), rows.pivot_phones(rows.phones_by_layout(r)), places, rows.social_profiles(numbered), rows.card_corpus(r)):
        want = want.join(part, "card_id", "left")
    got = layout_records(r)
    key = lambda df: sorted((repr([x[c] for c in got.columns]) for x in df.collect()))
    assert key(got) == key(want.select(got.columns))
    filled = got.agg(*(F.count(c).alias(c) for c in got.columns)).first()
    assert all(filled[c] > 10 for c in ("name", "company", "title", "email", "website", "phone_1", "phone_2", "address", "twitter"))


def test_layout_contacts_take_one_exchange(spark, tiny):
    plan = pipelines.contacts_by_layout(fixtures.contact_tokens(spark, tiny))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(card_id", plan)) == len(re.findall("Exchange", plan)) == 1
    assert "Join" not in plan and "Python" not in plan


def test_first_email_keeps_words_apart(spark):
    df = spark.createDataFrame([(1, 0, "no mail"), (1, 1, "write to Ana@orbit.com today"), (1, 2, "b@c.io"), (2, 0, "x")], "card_id long, line_no int, text string")
    assert [tuple(r) for r in rows.first_email(df).collect()] == [(1, "ana@orbit.com")]


def test_layout_vcards(spark):
    cells = [(1, "Ana de Silva", "Head", "ORBIT", "a@b.c", "+1 2", "+3 4", "w.io", "1 Road, Rome, Italy"), (2, "Ana", None, "", None, None, None, None, None), (3, None, None, None, None, None, None, None, None)]
    got = {r.card_id: r.vcard.split("\n") for r in master.layout_vcards(spark.createDataFrame(cells, "card_id long, name string, title string, company string, email string, phone_1 string, phone_2 string, website string, address string")).collect()}
    assert got[1][2:4] == ["FN:Ana de Silva", "N:de Silva;Ana;;;"] and got[1][7:9] == ["TEL;TYPE=VOICE,PREF:+1 2", "TEL;TYPE=VOICE:+3 4"] and got[1][-2] == "ADR;TYPE=WORK:;;1 Road; Rome; Italy;;;;"
    assert got[2] == ["BEGIN:VCARD", "VERSION:3.0", "FN:Ana", "N:Ana;;;;", "END:VCARD"] and got[3] == ["BEGIN:VCARD", "VERSION:3.0", "END:VCARD"]


def test_flat_preset_counts_nine_fields(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["ANA M", "Manager", "Mail Ana@Orbit.com now", "linkedin.com/in/ana @ana"])], "card_id long, line_no int, text string")
    plain, filled = rows.flat_simple(df).first(), rows.flat_simple(df, profiles=True).first()
    assert (plain.name, plain.title, plain.email, plain.website, plain.linkedin, plain.filled, plain.badge) == ("ANA M", "Manager", "Ana@Orbit.com", "Orbit.com", None, 4, "YELLOW")
    assert (filled.linkedin, filled.twitter, filled.filled, filled.badge) == ("linkedin.com/in/ana", "@ana", 6, "GREEN")
