"""The master: whole versions or none, conflicting writers, late passes, months of event times."""

import pytest
from pyspark.sql import functions as F

from cardweave.operators import master
from cardweave.plans import manifest, pipelines
from cardweave.sources import fixtures
from cardweave.streaming import jobs

RECORD = "card_id long, name string, company string, title string, email string, phone string, website string, address string, month string, run_id int"


def _batch(spark, rows):
    """Records (card, name, month) of a run."""
    return spark.createDataFrame([(c, n, "", "", f"{c}@x.io", "", "", "", m, r) for c, n, m, r in rows], RECORD)


def _rows(df):
    return sorted((r.card_id, r.name, r.month) for r in df.collect())


def test_a_lost_merge_leaves_the_master_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "master")
    master.merge_master(_batch(spark, [(1, "a", "2024_01", 1), (2, "b", "2024_02", 1)]), path)
    before = _rows(master.read_master(spark, path))
    commit = manifest.commit

    def lost(*args):
        raise SystemError("lost between the data and the version")

    monkeypatch.setattr(manifest, "commit", lost)
    with pytest.raises(SystemError):
        master.merge_master(_batch(spark, [(3, "c", "2024_02", 2)]), path)
    assert _rows(master.read_master(spark, path)) == before
    monkeypatch.setattr(manifest, "commit", commit)
    for _ in range(2):  # run again, and once more
        master.merge_master(_batch(spark, [(3, "c", "2024_02", 2)]), path)
        assert _rows(master.read_master(spark, path)) == sorted([*before, (3, "c", "2024_02")])
    assert _rows(master.read_master(spark, path, ["2024_01"])) == [(1, "a", "2024_01")]
    manifest.vacuum(spark, path, keep=1)
    assert len(_rows(master.read_master(spark, path))) == 3 and len(list((tmp_path / "master" / "data").iterdir())) == 2


def test_readers_of_a_version_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "master")
    master.merge_master(_batch(spark, [(1, "a", "2024_01", 1)]), path)
    reading = master.read_master(spark, path)
    began, folders = manifest.current(spark, path)
    master.merge_master(_batch(spark, [(2, "b", "2024_01", 2)]), path)
    assert _rows(reading) == [(1, "a", "2024_01")]  # the files of the version before are still there
    with pytest.raises(manifest.ConflictError):
        master.write_months(master.signed(_batch(spark, [(3, "c", "2024_01", 3)])), path, ["2024_01"], began, folders)
    assert [r[0] for r in _rows(master.read_master(spark, path))] == [1, 2]
    assert not [p for p in (tmp_path / "master" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    with pytest.raises(Exception, match="at least one"):
        manifest.vacuum(spark, path, keep=0)


def test_cards_move_between_months(spark, tmp_path):
    path = str(tmp_path / "master")
    master.merge_master(_batch(spark, [(1, "a", "2024_02", 1), (2, "b", "2024_02", 1)]), path)
    master.merge_master(_batch(spark, [(1, "a b", "2024_01", 2)]), path, master.replace_cards, ["2024_01", "2024_02"])
    assert _rows(master.read_master(spark, path)) == [(1, "a b", "2024_01"), (2, "b", "2024_02")]
    master.merge_master(_batch(spark, [(2, "b", "2024_01", 3)]), path, master.replace_cards, ["2024_01", "2024_02"])
    assert manifest.current(spark, path)[1].keys() == {"2024_01"}  # a month without rows goes
    assert master.read_master(spark, str(tmp_path / "none")) is None


def test_stream_of_passes_equals_batch(spark, tiny, tmp_path):
    """Passes of a card in different files and batches, late ones last, equal one batch; a second start finds nothing new."""
    t = fixtures.contact_tokens(spark, tiny).filter("card_id <= 60")
    late = (F.col("card_id") % 5).cast("int")
    t = t.withColumn("ts", F.to_timestamp(F.lit("2024-01-29")) + F.make_dt_interval((F.col("card_id") % 9).cast("int")) + F.make_dt_interval(F.when(F.col("pass_name") == "bright", late).otherwise(F.lit(0)))).cache()
    source, path = str(tmp_path / "tokens"), str(tmp_path / "master")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)
    run = lambda: jobs.incremental_contacts(spark, source, schema, str(tmp_path / "progress"), path, files=1)
    t.filter("pass_name = 'bright'").coalesce(1).write.mode("append").parquet(source)
    run()
    half = master.read_master(spark, path)
    assert half.count() == 61
    t.filter("pass_name = 'normal'").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        run()
    columns = ["card_id", *master.FIELDS, "quality_badge"]
    got = master.read_master(spark, path)
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, pipelines.contacts(t.drop("ts")).select(columns).collect()))
    months = {r.card_id: r.m for r in t.groupBy("card_id").agg(F.date_format(F.min("ts"), "yyyy_MM").alias("m")).collect()}
    assert {r.card_id: r.month for r in got.collect()} == months and len(set(months.values())) == 2


def test_gathering_reads_only_what_is_near(spark, tmp_path):
    schema = "card_id long, tok_idx int, pass_name string, text string, ts timestamp"
    rows = lambda *r: spark.createDataFrame([(c, i, p, t, d) for c, i, p, t, d in r], "card_id long, tok_idx int, pass_name string, text string, d string").selectExpr("card_id", "tok_idx", "pass_name", "text", "timestamp(d) ts")
    store = str(tmp_path / "store")
    seen = lambda df: sorted((r.card_id, r.text) for r in df.collect())
    a = rows((1, 0, "n", "a", "2024-01-01"), (2, 0, "n", "b", "2024-01-01"), (1, 1, "n", "far", "2023-11-01"))
    assert a.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    assert seen(jobs.gather(a, 0, store, "ts", 7)) == [(1, "a"), (1, "far"), (2, "b")]
    b = rows((1, 0, "m", "c", "2024-01-05"))
    for _ in range(2):  # again after a loss
        assert seen(jobs.gather(b, 1, store, "ts", 7)) == [(1, "a"), (1, "c")]
    assert seen(jobs.gather(a, 0, store, "ts", 7)) == [(1, "a"), (1, "far"), (2, "b")]  # a repeated batch sees no later one
