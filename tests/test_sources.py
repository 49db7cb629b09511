"""Archives as a data source, table functions and validators in SQL."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cardweave.functions import registered
from cardweave.operators.extract import VALIDATORS
from cardweave.functions.text import canonical
from cardweave.sources import payload
from cardweave.sources.archive import ArchiveReader, ArchiveSource


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def _folder(tmp_path):
    inner = _zip([("b.png", b"inner b"), ("a.png", b"inner a"), ("deep.zip", _zip([("x.jpg", b"deep")]))])
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.zip").write_bytes(_zip([("2.jpg", b"2"), ("1.PNG", b"1"), (".hidden.png", b"0"), ("notes.txt", b"0"), ("dir/", b""), ("z/in.zip", inner), ("zz.png", b"")]))
    (tmp_path / "sub" / "many.ZIP").write_bytes(_zip([(f"{i:04d}.png", f"m{i}".encode()) for i in range(50)]))
    (tmp_path / "empty.zip").write_bytes(_zip([]))


def test_archives_as_a_source(spark, tmp_path):
    _folder(tmp_path)
    spark.dataSource.register(ArchiveSource)
    read = lambda **o: spark.read.format("archive").options(**o).load(str(tmp_path))
    plain = lambda df: sorted((r.label.replace("file:", "").replace("///", "/"), bytes(r.content)) for r in df.collect())
    got = plain(read(members_per_task="7"))
    assert got == plain(payload.expand_archives(spark, str(tmp_path))) and len(got) == 56
    assert read(members_per_task="7").rdd.getNumPartitions() == 8 + 1
    assert plain(read(suffixes=".jpg")) == sorted([(f"{tmp_path}/a.zip#asset0", b"2"), (f"{tmp_path}/a.zip#asset1#asset0#asset0", b"deep")])
    with pytest.raises(Exception, match="nested deeper"):
        read(max_depth="2").collect()
    (tmp_path / "bomb.zip").write_bytes(_zip([("big.png", b"0" * 3_000_000)]))
    with pytest.raises(Exception, match="larger than"):
        read(max_member_mb="1").collect()
    (tmp_path / "bomb.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip file"):
        read().collect()
    assert plain(read(skip_damaged="true")) == got
    with pytest.raises(ValueError, match="expand_archives"):
        ArchiveReader({"path": "s3a://x/y"})


def test_recogniser_in_sql(spark):
    def words(content, name):
        if name == "broken" or content == b"fail":
            raise ValueError(name)
        return [(w, 0.5, [[float(i), 0.0]]) for i, w in enumerate(content.decode().split())]

    registered.register_recogniser(spark, "words_of", words, ("normal", "broken", "bright"))
    spark.createDataFrame([("a", b"x y"), ("b", b""), ("c", None), ("d", b"fail")], "label string, content binary").createOrReplaceTempView("assets")
    got = spark.sql("SELECT * FROM words_of(TABLE(assets) PARTITION BY label) ORDER BY label, tok_idx").collect()
    assert [(r.label, r.tok_idx, r.pass_name, r.text) for r in got] == [("a", 0, "normal", "x"), ("a", 1, "normal", "y"), ("a", 2, "bright", "x"), ("a", 3, "bright", "y")]


def test_validators_in_sql_equal_columns(spark):
    registered.register_functions(spark)
    texts = ["Ana Moreno", "ANA", "Dave Silva", "a@b.co", "a@b", "x@y.c1", "+65 9123 4567", "+6591234567", "123456", "www.orbit.com", "http://a.io/x", "12 North Road", "Road", "Singapore 123456", "Senior Engineer", "ORBIT LTD.", "p.o. box 7", "", "é ñ", "1 2 3", "a b c d e", "st. x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f, test in VALIDATORS.items():
        rows = df.select("t", F.expr(f"valid_{f}(t)").alias("sql"), test(F.col("t")).alias("col")).collect()
        assert [(r.t, r.sql) for r in rows] == [(r.t, r.col) for r in rows], f
        assert {r.sql for r in rows} == {True, False}
    assert all(r.a == r.b for r in df.select(F.expr("card_key(t)").alias("a"), canonical(F.col("t")).alias("b")).collect())
    assert "Python" not in df.select(F.expr("valid_name(t)"))._jdf.queryExecution().executedPlan().toString()


def test_items_are_parsed_a_few_times_only(spark):
    """A filter on the tokens was pushed below the parsing, with all of it written out: 130 calls of from_json for each token."""
    df = payload.tokens_from_items(spark.createDataFrame([(1, "n", "[]")], "card_id long, pass_name string, items string").repartition(2))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") < 20
