"""Queries over customers with numbers as large as those of 60 and 360 times sf0.1, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

KEYS = (3, 99_999, 100_000, 100_007, 100_023, 123_456, 250_008, 899_999, 1_000_000, 1_000_007, 5_399_999)


@pytest.fixture(scope="module")
def large(spark, tiny, tmp_path_factory):
    """A folder with one customer for each of ``KEYS``."""
    folder = tmp_path_factory.mktemp("large")
    one = spark.read.parquet(f"{tiny}/customer.parquet").limit(1)
    one.withColumn("c_custkey", F.explode(F.array(*(F.lit(k).cast("long") for k in KEYS)))).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def _differences(spark, large, name):
    """Rows that only the query has, and rows that only its SQL has."""
    db = duckdb.connect()
    db.sql(f"CREATE VIEW customer AS SELECT * FROM '{large}/customer.parquet/*.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    columns = want.columns
    want = sorted(map(repr, want.fetchall()))
    got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, large).select(*columns).collect())
    assert len(want) >= len(KEYS)
    return sorted(set(got) - set(want)), sorted(set(want) - set(got)), len(got) - len(want)


def test_contacts_read_no_number_in_a_mail_address(spark, large):
    assert _differences(spark, large, "contacts") == ([], [], 0)


def test_field_table_has_the_number_of_the_phone_line(spark, large):
    assert _differences(spark, large, "field_table") == ([], [], 0)


def test_wide_rows_have_the_number_of_the_phone_line(spark, large):
    assert _differences(spark, large, "wide_rows") == ([], [], 0)


def test_streamed_contacts_have_the_number_of_the_phone_line(spark, large):
    assert _differences(spark, large, "stream_contacts") == ([], [], 0)


def test_descendants_are_no_recursive_query(spark, large):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")  # a million unless set
    try:
        assert _differences(spark, large, "descendants") == ([], [], 0)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
