"""Records to wide rows, field tables, vCards, and the monthly master."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardweave.functions.text import file_stem, signature
from cardweave.plans import manifest
from cardweave.plans.stage import drop_stage, stage

FIELDS = ("name", "company", "title", "email", "phone", "website", "address")


def signed(records: DataFrame) -> DataFrame:
    return records.withColumn("signature", signature(*(F.col(f) for f in FIELDS)))


def append_new(master: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose (month, signature) the master lacks, the first of equal ones (by card_id)."""
    w = Window.partitionBy("month", "signature").orderBy("card_id")
    once = signed(batch).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return once.join(signed(master).select("month", "signature").distinct(), ["month", "signature"], "left_anti")


def upsert(master: DataFrame, batch: DataFrame, order: str = "run_id") -> DataFrame:
    """One row for each (month, signature): the batch's last one, or else the master's."""
    rows = signed(master).withColumn("newer", F.lit(0)).unionByName(signed(batch).withColumn("newer", F.lit(1)))
    w = Window.partitionBy("month", "signature").orderBy(F.desc("newer"), F.desc(order), F.desc("card_id"))
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "newer")


def replace_cards(master: DataFrame, batch: DataFrame) -> DataFrame:
    """``upsert`` after the master's rows of the batch's cards are gone: what is known of a card now takes the place of what was known before."""
    cards = batch.select("card_id").distinct()
    return upsert(master.join(cards, "card_id", "left_anti"), batch)


def read_master(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame | None:
    """The rows of the latest version, of all months or some; None if there are none."""
    _, folders = manifest.current(spark, path)
    chosen = sorted(f for m, f in folders.items() if months is None or m in months)
    return spark.read.parquet(*(f"{path}/{f}" for f in chosen)) if chosen else None


def write_months(rows: DataFrame, path: str, months: list[str], began: int, folders: dict[str, str]) -> int:
    """Commit ``rows`` as what ``months`` hold from now on; other months stay, and a month without rows goes."""
    spark = rows.sparkSession
    new = f"data/{uuid.uuid4().hex}"
    # The month stays a column of the files, as each folder is read by itself.
    rows.withColumn("_month", F.col("month")).write.partitionBy("_month").parquet(f"{path}/{new}")
    there = [r[0] for r in rows.select("month").distinct().collect()]  # as few as the batch has
    return manifest.commit(spark, path, began, {m: f for m, f in folders.items() if m not in months} | {m: f"{new}/_month={m}" for m in there})


def merge_master(batch: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = upsert, months: list[str] | None = None) -> None:
    """Merge a batch into the master at ``path``, made if it is not there: the batch's months (or ``months``) are read, merged and replaced.

    Merged months go to folders of their own, and the version that names them is committed in one
    step (``cardweave.plans.manifest``). A run that is lost before leaves the master as it was, one that is
    repeated merges to the same rows, and a second writer at the same time gets an error.
    """
    spark = batch.sparkSession
    batch = stage(batch)
    if months is None:
        months = sorted(r[0] for r in batch.select("month").distinct().collect())  # as few as the batch has
    began, folders = manifest.current(spark, path)
    old = read_master(spark, path, months)
    old = batch.limit(0) if old is None else old
    rows = merge(old, batch)
    # What only appends keeps the rows that are there.
    rows = stage(signed(old).unionByName(rows) if merge is append_new else rows)
    try:
        write_months(rows, path, months, began, folders)
    finally:
        drop_stage(rows, batch)


RECORD = (*FIELDS, "social")


def full_records(records: DataFrame) -> DataFrame:
    """Each field as struct<value,confidence,evidence,validated>, with quality, notes and raw lines."""
    text = lambda f: F.coalesce(f, F.lit(""))
    field = lambda f: F.struct(
        text(f).alias("value"), F.coalesce(f"{f}_confidence", F.lit(0.0)).alias("confidence"), F.coalesce(f"{f}_evidence", F.array().cast("array<string>")).alias("evidence"),
        (F.coalesce(F.col(f"valid_{f}"), F.lit(False)) if f != "social" else text(f) != "").alias("validated"),
    ).alias(f)
    return records.select("card_id", *map(field, RECORD), F.round("quality_score", 3).alias("quality_score"), "quality_badge", "notes", "raw_lines")


def flat_records(full: DataFrame) -> DataFrame:
    """A wide row of each full record; lists are joined by bars."""
    cells = [c for f in RECORD for c in (F.col(f"{f}.value").alias(f"{f}_value"), F.col(f"{f}.confidence").alias(f"{f}_confidence"), F.col(f"{f}.validated").alias(f"{f}_validated"), F.array_join(f"{f}.evidence", " | ").alias(f"{f}_evidence"))]
    return full.select("card_id", *cells, "quality_score", "quality_badge", F.array_join("notes", " | ").alias("notes"), F.array_join("raw_lines", " || ").alias("raw_lines"))


def layout_rows(records: DataFrame) -> DataFrame:
    """The seventeen columns of a record by layout; a dash for what is missing."""
    shown = lambda c, name: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—")).alias(name)
    names = (("name", "name"), ("title", "job_title"), ("company", "company"), ("email", "email"), *((f"phone_{k}", f"phone_{k}") for k in (1, 2, 3)), ("website", "website"), ("address", "address"), *((s, s) for s in ("linkedin", "twitter", "instagram", "github")), ("badge", "quality_score"))
    return records.select(*(shown(c, n) for c, n in names), F.coalesce("corpus", F.lit("")).alias("raw_text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence_avg"), F.col("card_id").cast("string").alias("source_file"))


def field_table(records: DataFrame) -> DataFrame:
    """(card_id, field, value, validated): a row for each field, and one for the quality."""
    cells = [F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("value"), F.col(f"valid_{f}").alias("validated")) for f in FIELDS]
    cells.append(F.struct(F.lit("quality").alias("field"), F.col("quality_badge").alias("value"), (F.col("quality_badge") != "RED").alias("validated")))
    return records.select("card_id", F.inline(F.array(*cells)))


def wide_rows(records: DataFrame) -> DataFrame:
    """Flat rows for CSV: value and validity of each field, score as a percentage, a dash for what is missing."""
    cells = [c for f in FIELDS for c in (F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("—")).alias(f"{f}_value"), F.col(f"valid_{f}").alias(f"{f}_validated"))]
    return records.select("card_id", *cells, F.format_string("%.1f%%", F.col("quality_score") * 100).alias("confidence"))


def vcards(records: DataFrame) -> DataFrame:
    """(card_id, vcard): vCard 3.0 with every property, empty ones too."""
    v = lambda f: F.coalesce(f, F.lit(""))
    shown = F.coalesce(F.nullif(v("name"), F.lit("")), F.nullif(v("company"), F.lit("")), F.col("card_id").cast("string"))
    props = [("ORG:", "company"), ("TITLE:", "title"), ("EMAIL;TYPE=INTERNET:", "email"), ("TEL;TYPE=VOICE:", "phone"), ("URL:", "website"), ("ADR;TYPE=WORK:;;", "address")]
    lines = [F.concat(F.lit(p), v(f)) for p, f in props]
    return records.select("card_id", F.concat_ws("\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), shown), *lines, F.lit("END:VCARD")).alias("vcard"))


def layout_vcards(records: DataFrame) -> DataFrame:
    """(card_id, vcard): vCard 3.0 with the properties that a record by layout has, and two phones, the first preferred.

    N has what follows the first word of the name, then that word; a name of one word stands alone.
    """
    filled = lambda f: F.nullif(F.coalesce(f, F.lit("")), F.lit(""))
    name = filled("name")
    parts = F.split(F.regexp_replace(name, r"(?U)^\s+", ""), r"(?U)\s+", 2)
    pair = (F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "")
    split = F.when(pair, F.concat(F.lit("N:"), F.get(parts, F.lit(1)), F.lit(";"), F.get(parts, F.lit(0)), F.lit(";;;"))).otherwise(F.concat(F.lit("N:"), name, F.lit(";;;;")))
    props = [("ORG:", "company"), ("TITLE:", "title"), ("EMAIL;TYPE=INTERNET:", "email"), ("TEL;TYPE=VOICE,PREF:", "phone_1"), ("TEL;TYPE=VOICE:", "phone_2"), ("URL:", "website")]
    lines = [F.concat(F.lit("FN:"), name), split, *(F.concat(F.lit(p), filled(f)) for p, f in props)]
    address = F.concat(F.lit("ADR;TYPE=WORK:;;"), F.replace(filled("address"), F.lit(", "), F.lit("; ")), F.lit(";;;;"))
    return records.select("card_id", F.concat_ws("\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), *lines, address, F.lit("END:VCARD")).alias("vcard"))


def with_stems(records: DataFrame) -> DataFrame:
    """``records`` with the name of their files, from what they show."""
    return records.withColumn("stem", file_stem(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("company"), F.lit("")), F.col("card_id").cast("string"))))


def persist_bundle(records: DataFrame, path: str, run_id: str) -> None:
    """Snapshot of a run: JSON records, CSV rows, vCards, field table; and the version that names it as the latest.

    Records are worked out once for all four. A run that is written again replaces its own snapshot of
    before by a new folder; readers of ``latest_bundle`` see a whole run.
    """
    spark = records.sparkSession
    began, folders = manifest.current(spark, path)
    records, new = stage(records), f"data/run_id={run_id}-{uuid.uuid4().hex}"
    try:
        records.write.json(f"{path}/{new}/records")
        wide_rows(records).write.option("header", True).csv(f"{path}/{new}/rows")
        vcards(records).select("vcard").write.text(f"{path}/{new}/vcards")
        field_table(records).write.parquet(f"{path}/{new}/fields")
        manifest.commit(spark, path, began, folders | {f"run_id={run_id}": new, "latest": new})
    finally:
        drop_stage(records)


def bundle_folder(spark: SparkSession, path: str, run_id: str | None = None) -> str:
    """The folder of a run's snapshot, or of the latest."""
    return f"{path}/{manifest.current(spark, path)[1]['latest' if run_id is None else f'run_id={run_id}']}"
