"""A training corpus from ``documents``, in five stages, each one of the operators of ``cardweave.llm``.

A stage is a function of (spark, docs, sf_dir). It reads all rows that the stage
before kept, written as Parquet and read again; all but the last return the columns
of ``documents``. What is added inside a stage has names with two underscores before,
so columns of any other name may be there. A null text is an empty one to every stage,
and an empty table gives an empty one. A stage first writes what it has decided about
documents, a short table, and deletes its other intermediate tables with that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardweave.llm.common import cut, drop_cut, passing, small_or_not, text_of
from cardweave.llm.decontaminate import contaminated
from cardweave.llm.linededup import dedup_lines
from cardweave.llm.neardup import near_duplicates
from cardweave.llm.packing import pack_documents
from cardweave.llm.toxicity import score_texts, train_model

#: A document from this score on is rejected as toxic.
TOXIC = 0.5


def _keep_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic. The model learns from all labels but those set aside.

    Empty texts get the score of such texts. The score is of the text, so rows equal in
    id (null or not) and text go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with passing():
        model = train_model(docs, labels)
        toxic = cut(score_texts(docs, model).filter(F.col("score") >= TOXIC).select(F.col("id").alias("__id"), F.col("text_hash").alias("__th")).distinct(), outlive=True)
    toxic = small_or_not(toxic)
    return docs.join(toxic, docs["doc_id"].eqNullSafe(toxic["__id"]) & (F.xxhash64(text_of("text")) == toxic["__th"]), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later repeats of runs of lines and sentences; documents with nothing left go.

    Texts without a repeat stay as they are, empty and null ones too. Rows equal in id and
    text are one document and lose the same. ``n_chars``, if there, is counted anew.
    """
    out = dedup_lines(docs, count_col="__n_deleted")
    left = out.filter((F.col("__n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _keep_columns(left, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the least id.

    Texts without words are linked with nothing and stay, as do rows without an id. Rows of
    one id are one document to the operator; of those one row stays, the first by its text.
    """
    with passing():
        groups = cut(near_duplicates(docs).filter("not kept").select(F.col("id").alias("__id")).distinct(), outlive=True)
    groups = small_or_not(groups)
    rest = docs.join(groups, docs["doc_id"] == groups["__id"], "left_anti")
    twice = cut(rest.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("doc_id").alias("__id")))
    if twice.isEmpty():
        return _keep_columns(rest, docs)
    named = rest.filter("doc_id is not null").withColumn("__th", F.xxhash64(text_of("text")))
    twice = small_or_not(twice)
    once = named.join(twice, F.col("doc_id") == F.col("__id"), "left_anti")
    again = named.join(twice, F.col("doc_id") == F.col("__id"), "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), "__th").alias("__row")).select("__row.*")
    return _keep_columns(once, docs).unionByName(again).unionByName(rest.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of a benchmark item; empty and null texts hold none. Equal rows go or stay together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with passing():
        hits = cut(contaminated(docs, benchmark).filter("n_matched > 0").select(F.col("id").alias("__id"), F.col("text_hash").alias("__th")).distinct(), outlive=True)
    hits = small_or_not(hits)
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["__id"]) & (F.xxhash64(text_of("text")) == hits["__th"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 2048; an empty text is its end token alone, each row is packed by itself."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("n_tokens").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the learned score, the hashes of the fingerprints, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage no longer needs is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        before = docs
        with passing():
            docs = cut(stage(spark, docs, sf_dir), outlive=True)
        drop_cut(before)
