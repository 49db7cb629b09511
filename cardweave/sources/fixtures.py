"""Card tables derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST = "Ana Ben Carla Dave Elena Farid Grace Hugo".split()
LAST = "Moreno Keller Tanaka Okafor Silva Novak Haddad Lindqvist".split()
TITLES = ["Senior Engineer", "Sales Manager", "Managing Director", "Product Designer", "Research Analyst", "Head of Operations"]
COMPANIES, FORMS = "VERTEX ORBIT CEDAR MARLIN QUARTZ SUMMIT HARBOR".split(), "LTD GMBH GROUP".split()
TAILS = "com com.sg co.uk orgx".split()


def _pick(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, line_no, text): the lines of documents that are not blank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs.select(F.col("doc_id").alias("card_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return out.filter(F.trim("text") != "")


def contact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, line_no, text): up to six lines of a contact card for each customer."""
    k = F.col("c_custkey").cast("long")
    name = F.concat_ws(" ", _pick(FIRST, k % 8), _pick(LAST, F.floor(k / 8) % 8))
    phone = F.concat(F.lit("+65 9"), F.lpad(((k * 37) % 1000).cast("string"), 3, "0"), F.lit(" "), F.lpad(((k * 7919) % 10000).cast("string"), 4, "0"))
    lines = [
        F.when(k % 5 == 0, F.upper(name)).otherwise(name),
        _pick(TITLES, k % 6),
        F.concat_ws(" ", _pick(COMPANIES, k % 7), _pick(FORMS, k % 3)),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@mail"), (k % 10).cast("string"), F.lit("."), _pick(TAILS, k % 4)),
        F.when(k % 11 != 0, F.when(k % 2 == 1, F.regexp_replace(phone, " ", "")).otherwise(phone)),
        F.when(k % 7 != 0, F.concat((k % 90 + 10).cast("string"), F.lit(" North Road, Singapore "), ((k * 131) % 900000 + 100000).cast("string"))),
    ]
    out = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("card_id"), F.posexplode(F.array(*lines)).alias("line_no", "text"))
    return out.filter("text is not null")


def contact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, tok_idx, pass_name, text, score, box): the words of contact lines, as two recognition passes see them."""
    k = F.col("card_id")
    words = contact_lines(spark, sf_dir).select("card_id", "line_no", F.posexplode(F.split("text", " ")).alias("word_no", "word"), F.split("text", " ").alias("all"))
    before = F.coalesce(F.aggregate(F.slice("all", 1, F.col("word_no")), F.lit(0), lambda a, w: a + F.length(w) + 1), F.lit(0))
    words = words.select(
        "card_id", "line_no", "word_no", "word", (8.0 * before).alias("x"),
        (F.when(k % 4 == 0, 24).otherwise(30) * F.col("line_no") + F.col("word_no") % 3).cast("double").alias("y"),
        (0.1 + ((k * 31 + F.col("line_no") * 7 + F.col("word_no") * 13) % 88) / 100.0).alias("s"),
    )
    bright_text = F.when((k + F.col("line_no") + F.col("word_no")) % 3 == 0, F.translate("word", "g", "q")).otherwise(F.col("word"))
    passes = F.explode(F.array(
        F.struct(F.lit("normal").alias("pass_name"), F.lit(0).alias("p"), F.col("word").alias("text"), F.col("s").alias("score"), F.lit(0.0).alias("d")),
        F.struct(F.lit("bright").alias("pass_name"), F.lit(1).alias("p"), bright_text.alias("text"), (F.col("s") + F.when(((k + F.col("word_no")) % 5 == 0) & (bright_text == F.col("word")), 0.02).otherwise(-0.03)).alias("score"), F.lit(1.0).alias("d")),
    ))
    t = words.select("*", passes.alias("t")).select("card_id", "line_no", "word_no", "x", "y", "t.*")
    x1, y1 = F.col("x") + F.col("d"), F.col("y") + F.col("d")
    x2, y2 = x1 + 8.0 * F.length("text"), y1 + 20.0
    w = Window.partitionBy("card_id").orderBy("p", "line_no", "word_no")
    return t.select(
        "card_id", (F.row_number().over(w) - 1).alias("tok_idx"), "pass_name", "text", F.round("score", 4).alias("score"),
        F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2)).alias("box"),
    )


def dialled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, phone): numbers of many calling codes and lengths, some without a plus, for each customer."""
    k = F.col("c_custkey").cast("long")
    national = F.lpad(((k * 7919 + 13) % 100000000000).cast("string"), 11, "0").substr(F.lit(1), (F.lit(6) + k % 6).cast("int"))
    number = F.concat(F.when(k % 5 == 0, "").otherwise("+"), ((k * 7) % 999 + 1).cast("string"), F.when(k % 3 == 0, " ").otherwise("-"), national)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("card_id"), number.alias("phone"))


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, line_no, text): lines with websites and profiles of each customer; some have none of a kind."""
    k = F.col("c_custkey").cast("long")
    n = k.cast("string")
    lines = [
        F.concat(F.lit("mail user"), n, F.lit("@site"), n, F.lit(".com")), F.when(k % 3 != 0, F.concat(F.lit("www.site"), n, F.lit(".com/home"))), F.when(k % 2 == 0, F.concat(F.lit("blog"), n, F.lit(".org/a"))),
        F.when(k % 4 != 0, F.concat(F.lit("linkedin.com/in/user-"), n)), F.when(k % 5 == 0, F.concat(F.lit("see github.com/user"), n)), F.when(k % 3 == 1, F.concat(F.lit("twitter.com/user"), n)), F.when(k % 7 < 3, F.concat(F.lit("me: @user"), n, F.lit(" and @second"), n)),
    ]
    out = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("card_id"), F.posexplode(F.array(*lines)).alias("line_no", "text"))
    return out.filter("text is not null")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, pass_name, payload, items): tokens of each pass as JSON, in both forms; items of every shape that a recogniser may yield."""
    t = contact_tokens(spark, sf_dir)

    def item(x: F.Column) -> F.Column:
        """An object with corners, one with eight numbers under another key, or a list of a box and a pair, by turns."""
        flat = F.flatten(x["box"])
        quoted = F.replace(F.to_json(F.array(x["text"])), F.lit("]"), F.lit(""))
        pair = F.concat(F.lit("["), F.to_json(x["box"]), F.lit(","), quoted, F.lit(","), x["score"].cast("string"), F.lit("]]"))
        return (
            F.when(x["tok_idx"] % 3 == 0, F.to_json(F.struct(x["box"].alias("box"), x["text"].alias("text"), x["score"].alias("score"))))
            .when(x["tok_idx"] % 3 == 1, F.to_json(F.struct(flat.alias("bbox"), x["text"].alias("rec_text"), x["score"].alias("rec_score")))).otherwise(pair)
        )

    rows = t.groupBy("card_id", "pass_name").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "text", "score", "box"))).alias("t"))
    return rows.select(
        "card_id", "pass_name",
        F.to_json(F.struct(F.col("t.text").alias("rec_texts"), F.col("t.score").alias("rec_scores"), F.col("t.box").alias("rec_polys"))).alias("payload"),
        F.concat(F.lit("["), F.array_join(F.transform("t", item), ","), F.lit("]")).alias("items"),
    )


def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, y, ink): rows of pages with their ink; a page has the lines of 200 order keys, so pages grow in number."""
    page = F.floor(F.col("l_orderkey") / 200)
    w = Window.partitionBy("page_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ink", "l_extendedprice")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(page.alias("page_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("double").alias("ink"))
    return rows.select("page_id", (F.row_number().over(w) - 1).alias("y"), "ink")


def hard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, line_no, text): for each customer a card with what real cards have: words around the mail address, spaced capitals, digits in capitals, stops at the end, names of one to three words, two phones, other scripts and regions."""
    k = F.col("c_custkey").cast("long")
    n = k.cast("string")
    first, last = _pick(FIRST, k % 8), _pick(LAST, F.floor(k / 8) % 8)
    phone = F.concat(F.lit("+65 9"), F.lpad(((k * 37) % 10000000).cast("string"), 7, "0"))
    lines = [
        F.when(k % 6 == 0, first).when(k % 3 == 0, F.concat(first, F.lit(" de "), last)).otherwise(F.concat(first, F.lit(" "), last)),
        F.when(k % 5 != 0, F.concat(F.lit("write to user"), n, F.lit("@mail"), (k % 10).cast("string"), F.lit(".com today"))).otherwise(F.concat(F.lit("Mail: User"), n, F.lit("@mail"), (k % 10).cast("string"), F.lit(".co.uk, or call"))),
        _pick(["M A N A G E R", "Sales Manager.", "Senior  Engineer,;", "HEAD 0F SALES"], k % 4),
        F.concat(_pick(COMPANIES, k % 7), F.lit(" "), _pick(FORMS, k % 3), F.when(k % 2 == 0, ".,").otherwise("")),
        F.when(k % 11 != 0, F.when(k % 3 == 0, F.concat(phone, F.lit(" / +44 20"), F.lpad(((k * 91) % 100000000).cast("string"), 8, "0"))).otherwise(phone)),
        F.when(k % 7 != 0, F.concat((k % 90 + 10).cast("string"), F.lit(" North Road, Unit "), (k % 7).cast("string"), F.lit(", Singapore "), ((k * 131) % 900000 + 100000).cast("string"))),
        F.when(k % 2 == 0, F.concat(F.lit("www.firm"), n, F.lit(".com"))).otherwise(F.concat(F.lit("linkedin.com/in/user-"), n, F.lit(" @user"), n)),
        _pick(["London SW1A 1AA", "東京都千代田区 100-0001", "नमस्ते कार्यालय", "مكتب دبي", "Toronto M5V 3L9", "Reno 89501-1234"], k % 6),
    ]
    out = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("card_id"), F.posexplode(F.array(*lines)).alias("line_no", "text"))
    return out.filter("text is not null")


def hard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, tok_idx, pass_name, text, score, box): the words of ``hard_lines``, some of them in two parts that touch."""
    l = hard_lines(spark, sf_dir)
    words = l.select("card_id", "line_no", F.posexplode(F.split("text", " ")).alias("word_no", "word"), F.split("text", " ").alias("all"))
    before = F.coalesce(F.aggregate(F.slice("all", 1, F.col("word_no")), F.lit(0), lambda a, w: a + F.length(w) + 1), F.lit(0))
    cut = F.when((F.length("word") >= 6) & ((F.col("card_id") + F.col("word_no")) % 3 == 0), 2).when((F.length("word") >= 6) & ((F.col("card_id") + F.col("word_no")) % 3 == 1), 3).otherwise(F.length("word"))
    words = words.withColumns({"before": before, "cut": cut})
    part = F.explode(F.filter(F.array(F.struct(F.lit(0).alias("at"), F.expr("substring(word, 1, cut)").alias("text")), F.struct(F.col("cut").alias("at"), F.expr("substring(word, cut + 1)").alias("text"))), lambda p: (p["at"] == 0) | (p["text"] != "")))
    t = words.select("card_id", "line_no", "word_no", "before", part.alias("p")).select("card_id", "line_no", "word_no", F.col("p.at").alias("at"), F.col("p.text").alias("text"), (8.0 * (F.col("before") + F.col("p.at"))).alias("x1"), (30.0 * F.col("line_no")).alias("y1"))
    x2, y2 = F.col("x1") + 8.0 * F.length("text"), F.col("y1") + 20.0
    w = Window.partitionBy("card_id").orderBy("line_no", "word_no", "at")
    return t.select("card_id", (F.row_number().over(w) - 1).alias("tok_idx"), F.lit("normal").alias("pass_name"), "text", F.lit(0.9).alias("score"), F.array(F.array(F.col("x1"), F.col("y1")), F.array(x2, F.col("y1")), F.array(x2, y2), F.array(F.col("x1"), y2)).alias("box"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, tok_idx, pass_name, text, score, box, x1, y1, x2, y2): the words of documents, each a page, as two passes see them; long documents are pages of very many tokens. Those of a document stand together."""
    k = F.col("card_id")
    words = doc_lines(spark, sf_dir).select("card_id", "line_no", F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    words = words.filter("word != ''").select("card_id", "line_no", "word_no", "word", (96.0 * F.col("word_no")).alias("x"), (30.0 * F.col("line_no")).alias("y"), (0.1 + ((k * 31 + F.col("line_no") * 7 + F.col("word_no") * 13) % 88) / 100.0).alias("s"))
    seen = F.when((k + F.col("line_no") + F.col("word_no")) % 3 == 0, F.translate("word", "g", "q")).otherwise(F.col("word"))
    passes = F.explode(F.array(
        F.struct(F.lit("normal").alias("pass_name"), F.col("word").alias("text"), F.col("s").alias("score"), F.lit(0.0).alias("d")),
        F.struct(F.lit("bright").alias("pass_name"), seen.alias("text"), (F.col("s") + F.when((k + F.col("word_no")) % 5 == 0, 0.02).otherwise(-0.03)).alias("score"), F.lit(1.0).alias("d")),
    ))
    t = words.select("*", passes.alias("t")).select("card_id", "line_no", "word_no", "x", "y", "t.*")
    x1, y1 = F.col("x") + F.col("d"), F.col("y") + F.col("d")
    x2, y2 = x1 + 8.0 * F.length("text"), y1 + 20.0
    # Numbers follow the place, so no window over a whole page is needed.
    index = (F.col("line_no") * 65_536 + F.col("word_no")) * 2 + F.col("d").cast("int")
    return t.select("card_id", index.cast("long").alias("tok_idx"), "pass_name", "text", F.round("score", 4).alias("score"), F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2)).alias("box"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def archives(spark: SparkSession, sf_dir: str, folder: str, per_archive: int = 200) -> DataFrame:
    """Documents as members of ZIP files in a folder that all machines see as files, odd ones in an archive inside; (path) of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select(F.floor(F.col("doc_id") / per_archive).alias("no"), "doc_id", F.col("text").cast("binary").alias("content"))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import os
        import uuid
        import zipfile

        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{key[0]:08d}.zip"
        draft, inner = f"{path}.{uuid.uuid4().hex}", io.BytesIO()
        with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as outer, zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as odd:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                (odd if doc_id % 2 else outer).writestr(f"{doc_id:012d}.png", content)
            odd.close()
            outer.writestr("inner.zip", inner.getvalue())
        os.replace(draft, path)  # a task that runs again writes the same file
        return pd.DataFrame({"path": [path]})

    return docs.groupBy("no").applyInPandas(write, "path string")
