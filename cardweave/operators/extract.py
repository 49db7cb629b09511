"""From lines to fields: emails, phones, urls, handles, addresses, names, companies, titles, quality."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cardweave.functions import constants as C
from cardweave.functions.similarity import Likeness, lcs_ratio
from cardweave.functions.text import alpha_ratio, canonical, digit_count, fidelity, has_hint, is_title, is_upper, let, normalize_spaces, phone_normal, postal_region, postal_text, repair_digits, strip_trailing_punct, word_count
from cardweave.operators.tokens import of_card


def card() -> WindowSpec:
    return Window.partitionBy("card_id")


def first_wins(found: DataFrame, key: str = "canon") -> DataFrame:
    """The first row of each (card, key) by (row_id, pos), ranked on its card as rank 1, 2 ..."""
    w = Window.partitionBy("card_id", key).orderBy("row_id", "pos")
    one = found.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return one.withColumn("rank", F.row_number().over(card().orderBy("row_id", "pos")))


def _all(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(F.col("text").rlike(pattern)).select("card_id", "row_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "raw"))


def trim_emails(found: DataFrame, raw: str = "raw") -> DataFrame:
    """``found`` with email: the address with its last label cut to a known one, a two-part tail or the longest prefix that is a TLD or two letters; null if none.

    In steps, as an expression used twice would be planned and compiled twice.
    """
    d = found.withColumn("_t", strip_trailing_punct(F.regexp_replace(raw, r"^[()\[\]{}<>\"'`]+|[()\[\]{}<>\"'`]+$", "")))
    d = d.withColumn("_labels", F.filter(F.split(F.regexp_replace(F.regexp_replace("_t", "^[^@]*@", ""), r"^[.,;:]+|[.,;:]+$", ""), r"\."), lambda x: x != ""))
    d = d.filter(F.size("_labels") >= 2)
    d = d.withColumns({"_last": F.lower(F.element_at("_labels", -1)), "_tail": F.lower(F.array_join(F.slice("_labels", -2, 2), "."))})
    cuts = F.transform(F.sequence(F.length("_last"), F.lit(1), F.lit(-1)), lambda n: F.substring(F.col("_last"), F.lit(1), n))
    known = F.split(F.lit(" ".join(C.TLDS)), " ")
    d = d.withColumn("_cut", F.filter(cuts, lambda p: F.array_contains(known, p) | p.rlike(r"^\p{L}{2}$")))
    head = lambda k: F.slice("_labels", F.lit(1), F.size("_labels") - k)
    domain = F.when(F.col("_tail").isin(*C.MULTI_TLDS), F.array_join("_labels", ".")).when(F.size("_cut") > 0, F.array_join(F.concat(head(1), F.slice("_cut", 1, 1)), "."))
    return d.withColumn("email", F.lower(F.concat(F.substring_index("_t", "@", 1), F.lit("@"), domain))).drop("_t", "_labels", "_last", "_tail", "_cut")


def emails(lines: DataFrame) -> DataFrame:
    """(card_id, rank, email, row_id, text): all addresses, the first of equal ones."""
    found = trim_emails(_all(lines, C.EMAIL_SCAN)).filter(F.col("email").rlike(C.EMAIL_FULL))
    return first_wins(found.withColumn("canon", F.col("email"))).select("card_id", "rank", "email", "row_id", "text")


def urls(lines: DataFrame) -> DataFrame:
    v = strip_trailing_punct(F.col("raw"))
    found = _all(lines, C.URL).withColumn("url", F.when(F.lower(v).startswith("www."), F.concat(F.lit("https://"), v)).otherwise(v))
    return first_wins(found.withColumn("canon", F.lower("url"))).select("card_id", "rank", "url", "row_id", "text")


def handles(lines: DataFrame) -> DataFrame:
    return first_wins(_all(lines, C.HANDLE).withColumn("canon", F.lower("raw"))).select("card_id", "rank", F.col("raw").alias("handle"), "row_id", "text")


def address_lines(lines: DataFrame, strict_postal: bool = False) -> DataFrame:
    """Lines with ``postal``, ``region``, and whether they are address lines.

    ``strict_postal``: four bare digits are no postal code.
    """
    t = F.trim("text")
    region = postal_region(t)
    if strict_postal:
        region = F.when(region != "AU", region)
    hint = has_hint(t, C.ADDRESS_HINTS)
    like_phone = t.rlike(C.PHONE_LIKE) | t.contains("+")
    by_code = region.isNotNull() & (hint | ~like_phone)
    by_hint = hint & (alpha_ratio(t) >= 0.45) & (digit_count(t) >= 1)
    return lines.select("*", F.when(by_code, region).alias("region"), F.when(by_code, postal_text(t)).alias("postal"), (by_code | by_hint).alias("is_address"))


def blocked(flagged: DataFrame) -> DataFrame:
    """(card_id, canon): what may not be read as a phone, from address lines."""
    a = flagged.filter("is_address")
    texts = a.select("card_id", F.explode(F.array_compact(F.array("text", "postal"))).alias("t"))
    return texts.select("card_id", canonical(F.col("t")).alias("canon")).distinct()


def addresses(flagged: DataFrame) -> DataFrame:
    """(card_id, address, validated, region): address lines in reading order."""
    a = flagged.filter("is_address").withColumn("part", F.trim(F.regexp_replace("text", C.URL, "")))
    joined = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("y1", "x1", "row_id", "part"))), lambda s: s["part"] != ""), lambda s: s["part"]), ", ")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "row_id", "text"))), lambda s: s["text"])
    out = a.groupBy("card_id").agg(joined.alias("j"), texts.alias("evidence"), F.min_by("region", F.struct("y1", "x1", "row_id")).alias("r0"), F.min(F.when(F.col("region").isNotNull(), F.struct("y1", "x1", "row_id", "region"))).alias("r"))
    out = out.select("card_id", strip_trailing_punct(normalize_spaces(F.col("j"))).alias("address"), F.col("r.region").alias("region"), "evidence")
    return out.withColumn("validated", alpha_ratio(F.col("address")) >= 0.45)


def numbering(number: Column, region: Column | None = None) -> Column:
    """struct<region,number>: a number in its international form; null if no numbering plan fits.

    After "+" the longest calling code whose digits fit counts; without it the plan of ``region``.
    """
    plans = [(code, r, *C.NATIONAL_DIGITS.get(r, (7, 11))) for code, r in C.CALLING_CODES.items()]
    # A map from JSON is one node of the plan, and folded to a constant.
    table = lambda key: F.from_json(F.lit(json.dumps({p[key]: dict(zip(("code", "region", "low", "high"), p, strict=True)) for p in plans})), "map<string,struct<code:string,region:string,low:int,high:int>>")

    def form(plan: Column, rest: Column) -> Column:
        return let(plan, lambda p: F.when(F.length(rest).between(p["low"], p["high"]), F.struct(p["region"].alias("region"), F.concat(F.lit("+"), p["code"], F.lit(" "), rest).alias("number"))))

    def after_plus(digits: Column) -> Column:
        return F.coalesce(*(form(F.try_element_at(table(0), F.substring(digits, 1, n)), F.substring(digits, n + 1, 20)) for n in (3, 2, 1)))

    digits = F.regexp_replace(number, r"\D", "")
    if region is None:
        return F.when(number.startswith("+"), let(digits, after_plus))
    names = F.from_json(F.lit(json.dumps(C.REGION_NAMES)), "map<string,string>")
    home = F.try_element_at(table(1), F.coalesce(F.try_element_at(names, F.coalesce(region, F.lit(""))), region, F.lit("")))
    return F.when(number.startswith("+"), let(digits, after_plus)).otherwise(form(home, digits))


def plan_numbers(found: DataFrame, col: str = "phone") -> DataFrame:
    """``found`` with region and international form; null if no plan fits."""
    return found.withColumn("_plan", numbering(F.col(col))).select(*found.columns, F.col("_plan.region").alias("region"), F.col("_plan.number").alias("number"))


def phone_forms(text: Column) -> Column:
    """What of a line may be a number: the line, its forms, and all windows of 7 to 15 of its digits, each with and without "+"; null with less than seven digits."""
    digits, norm = F.regexp_replace(text, r"\D", ""), phone_normal(text)
    n = F.length(digits)
    starts = F.sequence(F.lit(0), n - 7)
    windows = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(F.sequence(F.lit(7), F.lit(15)), lambda m: s + m <= F.least(n, F.lit(15))), lambda m: F.substring(digits, s + 1, m))))
    both = F.flatten(F.transform(windows, lambda w: F.array(w, F.concat(F.lit("+"), w))))
    bare = F.when(n.between(7, 15), F.array(F.regexp_replace(norm, r"\D", ""), F.concat(F.lit("+"), F.regexp_replace(norm, r"\D", "")))).otherwise(F.array().cast("array<string>"))
    return F.when(n >= 7, F.array_distinct(F.concat(F.array(text, norm), bare, both)))


def without_mail(text: Column) -> Column:
    """A text without its mail addresses: their digits are no part of a number, however many there are."""
    return F.when(text.contains("@"), F.regexp_replace(text, C.EMAIL_SCAN, " ")).otherwise(text)


def phone_windows(lines: DataFrame, mail: bool = True) -> DataFrame:
    """(card_id, row_id, text, pos, raw): the forms of each line that may be numbers; ``mail``: digits of mail addresses too."""
    t = lines.withColumn("_read", F.col("text") if mail else without_mail(F.col("text"))).filter(digit_count(F.col("_read")) >= 7)
    return t.select("card_id", "row_id", "text", F.posexplode(phone_forms(F.col("_read"))).alias("pos", "raw")).filter("raw != ''")


def phones(lines: DataFrame, no_phone: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(card_id, rank, phone, row_id, text): numbers of lines that are no address, the most faithful form of equal digits.

    A number that fits a plan takes its international form; ``regions`` (card_id, region), if given,
    names the plan of numbers without a calling code. A candidate with a postal code in it is
    none (see quirk Q4), and digits of mail addresses are not read.
    """
    at = lines.filter(~(has_hint(F.col("text"), C.ADDRESS_HINTS) & postal_region(F.col("text")).isNotNull())).withColumn("canon", canonical(F.col("text")))
    free = at.join(no_phone, ["card_id", "canon"], "left_anti").drop("canon")
    # Bare digits, as most candidates are, are normal as they stand, and too long for a postal code.
    bare = F.col("raw").rlike(r"^\+?\d{7,15}$")
    raw = phone_windows(free, mail=False).filter(F.when(bare, True).otherwise(postal_region(F.col("raw")).isNull())).withColumn("norm", F.when(bare, F.col("raw")).otherwise(phone_normal(F.col("raw")))).filter("norm != ''")
    raw = raw.join(regions.select("card_id", F.col("region").alias("_home")), "card_id", "left") if regions is not None else raw.withColumn("_home", F.lit(None).cast("string"))
    # In steps, as the plan is used twice.
    raw = raw.withColumn("digits", F.regexp_replace("norm", r"\D", "")).filter(F.length("digits").between(7, 15)).withColumn("plan", numbering(F.col("norm"), F.col("_home")))
    form = raw.withColumn("phone", F.coalesce("plan.number", F.when(F.col("norm").startswith("+"), F.col("norm")).otherwise(F.col("digits")))).withColumn("canon", F.regexp_replace("phone", r"\D", ""))
    # Python's dict keeps the place of the first; the value is that of the best.
    w = Window.partitionBy("card_id", "canon")
    ranked = form.withColumns({"best": F.row_number().over(w.orderBy(fidelity(F.col("phone")).desc(), "row_id", "pos")), "r0": F.min(F.struct("row_id", "pos")).over(w)}).filter("best = 1")
    return ranked.withColumn("rank", F.row_number().over(card().orderBy("r0"))).select("card_id", "rank", "phone", F.col("r0.row_id").alias("row_id"), "text")


def ordered(lines: DataFrame) -> DataFrame:
    """Lines with their place in reading order, from 0."""
    return lines.withColumn("idx", F.row_number().over(card().orderBy("y1", "x1", "row_id")) - 1).withColumn("value", strip_trailing_punct(F.col("text")))


def looks_like_name(t: Column) -> Column:
    hints = reduce(lambda a, b: a | b, (has_hint(t, h) for h in (C.ADDRESS_HINTS, C.JOB_HINTS, C.COMPANY_HINTS)))
    return (t != "") & (digit_count(t) == 0) & word_count(t).between(1, 4) & ~hints & (alpha_ratio(t) >= 0.7)


def looks_like_company(t: Column) -> Column:
    return (t != "") & (has_hint(t, C.COMPANY_HINTS) | ((digit_count(t) == 0) & ((is_upper(t) & (F.length(t) <= 32)) | (word_count(t).between(1, 4) & (alpha_ratio(t) >= 0.55)))))


def _not_claimed(candidates: DataFrame, claimed: DataFrame | None) -> DataFrame:
    """Candidates whose canonical text is neither empty nor a claimed one of the card."""
    out = candidates.withColumn("canon", canonical(F.col("value"))).filter("canon != ''")
    if claimed is None:
        return out
    keys = claimed.select("card_id", canonical(F.col("value")).alias("canon")).distinct()
    return out.join(keys, ["card_id", "canon"], "left_anti")


def _best(candidates: DataFrame, name: str, base: float) -> DataFrame:
    w = card().orderBy(F.desc("score"), F.length("value").desc(), "idx")
    top = candidates.withColumn("k", F.row_number().over(w)).filter("k = 1")
    return top.select("card_id", F.col("value").alias(name), F.round(F.least(F.lit(0.99), base + F.col("score") / 100.0), 6).alias(f"{name}_confidence"), F.array("text").alias(f"{name}_evidence"))


def may_be_name(t: Column) -> Column:
    return ~has_hint(t, C.NAME_REJECTS) & looks_like_name(t)


def name_points(t: Column) -> Column:
    """What a text is worth as a name, without its place and its share of letters."""
    return F.when(word_count(t).isin(2, 3), 30.0).otherwise(12.0) + F.when(is_title(t), 18.0).otherwise(10.0)


def names(lines: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    t = F.col("value")
    c = _not_claimed(ordered(lines).filter(may_be_name(t)), claimed)
    return _best(c.withColumn("score", name_points(t) + F.when(F.col("idx") <= 2, 10.0).otherwise(2.0) + alpha_ratio(t) * 15.0), "name", 0.4)


def may_be_company(t: Column) -> Column:
    low = F.lower(t)
    return ~t.contains("@") & ~low.contains("www.") & ~low.contains("http") & looks_like_company(t)


def company_points(t: Column) -> Column:
    """What a text is worth as a company, without its place and its share of letters."""
    suffix = has_hint(t, [s.lower() for s in C.COMPANY_SUFFIXES])
    person = (word_count(t) <= 4) & ~F.regexp_replace(t, r"(?U)[.\s]", "").rlike(r"\P{L}") & ~suffix
    return F.when(has_hint(t, C.COMPANY_HINTS), 28.0).otherwise(8.0) + F.when(is_upper(t), 18.0).otherwise(9.0) + F.when(suffix, 25.0).otherwise(0.0) - F.when(person, 15.0).otherwise(0.0)


def companies(lines: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    t = F.col("value")
    c = _not_claimed(ordered(lines).filter(may_be_company(t)), claimed)
    return _best(c.withColumn("score", company_points(t) + F.when(F.col("idx") <= 2, 8.0).otherwise(3.0) + alpha_ratio(t) * 14.0), "company", 0.35)


def titles(blocks: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    t = F.col("value")
    c = blocks.withColumns({"value": strip_trailing_punct(F.col("text")), "idx": F.col("block_id")})
    c = _not_claimed(c.filter(has_hint(t, C.JOB_HINTS)), claimed)
    score = F.when(has_hint(t, C.STRONG_JOB_HINTS), 30.0).otherwise(12.0) + F.when(F.col("n_lines") >= 2, 14.0).otherwise(8.0) + F.when(F.col("even"), 10.0).otherwise(4.0) + alpha_ratio(t) * 15.0
    w = card().orderBy(F.desc("score"), "idx")
    top = c.withColumn("score", score).withColumn("k", F.row_number().over(w)).filter("k = 1")
    return top.select("card_id", t.alias("title"), F.round(F.least(F.lit(0.99), 0.38 + F.col("score") / 100.0), 6).alias("title_confidence"), F.col("texts").alias("title_evidence"))


Validator = Callable[[Column], Column]
VALIDATORS: dict[str, Validator] = {
    "name": looks_like_name,
    "company": looks_like_company,
    # What trimming leaves of an address is valid if its last label begins with two letters.
    "email": lambda c: c.rlike(C.EMAIL_FULL) & c.rlike(r"(?i)@.*[a-z0-9-]\.[a-z]{2}[a-z0-9-]*$"),
    "phone": lambda c: digit_count(c).between(7, 15) & postal_region(c).isNull(),
    "website": lambda c: c.rlike(C.URL),
    "address": lambda c: postal_region(c).isNotNull() | ((alpha_ratio(c) >= 0.55) & (digit_count(c) >= 1)),
    "title": lambda c: has_hint(c, C.JOB_HINTS) & (alpha_ratio(c) >= 0.55),
}


def quality(records: DataFrame, validators: dict[str, Validator] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """``records`` with valid_* flags, quality_score and quality_badge: the weighted share of valid fields among those filled."""
    v, w = VALIDATORS | (validators or {}), C.QUALITY_WEIGHTS | (weights or {})
    out = records.withColumns({f"valid_{f}": F.when(F.coalesce(F.col(f), F.lit("")) != "", test(F.col(f))).otherwise(False) for f, test in v.items()})
    total = reduce(lambda a, b: a + b, (F.when(F.coalesce(F.col(f), F.lit("")) != "", w[f]).otherwise(0.0) for f in v))
    score = reduce(lambda a, b: a + b, (F.when(F.col(f"valid_{f}"), w[f]).otherwise(0.0) for f in v))
    out = out.withColumn("quality_score", F.round(F.when(total > 0, score / total).otherwise(0.0), 6))
    core = F.col("valid_name") | F.col("valid_company") | F.col("valid_email") | F.col("valid_phone")
    return out.withColumn("quality_badge", F.when((F.col("quality_score") >= 0.78) & core, "GREEN").when(F.col("quality_score") >= 0.52, "AMBER").otherwise("RED"))


def fuzzy_merge(lines: DataFrame, least: float = 75.0, metric: Likeness = lcs_ratio) -> DataFrame:
    """Lines without near copies, in a scan of each card's lines by (y, x).

    A line that overlaps a kept one in height and is like it by canonical text takes the
    place of the first such one if it is more faithful, and goes otherwise. The kept lines
    are a running state of a few entries, hence a fold. ``metric`` is the likeness of canonical texts.
    """
    item = F.struct("y1", "x1", "row_id", "y2", canonical(F.col("text")).alias("canon"), fidelity(F.col("text")).alias("fid"), F.struct(*lines.columns).alias("row"))
    cards = lines.groupBy("card_id").agg(F.array_sort(F.collect_list(item)).alias("scan"))

    def alike(a: Column, b: Column) -> Column:
        return F.when(F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"]), metric(a["canon"], b["canon"]) >= least).otherwise(False)

    def step(kept: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: alike(k, x)), True)
        return F.when(hit == 0, F.concat(kept, F.array(x))).otherwise(F.transform(kept, lambda k, i: F.when((i + 1 == hit) & (x["fid"] > k["fid"]), x).otherwise(k)))

    kept = F.aggregate(F.slice("scan", 2, 2147483646), F.slice("scan", 1, 1), step)
    return of_card(cards.select("card_id", F.explode(kept).alias("k")), "k.row", lines.columns)


def clean_value(c: Column) -> Column:
    return repair_digits(normalize_spaces(c))
