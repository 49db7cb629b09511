"""Layout-only extraction: row features, roles, reading order, prominent fields, flat presets, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cardweave.functions import constants as C
from cardweave.functions.text import digit_count, has_hint, is_title, is_upper, let, letters, normalize_spaces, spaced_letters, word_count
from cardweave.functions.similarity import Likeness, confusion_likeness, lcs_ratio
from cardweave.operators.extract import numbering
from cardweave.operators.tokens import cluster_rows, geometry, of_card

# Scripts by code-point range; other letters are Latin.
SCRIPTS = {"cjk": r"[\u4e00-\u9fff]", "arabic": r"[\u0600-\u06ff]", "devanagari": r"[\u0900-\u097f]"}
# Patterns and keyword lists of the flat presets.
FLAT_EMAIL, FLAT_WEB = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(?:https?://)?(?:www\.)?[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DESIGNATIONS = "ceo cto founder engineer manager director developer consultant analyst".split()
LABEL_JOBS = "manager developer engineer director partner consultant founder ceo cto analyst lead specialist head officer executive".split()
LABEL_COMPANIES = "ltd inc solutions consulting studio tech group company labs buildsmart urbanedge".split()
LABEL_PLACES = "road street complex floor level nagar city park tower building block ahmedabad surat mumbai pune bangalore delhi".split()


# Profiles of each platform, and bare handles.
PROFILES = {"linkedin": r"(?i)(linkedin\.com/in/[\w\-]+|/in/[\w\-]{3,100})", "github": r"(?i)(github\.com/[\w\-]+)", "twitter": r"(?i)((?:twitter|\bx)\.com/\w+)", "instagram": r"(?i)(instagram\.com/[\w.]+)"}
AT_HANDLE = r"(?<![A-Za-z0-9])@([\w.]{2,32})"


def card() -> WindowSpec:
    return Window.partitionBy("card_id")


def features(lines: DataFrame) -> DataFrame:
    t, n = F.col("text"), F.greatest(F.lit(1), F.length("text"))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / F.greatest(F.lit(1), F.size(words))
    return lines.withColumns({
        "word_count": word_count(t), "has_digit": digit_count(t) > 0, "digit_density": digit_count(t) / n,
        "punct_density": F.regexp_count(t, F.lit(r"[,./\-#@:;]")) / n, "alpha_density": letters(t) / n,
        "all_caps": is_upper(t), "title_case": (F.size(words) > 0) & (titled >= 0.6), "separators": F.regexp_count(t, F.lit(r"[,/|\\]")),
    })


def shapes(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    digits = F.length(F.regexp_replace(F.regexp_extract(t, C.PHONE_RUN, 0), r"\D", ""))
    return lines.withColumns({"is_email": t.rlike(C.EMAIL_SHAPE), "is_phone": digits.between(7, 15), "is_web": t.rlike(C.WEB_SHAPE), "is_postal": t.rlike(C.POSTAL_SHAPE), "is_social": t.rlike(C.SOCIAL_SHAPE) | t.rlike(r"(?<![A-Za-z0-9])@([\w.]{2,32})")})


def script_histogram(lines: DataFrame) -> DataFrame:
    """(card_id, primary, secondary, n_letters): the commonest script, and the next one if it has 15 % or more.

    Every character of a range counts, marks and digits too; letters outside the ranges are Latin.
    """
    counts = {s: F.sum(F.regexp_count("text", F.lit(p))) for s, p in SCRIPTS.items()}
    other = F.sum(letters(F.regexp_replace("text", r"[\u4e00-\u9fff\u0600-\u06ff\u0900-\u097f]", "")))
    c = lines.groupBy("card_id").agg(*(v.alias(s) for s, v in counts.items()), F.sum(letters(F.col("text"))).alias("all"), other.alias("latin"))
    pairs = F.array(*(F.struct((-F.col(s)).alias("n"), F.lit(r).alias("r"), F.lit(s).alias("s")) for r, s in enumerate(("latin", *SCRIPTS))))
    total = F.greatest(F.lit(1), F.col("latin") + F.col("cjk") + F.col("arabic") + F.col("devanagari"))
    c = c.withColumn("p", F.array_sort(pairs)).withColumn("total", total)
    second = F.coalesce(F.get(F.filter(F.slice("p", 2, 3), lambda x: -x["n"] >= 0.15 * F.col("total")), F.lit(0))["s"], F.lit(""))
    return c.select("card_id", F.col("p")[0]["s"].alias("primary"), second.alias("secondary"), F.col("all").cast("long").alias("n_letters"))


def reconstruct_rows(tokens: DataFrame, gap_factor: float = 2.2) -> DataFrame:
    """Rows with text glued where the gap is small, centre, extent, median height and mean confidence.

    Tokens join without a space if the gap is at most ``gap_factor`` of the row's character
    width and their centres are level, or if they overlap by 0.15 of what they span.
    """
    t = cluster_rows(tokens, 0.5, 8.0)
    w = Window.partitionBy("card_id", "row_id")
    order = w.orderBy("x1", "cy", "tok_idx")
    before = lambda c: F.lag(c).over(order)
    char = F.median("char_width").over(w)
    gap = F.col("x1") - before("x2")
    slope = F.abs(F.degrees(F.atan2(F.col("cy") - before("cy"), F.greatest(F.col("cx") - before("cx"), F.lit(0.001)))))
    shared = F.greatest(F.lit(0.0), F.least("x2", before("x2")) - F.greatest("x1", before("x1")))
    span = F.greatest("x2", before("x2")) - F.least("x1", before("x1"))
    glue = ((gap <= gap_factor * char) & (slope <= 3.0)) | ((span > 0) & (shared >= 0.15 * span))
    t = t.withColumn("part", F.concat(F.when(gap.isNull() | F.coalesce(glue, F.lit(False)), "").otherwise(" "), F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "cy", "tok_idx", "part"))), lambda s: s["part"]), "")
    return t.groupBy("card_id", "row_id").agg(
        normalize_spaces(F.regexp_replace(text, r"(.)\1{3,}", "$1$1")).alias("text"), F.avg("cy").alias("y_center"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"),
        F.median("height").alias("height"), F.avg("score").alias("confidence"), F.median("char_width").alias("char_median"), F.collect_list("height").alias("heights"),
    )


def card_corpus(rows: DataFrame) -> DataFrame:
    """(card_id, corpus, n_lines, confidence): all row texts in order, and the mean of the rows' confidences."""
    ordered = F.array_sort(F.collect_list(F.struct("row_id", "text")))
    return rows.groupBy("card_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("corpus"), F.count("*").cast("int").alias("n_lines"), F.round(F.avg("confidence"), 6).alias("confidence"))


def fuzzy_rows(rows: DataFrame, least: float = 80.0, metric: Likeness = lcs_ratio) -> DataFrame:
    """Rows without variants of others of their card: each row, in order, meets the later ones that are left.

    Of two that are alike, confusions counted, the one with more letters and fewer runs of one
    character stays, or the earlier. A row that loses is compared no further. What is left is a
    running state, hence a fold over the card's few rows. ``metric`` is the likeness of lower-cased texts.
    """
    score = letters(F.col("text")) - 3 * F.regexp_count("text", F.lit(r"(.)\1{2,}"))
    item = F.struct("row_id", "text", F.lower("text").alias("low"), score.alias("s"), F.struct(*rows.columns).alias("row"))
    cards = rows.groupBy("card_id").agg(F.array_sort(F.collect_list(item)).alias("scan")).withColumn("none", F.transform("scan", lambda x: F.lit(False)))

    def step(gone: Column, i: Column) -> Column:
        x = F.get("scan", i)
        # 0: not met; 1: the later row goes; 2: this one does.
        met = F.transform("scan", lambda y, j: F.when((j <= i) | F.get(gone, j) | (confusion_likeness(x["text"], y["text"], metric(x["low"], y["low"])) < least), 0).when((x["s"] >= y["s"]) | (x["text"] == y["text"]), 1).otherwise(2))
        met = F.array(met)  # worked out once
        after = F.get(F.transform(met, lambda m: F.struct(m.alias("m"), F.array_position(m, 2).alias("lost"))), F.lit(0))
        marked = F.get(F.transform(F.array(after), lambda a: F.transform(gone, lambda g, j: g | ((j == i) & (a["lost"] > 0)) | ((F.get(a["m"], j) == 1) & ((a["lost"] == 0) | (j + 1 < a["lost"]))))), F.lit(0))
        return F.when(F.get(gone, i), gone).otherwise(marked)

    gone = F.aggregate(F.sequence(F.lit(0), F.size("scan") - 1), F.col("none"), step)
    kept = cards.select("card_id", "scan", gone.alias("gone")).select("card_id", F.explode(F.filter("scan", lambda x, i: ~F.get(F.col("gone"), i))).alias("k"))
    return of_card(kept, "k.row", rows.columns)


def fuse_blocks(rows: DataFrame) -> DataFrame:
    """(card_id, block_id, text, y_center, x1, x2, height, confidence): rows near below each other, of like height, that overlap.

    Each row is compared with the one before, so blocks are islands between breaks. Centre,
    height and confidence are those of all tokens (``heights`` of each row, one if there is none).
    """
    rows = rows if "heights" in rows.columns else rows.withColumn("heights", F.array("height"))
    order = card().orderBy("y_center", "x1", "row_id")
    prev = lambda c: F.lag(c).over(order)
    ratio = F.col("height") / F.greatest(F.lit(1.0), prev("height"))
    overlap = F.greatest(F.lit(0.0), F.least("x2", prev("x2")) - F.greatest("x1", prev("x1")))
    span = F.greatest(F.lit(1.0), F.least(F.col("x2") - F.col("x1"), prev("x2") - prev("x1")))
    joined = (F.col("y_center") - prev("y_center") <= 1.8 * prev("height")) & ratio.between(0.7, 1.3) & (overlap / span >= 0.30)
    marked = rows.withColumn("start", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("n", F.size("heights"))
    blocks = marked.withColumn("block_id", (F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y_center", "x1", "row_id", "text"))), lambda s: s["text"]), " ")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    out = blocks.groupBy("card_id", "block_id").agg(
        text.alias("text"), mean("y_center").alias("y_center"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.array_sort(F.flatten(F.collect_list("heights"))).alias("h"), mean("confidence").alias("confidence"),
    )
    half = F.floor((F.size("h") - 1) / 2).cast("int")
    return out.withColumn("height", (F.get("h", half) + F.get("h", F.size("h") - 1 - half)) / 2).drop("h")


def prominence(rows: DataFrame) -> DataFrame:
    """tps: height against the card's median; pos: place between top and bottom."""
    low, high = F.min("y_center").over(card()), F.max("y_center").over(card())
    return rows.withColumns({"tps": F.col("height") / F.greatest(F.lit(1.0), F.median("height").over(card())), "pos": F.when(high > low, (F.col("y_center") - low) / (high - low)).otherwise(0.5)})


def roles(rows: DataFrame) -> DataFrame:
    """Role and its score: contact roles by shape, else the best of address, name, title, company over 5."""
    r = prominence(shapes(features(rows)))
    on = lambda c, v: F.when(c, float(v)).otherwise(0.0)
    n, pos = F.col("word_count"), F.col("pos")
    address = on(F.col("is_postal"), 30) + on(F.col("digit_density") > 0.20, 15) + on(F.col("punct_density") > 0.12, 12) + on(F.col("separators") >= 2, 10) + on(pos > 0.60, 8) + on(n > 4, 5)
    prom = 20 * F.col("tps") + 15 * (1 - pos) + on(F.col("all_caps"), 8) + on(F.col("title_case"), 6) + on(F.col("has_digit"), -10) + on(F.col("alpha_density") > 0.80, 5) + on(F.col("confidence") > 0.80, 3)
    name = prom + on(~n.between(1, 5), -15) + on(pos > 0.50, -12) + on(F.col("digit_density") > 0.05, -20)
    title = 0.85 * prom + on(~n.between(1, 8), -10) + on(pos > 0.70, -10) + on(F.col("has_digit"), -12)
    company = 0.80 * prom + on(F.col("all_caps"), 10) + on(n > 8, -8)
    best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-k).alias("k"), F.lit(x).alias("role")) for k, (x, s) in enumerate((("address", address), ("name", name), ("title", title), ("company", company))))))
    hard = F.when(F.col("is_email"), F.struct(F.lit("email").alias("role"), F.lit(100.0).alias("s"))).when(F.col("is_phone"), F.struct(F.lit("phone").alias("role"), F.lit(100.0).alias("s"))).when(F.col("is_web"), F.struct(F.lit("web").alias("role"), F.lit(90.0).alias("s"))).when(F.col("is_social"), F.struct(F.lit("social").alias("role"), F.lit(85.0).alias("s")))
    r = r.withColumn("b", best).withColumn("h", hard)
    return r.withColumn("role", F.coalesce("h.role", F.when(F.col("b.s") > 5.0, F.col("b.role")).otherwise("unknown"))).withColumn("role_score", F.round(F.coalesce("h.s", "b.s"), 6)).drop("b", "h")


def reading_order(rows: DataFrame, least: float = 0.25) -> DataFrame:
    """(card_id, src, dst): edges to lower rows whose x-overlap is a quarter of the upper row's width."""
    a, b = (rows.select("card_id", *(F.col(c).alias(f"{p}_{c}") for c in ("row_id", "x1", "x2", "y_center"))) for p in "ab")
    over = (F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) / F.greatest(F.lit(1.0), F.col("a_x2") - F.col("a_x1"))
    # What a plan takes rows of exploded arrays to weigh is far too little, so no side may be broadcast by it.
    return a.hint("merge").join(b, "card_id").filter((F.col("a_row_id") < F.col("b_row_id")) & (F.col("b_y_center") > F.col("a_y_center")) & (over >= least)).select("card_id", F.col("a_row_id").alias("src"), F.col("b_row_id").alias("dst"))


def within_hops(edges: DataFrame, targets: DataFrame, hops: int, up: bool = True) -> DataFrame:
    """(card_id, row_id): ancestors (or descendants) of the targets within that many hops.

    A fold over the hops for each card: its state is the rows met so far and the newest of them, so a row met on many
    paths is taken once. The edges of a card are read once, and a card is one row however many hops there are; a recursive
    query has a bound on the rows of all its cards.
    """
    here, there = ("dst", "src") if up else ("src", "dst")
    ids = f"array<{dict(targets.dtypes)['row_id']}>"
    graph = edges.groupBy("card_id").agg(F.collect_set(F.struct(F.col(here).alias("here"), F.col(there).alias("there"))).alias("edges"))
    cards = targets.groupBy("card_id").agg(F.collect_set("row_id").alias("front")).hint("merge").join(graph, "card_id")
    state = f"struct<front:{ids},seen:{ids}>"

    def step(s: Column, _: Column) -> Column:
        reached = F.array_distinct(F.transform(F.filter("edges", lambda e: F.array_contains(s["front"], e["here"])), lambda e: e["there"]))
        return let(reached, lambda r: F.struct(F.array_except(r, s["seen"]).alias("front"), F.array_union(s["seen"], r).alias("seen"))).cast(state)

    start = F.struct(F.col("front"), F.array().cast(ids).alias("seen")).cast(state)
    return cards.select("card_id", F.explode(F.aggregate(F.array_repeat(F.lit(0), hops), start, step, lambda s: s["seen"])).alias("row_id"))


def prominent_fields(rows: DataFrame) -> DataFrame:
    """(card_id, name, company, title) from rows with roles; each choice is closed to the later ones.

    Rows are dealt by card, and each choice is the greatest of a card's candidates, so nothing is broadcast
    and what may not be taken again is compared, not joined.
    """
    anchors = rows.filter(F.col("role").isin("email", "phone"))
    near = within_hops(reading_order(rows), anchors, 3).groupBy("card_id").agg(F.collect_set("row_id").alias("near"))
    on = lambda x, v: F.when(x, float(v)).otherwise(0.0)
    c = rows.hint("merge").join(near, "card_id", "left").withColumn("near", F.coalesce(F.array_contains("near", F.col("row_id")), F.lit(False)))
    c = c.withColumn("score", F.col("role_score") + on(F.col("near"), 18) + on(F.col("pos") < 0.35, 10) + 12 * F.col("tps") + 6 * F.col("confidence"))
    c = c.withColumn("may", F.col("role").isin("name", "title", "company") | ((F.col("role") == "unknown") & (F.col("pos") < 0.4)))

    def pick(test: Column, *order: str) -> Column:
        rank = F.struct(*order, (-F.col("row_id")).alias("k"), "text")
        return F.max(F.when(F.col("may") & test, rank)).over(card())["text"]

    other = lambda name: ~F.coalesce(F.col("text") == F.col(name), F.lit(False))
    c = c.withColumn("name", pick(~F.col("has_digit") & F.col("word_count").between(1, 5) & (F.col("pos") < 0.50), "score"))
    c = c.withColumn("company", pick(other("name"), "all_caps", "tps", "score"))
    c = c.withColumn("title", pick(other("name") & other("company"), "score"))
    return c.groupBy("card_id").agg(*(F.first(f).alias(f) for f in ("name", "company", "title")))


def first_email(lines: DataFrame, pattern: str = C.EMAIL_SHAPE, lower: bool = True) -> DataFrame:
    """(card_id, email): the first address in a card's lines as they are written."""
    found = lines.withColumn("email", F.regexp_extract("text", pattern, 0)).filter("email != ''")
    return found.groupBy("card_id").agg(F.min_by(F.lower("email") if lower else F.col("email"), "line_no").alias("email"))


def websites(lines: DataFrame, emails: DataFrame) -> DataFrame:
    """The first web-like text of a card without "@" that neither holds the email's domain nor is a postal code."""
    c = lines.select("card_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(C.WEB_SHAPE), F.lit(0))).alias("pos", "web"))
    c = c.join(emails, "card_id", "left").withColumn("domain", F.substring_index("email", "@", -1))
    ok = ~F.col("web").contains("@") & ~F.col("web").rlike(r"^\d{4,7}$") & (F.col("domain").isNull() | ~F.lower("web").contains(F.col("domain")))
    return c.filter(ok).groupBy("card_id").agg(F.min_by("web", F.struct("line_no", "pos")).alias("website"))


def social_profiles(lines: DataFrame) -> DataFrame:
    """First profile of each platform on a card; bare handles fill twitter, then instagram."""
    pats = PROFILES
    rows = lines.select("card_id", "line_no", *(F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias(s) for s, p in pats.items()), F.regexp_extract_all("text", F.lit(AT_HANDLE), F.lit(1)).alias("at"))
    out = rows.groupBy("card_id").agg(*(F.min(F.when(F.col(s).isNotNull(), F.struct("line_no", F.col(s).alias("v")))).alias(s) for s in pats), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "at"))), lambda x: x["at"])).alias("at"))
    t, i = F.col("twitter.v"), F.col("instagram.v")
    at = lambda k: F.when(F.size("at") > k, F.concat(F.lit("@"), F.col("at")[k]))
    return out.select("card_id", F.col("linkedin.v").alias("linkedin"), F.col("github.v").alias("github"), F.coalesce(t, at(0)).alias("twitter"), F.coalesce(i, F.when(t.isNull(), at(1)).otherwise(at(0))).alias("instagram"))


def phones_by_layout(rows: DataFrame, most: int = 5) -> DataFrame:
    """(card_id, rank, phone): digit runs of rows whose role is none of mail, web, address and profile.

    Digits of postal codes in address rows and rows of postal shape are blocked. A number with
    a calling code that fits takes its international form, in a row before the others; of equal
    digits the first stays.
    """
    postal = rows.filter((F.col("role") == "address") | F.col("is_postal")).select("card_id", F.explode(F.regexp_extract_all("text", F.lit(C.POSTAL_SHAPE), F.lit(0))).alias("code"))
    postal = postal.select("card_id", F.regexp_replace("code", r"\D", "").alias("digits")).distinct()
    free = rows.filter(~F.col("role").isin("email", "web", "address", "social"))
    found = free.select("card_id", "row_id", F.posexplode(F.regexp_extract_all("text", F.lit(C.PHONE_RUN), F.lit(0))).alias("pos", "raw"))
    found = found.withColumns({"raw": F.trim("raw"), "plan": numbering(F.trim("raw"))}).withColumns({"phone": F.coalesce("plan.number", "raw"), "plain": F.col("plan").isNull()}).withColumn("digits", F.regexp_replace("phone", r"\D", ""))
    found = found.filter(F.length("digits").between(7, 15)).join(postal, ["card_id", "digits"], "left_anti")
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("card_id", "digits").orderBy("row_id", "plain", "pos"))).filter("k = 1")
    return first.withColumn("rank", F.row_number().over(card().orderBy("row_id", "plain", "pos"))).filter(F.col("rank") <= most).select("card_id", "rank", "phone")


def pivot_phones(found: DataFrame) -> DataFrame:
    return found.filter("rank <= 3").groupBy("card_id").agg(*(F.max(F.when(F.col("rank") == k, F.col("phone"))).alias(f"phone_{k}") for k in (1, 2, 3)))


def filled_badge(records: DataFrame, fields: tuple[str, ...], green: int, yellow: int) -> DataFrame:
    n = reduce(lambda a, b: a + b, (F.when(F.coalesce(F.col(f), F.lit("")) != "", 1).otherwise(0) for f in fields))
    return records.withColumn("filled", n).withColumn("badge", F.when(F.col("filled") >= green, "GREEN").when(F.col("filled") >= yellow, "YELLOW").otherwise("RED"))


def clean_tokens(lines: DataFrame) -> DataFrame:
    """``lines`` with the spaces around "@" and "." gone, spaced capitals joined, and pairs of capital words glued."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?U)\s+@\s+", "@"), r"(?U)\s+\.\s+", ".")
    t = F.when(t.rlike(r"(?U)^(?:[A-Z]\s+){2,}[A-Z]$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)
    return lines.withColumn("text", F.regexp_replace(t, r"(?U)([A-Z]{2,})\s+([A-Z]{2,})", "$1$2"))


def flat_simple(lines: DataFrame, profiles: bool = False) -> DataFrame:
    """(card_id, name, title, company, email, website, phone, address, linkedin, twitter, filled, badge): from cleaned lines, the first line or match that fits each field.

    Companies and addresses are told by their hints, where the entity model would be. The badge counts nine
    fields; with ``profiles`` the last two of them are the card's profiles, and without they stay
    empty, as the preset has it.
    """
    lines = clean_tokens(lines)
    t = F.col("text")
    mail = first_email(lines, FLAT_EMAIL, lower=False)
    web = lines.select("card_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(FLAT_WEB), F.lit(0))).alias("pos", "website"))
    web = web.groupBy("card_id").agg(F.min_by("website", F.struct("line_no", "pos")).alias("website"))
    social = social_profiles(lines).select("card_id", *(F.col(c) if profiles else F.lit(None).cast("string").alias(c) for c in ("linkedin", "twitter")))
    numbers = lines.select("card_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(C.PHONE_RUN), F.lit(0))).alias("pos", "raw")).withColumn("phone", numbering(F.trim("raw"))["number"])
    phone = numbers.filter("phone is not null").groupBy("card_id").agg(F.min_by("phone", F.struct("line_no", "pos")).alias("phone"))
    first = lambda test, name: lines.filter(test).groupBy("card_id").agg(F.min_by("text", "line_no").alias(name))
    out = lines.select("card_id").distinct()
    fields = (
        first(word_count(t).between(2, 3) & (is_upper(t) | is_title(t)), "name"), first(has_hint(t, DESIGNATIONS), "title"),
        first(has_hint(t, C.COMPANY_HINTS) & ~t.contains("@"), "company"), mail, web, phone, social, first(has_hint(t, C.ADDRESS_HINTS) & (digit_count(t) > 0) & ~t.contains("@"), "address"),
    )
    for part in fields:
        out = out.join(part, "card_id", "left")
    return filled_badge(out, ("name", "title", "company", "email", "website", "phone", "address", "linkedin", "twitter"), 6, 3)


def flat_labelled(lines: DataFrame) -> DataFrame:
    """(card_id, name, phone, email, company, address): labels stripped, last email and phone win, company by keyword."""
    t = F.trim(F.regexp_replace(F.trim("text"), r"(?i)^(Mob|Ph|Email|Add|Web|M|E|A|W|P|Tel):", ""))
    for wrong, right in (("Toiver", "Tower"), ("lals", "labs"), ("ilow", "flow")):
        t = F.replace(t, F.lit(wrong), F.lit(right))
    l = lines.select("card_id", "line_no", t.alias("text"))
    t = F.col("text")
    person = word_count(t).between(2, 4) & (digit_count(t) == 0) & ~t.contains("@") & ~has_hint(t, LABEL_JOBS) & ~has_hint(t, LABEL_COMPANIES)
    rank = F.when(is_upper(t), 0).when(~t.rlike(r"(^|\s)[^\p{Lu}\s]"), 1)
    name = l.filter(person).withColumn("r", rank).filter("r is not null").groupBy("card_id").agg(F.min_by("text", F.struct("r", "line_no")).alias("name"))
    mail = F.lower(F.regexp_extract(F.replace(t, F.lit(" "), F.lit("")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0))
    number = F.regexp_replace(F.regexp_extract(t, r"(\+?\d[\d\s\-\(\)]{8,}\d)", 1), r"\D", "")
    l = l.withColumns({"mail": mail, "number": F.when(mail == "", number).otherwise("")})
    plain = l.filter("mail = '' and number = ''").join(name, "card_id", "left")
    firm = plain.filter(~t.contains("@") & (digit_count(t) == 0) & ~t.eqNullSafe(F.col("name")) & (has_hint(t, LABEL_COMPANIES) | ((word_count(t) >= 2) & ~has_hint(t, LABEL_JOBS)))).groupBy("card_id").agg(F.min_by("text", "line_no").alias("company"), F.min("line_no").alias("at"))
    # Lines of digits before the company are not looked at for addresses (quirk Q13).
    place = plain.join(firm.select("card_id", "at"), "card_id", "left").filter((has_hint(t, LABEL_PLACES) | t.rlike(r"\d{6}")) & ~(((digit_count(t) > 0) | t.eqNullSafe(F.col("name"))) & (F.col("at").isNull() | (F.col("line_no") < F.col("at")))))
    place = place.groupBy("card_id").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " | "), r"(\d{6})([A-Za-z])", "$1 $2").alias("address"))
    last = l.groupBy("card_id").agg(F.max_by("mail", F.when(F.col("mail") != "", F.col("line_no"))).alias("email"), F.max_by("number", F.when(F.col("number") != "", F.col("line_no"))).alias("number"))
    out = last.join(name, "card_id", "left").join(firm.drop("at"), "card_id", "left").join(place, "card_id", "left")
    return out.select(
        "card_id", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce(F.concat(F.lit("+91 "), F.right("number", F.lit(10))), F.lit("N/A")).alias("phone"),
        F.coalesce("email", F.lit("N/A")).alias("email"), F.coalesce("company", F.lit("N/A")).alias("company"), F.coalesce("address", F.lit("")).alias("address"),
    )


# Words that a name may not hold.
AUDIT_JOBS = "manager developer engineer director partner consultant founder ceo cto coo cfo analyst lead specialist head officer executive president associate senior junior principal architect vp vice intern trainee advisor coordinator supervisor assistant deputy md proprietor owner chairman trustee secretary treasurer".split()
AUDIT_COMPANIES = "ltd limited inc llp pvt private solutions consulting studio technologies tech group company labs services systems enterprises associates builders construction industries global international ventures holdings capital networks media digital infra infrastructure".split()
AUDIT_PLACES = "road street complex floor level nagar city park tower building block sector phase plot avenue lane colony society residency plaza centre center mall".split()


def candidate_flags(tokens: DataFrame, zone: float = 0.65) -> DataFrame:
    """(card_id, tok_idx, text, flags, in_zone, caps): why each token is no name, whether it is high enough, and its capitals."""
    t = geometry(tokens).withColumns({"low": F.lower("text"), "words": F.filter(F.split(F.trim("text"), r"(?U)\s+"), lambda w: w != "")})
    has = lambda words: F.exists("words", lambda w: F.lower(w).isin(*words))
    flags = F.array_compact(F.array(
        F.when(~F.size("words").between(1, 6), F.concat(F.lit("WORD_COUNT="), F.size("words").cast("string"))),
        F.when(~F.trim("text").rlike(r"^[A-Za-z\s.\-']+$"), F.lit("BAD_CHARS")), F.when(has(AUDIT_JOBS), F.lit("JOB_KEYWORD")), F.when(has(AUDIT_COMPANIES), F.lit("COMPANY_KEYWORD")),
        F.when(F.col("low").rlike("|".join(AUDIT_PLACES)), F.lit("ADDRESS_KEYWORD")), F.when(F.col("low").rlike(r"\.(com|in|org|net|co\.in)"), F.lit("EMAIL_PATTERN")),
    ))
    height = F.max(F.col("box")[2][1].cast("int")).over(card())
    caps = F.when(is_upper(F.col("text")), "CAPS").when(F.forall("words", lambda w: w.rlike(r"^\p{Lu}")), "Title").otherwise("mixed")
    return t.select("card_id", "tok_idx", "text", flags.alias("flags"), (F.col("y1") <= zone * height).alias("in_zone"), caps.alias("caps"))


def audit_lines(tokens: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """(card_id, row_id, n_tokens, joined, confidence, email): lines by a fixed tolerance, their tokens joined without spaces, and the mail address in them or in a token."""
    rows = cluster_rows(tokens, anchor=tolerance)
    compact = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    mail = lambda c: F.nullif(F.regexp_extract(c, r"(?i)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0), F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct("cy", "x1", "tok_idx", "text")))
    lines = rows.groupBy("card_id", "row_id").agg(parts.alias("p"), F.count("*").alias("n_tokens"), F.round(F.avg("score"), 6).alias("confidence"))
    lines = lines.withColumn("joined", compact(F.array_join(F.transform("p", lambda s: s["text"]), "")))
    alone = F.get(F.filter(F.transform("p", lambda s: mail(compact(s["text"]))), lambda m: m.isNotNull()), F.lit(0))
    return lines.select("card_id", "row_id", "n_tokens", "joined", "confidence", F.coalesce(mail(F.col("joined")), alone).alias("email"))


def token_audit(tokens: DataFrame, least: float = C.SURE_CONFIDENCE, tolerance: float = 18.0) -> DataFrame:
    """(card_id, kept, dropped, n_rows, confidence, spaced, n_mails, n_candidates): what a confidence threshold leaves, its lines, mails, and tokens that may be names."""
    split = tokens.groupBy("card_id").agg(F.sum((F.col("score") >= least).cast("int")).cast("long").alias("kept"), F.sum((F.col("score") < least).cast("int")).cast("long").alias("dropped"))
    sure = tokens.filter(F.col("score") >= least)
    lines = audit_lines(sure, tolerance).groupBy("card_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("email").isNotNull().cast("int")).cast("long").alias("n_mails"))
    spaced = spaced_letters(F.col("text"))
    own = sure.groupBy("card_id").agg(F.round(F.avg("score"), 6).alias("confidence"), F.sum(spaced.cast("int")).cast("long").alias("spaced"))
    names = candidate_flags(sure).groupBy("card_id").agg(F.sum((F.size("flags") == 0).cast("int")).cast("long").alias("n_candidates"))
    return split.join(lines, "card_id", "left").join(own, "card_id", "left").join(names, "card_id", "left")
