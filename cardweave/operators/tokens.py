"""From tokens to lines and blocks: geometry, de-duplication, rows, line text, blocks.

Everything is keyed by ``card_id``; tables are hashed on it once and the windows and
groupings on (card_id, ...) keep that partitioning. Folds over a card's tokens are
higher-order functions on arrays of at most a few hundred entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cardweave.functions import constants as C
from cardweave.functions.text import canonical, collapse_spaced_letters, has_hint, letters, normalize_spaces, strip_trailing_punct, word_of_line

#: A card's arrays hold at most so many tokens; more are an error, and a page for ``operators.pages``.
MAX_TOKENS_PER_CARD = 20_000


def guarded(n: Column, value: Column) -> Column:
    return F.when(n > MAX_TOKENS_PER_CARD, F.raise_error(F.lit(f"a card has more than {MAX_TOKENS_PER_CARD} tokens: use the operators of pages"))).otherwise(value)


def card() -> WindowSpec:
    return Window.partitionBy("card_id")


def of_card(df: DataFrame, struct: str, names: list[str], *more: Column) -> DataFrame:
    """The columns ``names`` of a struct, but ``card_id``, which stays the column that rows are dealt by: a field of the struct would be dealt again."""
    return df.select(*(F.col(n) if n == "card_id" else F.col(f"{struct}.{n}") for n in names), *more)


def geometry(tokens: DataFrame) -> DataFrame:
    """Corners, sizes of 1 at least, centres, and width of a character."""
    corner = lambda agg, k: agg(F.transform("box", lambda p: p[k]))
    t = tokens.withColumns({"x1": corner(F.array_min, 0), "y1": corner(F.array_min, 1), "x2": corner(F.array_max, 0), "y2": corner(F.array_max, 1)})
    t = t.withColumns({"width": F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")), "height": F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")), "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    n = letters(F.col("text"))
    return t.withColumn("char_width", F.col("width") / F.when(n > 0, n).otherwise(F.greatest(F.lit(1), F.length("text"))))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: F.greatest(F.lit(1.0), r["x2"] - r["x1"]) * F.greatest(F.lit(1.0), r["y2"] - r["y1"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    return inter / F.greatest(F.lit(1.0), area(a) + area(b) - inter)


def _corners(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x1", "y1", "x2", "y2")}


def overlap_pairs(tokens: DataFrame, least: float = C.IOU_MIN) -> DataFrame:
    """(card_id, a, b, iou): tokens of a card with one canonical text whose boxes overlap, a < b."""
    t = geometry(tokens).withColumn("canon", canonical(F.col("text"))).select("card_id", "canon", "tok_idx", "x1", "y1", "x2", "y2")
    a, b = (t.select("card_id", "canon", F.col("tok_idx").alias(p + "idx"), *(F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2"))) for p in ("a_", "b_"))
    # What a plan takes rows of exploded arrays to weigh is far too little, so no side may be broadcast by it.
    met = a.hint("merge").join(b, ["card_id", "canon"]).filter("a_idx < b_idx").withColumn("iou", iou(_corners("a_"), _corners("b_")))
    return met.filter(F.col("iou") >= least).select("card_id", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), F.round("iou", 6).alias("iou"))


def dedupe(tokens: DataFrame, least: float = C.IOU_MIN) -> DataFrame:
    """The tokens that stay when each, in the order of (y, x, score down), meets those kept before.

    A token that overlaps a kept twin (same canonical text) takes its place if its
    score is higher, and goes otherwise. Twins share (card, canonical text), so the
    scan is one fold over each such small group.
    """
    t = geometry(tokens).withColumn("canon", canonical(F.col("text")))
    names = [f.name for f in tokens.schema]
    item = F.struct("y1", "x1", (-F.col("score")).alias("down"), "tok_idx", "x2", "y2", F.struct(*names).alias("row"))
    groups = t.groupBy("card_id", "canon").agg(guarded(F.count("*"), F.array_sort(F.collect_list(item))).alias("scan"))
    box = lambda s: {k: s[k] for k in ("x1", "y1", "x2", "y2")}

    def step(kept: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: iou(box(k), box(x)) >= least), True)
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == hit) & (x["down"] < k["down"]), x).otherwise(k))
        return F.when(hit == 0, F.concat(kept, F.array(x))).otherwise(swapped)

    kept = F.aggregate(F.slice("scan", 2, 2147483646), F.slice("scan", 1, 1), step)
    return of_card(groups.select("card_id", F.explode(kept).alias("k")), "k.row", names)


def card_stats(tokens: DataFrame) -> DataFrame:
    t = geometry(tokens)
    return t.groupBy("card_id").agg(
        F.count("*").alias("n_tokens"), F.coalesce(F.median("height"), F.lit(12.0)).alias("median_height"), F.round(F.coalesce(F.median("char_width"), F.lit(8.0)), 6).alias("median_char"),
        F.round(F.stddev_pop("char_width"), 6).alias("sd_char"), F.min("y1").alias("y_min"), F.max("y2").alias("y_max"),
    )


def cluster_rows(tokens: DataFrame, factor: float = 0.45, floor: float = 2.5, anchor: float | None = None) -> DataFrame:
    """``tokens`` with geometry and row_id.

    In the order of centres a token joins the row while it is within the tolerance of
    the row's mean centre; with ``anchor`` the tolerance is that number and the row's
    first token is the reference. The mean is a running state, hence a fold.
    """
    t = geometry(tokens)
    names = t.columns
    item = F.struct("cy", "x1", "tok_idx", F.struct(*names).alias("row"))
    cards = t.groupBy("card_id").agg(guarded(F.count("*"), F.array_sort(F.collect_list(item))).alias("scan"), F.median("height").alias("h"))
    tol = F.greatest(F.lit(floor), factor * F.coalesce("h", F.lit(12.0))) if anchor is None else F.lit(anchor)
    state = "struct<n:double,total:double,row_id:int,ids:array<int>>"
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("total"), F.lit(-1).alias("row_id"), F.array().cast("array<int>").alias("ids")).cast(state)

    def step(s: Column, x: Column) -> Column:
        same = (s["n"] > 0) & (F.abs(x["cy"] - s["total"] / F.greatest(s["n"], F.lit(1.0))) <= F.col("tol"))
        row = F.when(same, s["row_id"]).otherwise(s["row_id"] + 1)
        if anchor is None:
            n, total = F.when(same, s["n"] + 1).otherwise(1.0), F.when(same, s["total"] + x["cy"]).otherwise(x["cy"])
        else:
            n, total = F.lit(1.0), F.when(same, s["total"]).otherwise(x["cy"])
        return F.struct(n.alias("n"), total.alias("total"), row.alias("row_id"), F.concat(s["ids"], F.array(row)).alias("ids")).cast(state)

    ids = F.aggregate("scan", start, step, lambda s: s["ids"])
    cards = cards.withColumn("tol", tol).select("card_id", "scan", ids.alias("ids"))
    rows = cards.select("card_id", F.explode(F.arrays_zip("scan", "ids")).alias("z"))
    return of_card(rows, "z.scan.row", names, F.col("z.ids").alias("row_id"))


def compose_lines(rows: DataFrame) -> DataFrame:
    """(card_id, row_id, text, x1, y1, x2, y2, height, char_median, source_passes) from tokens with row_id.

    Each token is cleaned (``word_of_line``); those left empty have no part in the text. A gap of at
    most 0.45 of the row's character width glues tokens if one of them has at most two
    characters or the left one ends in "-"; else they are set apart by a space. Of the whole, spaces are
    made single, single characters set apart are joined, and stops at the end go. The words of a row are an
    array, so a fold joins them where a window would sort and shuffle once more.
    """
    width = F.when(F.trim("text") != "", F.col("width") / F.greatest(F.lit(1), F.length(normalize_spaces(F.col("text")))))
    r = rows.select("card_id", "row_id", "pass_name", "x1", "y1", "x2", "y2", "cy", "tok_idx", width.alias("_char"), word_of_line(F.col("text")).alias("_word"))
    word = F.when(F.col("_word") != "", F.struct("x1", "cy", "tok_idx", "x2", F.col("_word").alias("w")))
    lines = r.groupBy("card_id", "row_id").agg(
        F.array_sort(F.collect_list(word)).alias("_words"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.greatest(F.lit(1.0), F.max("y2") - F.min("y1")).alias("height"), F.coalesce(F.median("_char"), F.lit(8.0)).alias("char_median"), F.array_sort(F.collect_set("pass_name")).alias("source_passes"),
    )

    def joined(x: Column, i: Column) -> Column:
        before = F.get("_words", i - 1)
        small = (F.length(x["w"]) <= 2) | (F.length(before["w"]) <= 2) | before["w"].endswith("-")
        glue = (i == 0) | ((x["x1"] - before["x2"] <= 0.45 * F.col("char_median")) & small)
        return F.concat(F.when(glue, "").otherwise(" "), x["w"])

    lines = lines.withColumn("_text", collapse_spaced_letters(normalize_spaces(F.array_join(F.transform("_words", joined), ""))))
    return lines.select("card_id", "row_id", strip_trailing_punct(F.col("_text")).alias("text"), "x1", "y1", "x2", "y2", "height", "char_median", "source_passes")


def layout_lines(tokens: DataFrame) -> DataFrame:
    """Tokens of all passes to lines: de-duplicated, clustered, composed."""
    return compose_lines(cluster_rows(dedupe(tokens)))


def merge_blocks(lines: DataFrame) -> DataFrame:
    """(card_id, block_id, text, texts, n_lines, first_height, even, y1, x1): lines that run on into each other.

    Only neighbours are compared, so blocks are islands between breaks.
    """
    order = card().orderBy("y1", "x1", "row_id")
    prev = lambda c: F.lag(c).over(order)
    median = F.median("height").over(card())
    gap = F.col("y1") - prev("y2")
    overlap = F.least("x2", prev("x2")) - F.greatest("x1", prev("x1"))
    span = F.greatest(F.lit(1.0), F.least(F.col("x2") - F.col("x1"), prev("x2") - prev("x1")))
    either = F.concat_ws(" ", prev("text"), F.col("text"))
    joined = (
        (gap <= F.greatest(F.lit(2.0), 0.35 * median)) & (F.abs(F.col("height") - prev("height")) <= 0.25 * F.greatest("height", prev("height")))
        & (overlap / span > 0.55) & ~F.col("text").contains("@") & ~prev("text").contains("@") & ~(has_hint(either, C.COMPANY_HINTS) & has_hint(either, C.JOB_HINTS))
    )
    marked = lines.withColumn("start", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    blocks = marked.withColumn("block_id", (F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("y1", "x1", "row_id", "text", "height")))
    out = blocks.groupBy("card_id", "block_id").agg(ordered.alias("lines"))
    first = F.col("lines")[0]
    return out.select(
        "card_id", "block_id", F.array_join(F.transform("lines", lambda s: s["text"]), " ").alias("text"), F.transform("lines", lambda s: s["text"]).alias("texts"), F.size("lines").alias("n_lines"),
        first["height"].alias("first_height"), F.forall("lines", lambda s: s["height"] <= first["height"] * 1.35).alias("even"), first["y1"].alias("y1"), first["x1"].alias("x1"),
    )


def lines_as_layout(lines: DataFrame) -> DataFrame:
    """Plain numbered lines (card_id, line_no, text) as layout lines, one under the other."""
    y = F.col("line_no") * 30.0
    return lines.select("card_id", F.col("line_no").cast("int").alias("row_id"), "text", F.lit(0.0).alias("x1"), y.alias("y1"), (8.0 * F.length("text")).alias("x2"), (y + 20.0).alias("y2"), F.lit(20.0).alias("height"), F.lit(8.0).alias("char_median"))
