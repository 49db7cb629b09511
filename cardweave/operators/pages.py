"""Pages of very many tokens: pairs from grids, de-duplication by islands, reading order by strips.

A card's tokens are few, and its operators hold them in an array. A scanned page can have tens of thousands: here no
array and no list of all pairs of a page is made. Each operator has the result of its
counterpart for cards, whatever the size. Where a page is read from one row, so that a task has it whole,
its tokens are worked out there, in numpy, and nothing is dealt: two tokens for each word are many times the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardweave.functions import constants as C
from cardweave.functions.text import canonical, canonical_of
from cardweave.operators.tokens import dedupe, geometry, iou


#: Tokens that a task takes at once where pages stand together, and pages read from several rows up to which the others stay where they are.
AT_ONCE, SEVERAL = 200_000, 200_000
#: Texts that a task remembers at once, and characters of the longest of them.
REMEMBERED, LONGEST = 300_000, 64
CORNERS = ("x1", "y1", "x2", "y2")
#: Cells of a level are so many times as wide as those of the level below.
BASE = 4.0


def _level(size: Column) -> Column:
    """The first level whose cells are not smaller than a size."""
    return F.ceil(F.log(BASE, size)).cast("int")


def _side(level: Column) -> Column:
    return F.pow(F.lit(BASE), level)


def _cells(lo: str, size: str, least: float) -> Column:
    """structs of level and cell along an axis where a box meets any that overlaps it enough.

    Such a box is at least ``least`` and at most 1/least times as large, and begins within (1 - least) of
    the larger size. So both stand at the level of the larger, and there in the cell where the later one begins.
    """
    x, w = F.col(lo), F.col(size)
    own = _level(w)
    at = lambda level: F.transform(F.sequence(F.floor(x / _side(level)), F.floor((x + w * ((1 - least) / least)) / _side(level))), lambda c: F.struct(level.alias("level"), c.alias("cell")))
    return F.when(w / least > _side(own), F.concat(at(own), at(own + 1))).otherwise(at(own))


def overlaps(tokens: DataFrame, least: float = C.IOU_MIN) -> DataFrame:
    """(card_id, a, b, iou) as ``tokens.overlap_pairs``, for pages.

    Tokens meet in the cells of grids that fit their sizes: three or four rows a token, and of several cells that a pair
    shares the one where the later box begins, on the level of the larger, counts.
    """
    t = geometry(tokens).withColumn("canon", canonical(F.col("text"))).select("card_id", "canon", "tok_idx", *CORNERS, "width", "height")
    t = t.select("*", F.explode(_cells("x1", "width", least)).alias("gx")).select("*", F.explode(_cells("y1", "height", least)).alias("gy"))
    t = t.withColumn("key", F.xxhash64("card_id", "canon", "gx", "gy"))
    a, b = (t.select("key", *(F.col(c).alias(p + c) for c in ("card_id", "canon", "gx", "gy", "tok_idx", "x1", "y1", "x2", "y2", "width", "height"))) for p in ("a_", "b_"))
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("card_id", "canon", "gx", "gy")]
    for axis, size, lo in (("a_gx", "width", "x1"), ("a_gy", "height", "y1")):
        level = F.col(f"{axis}.level")
        same += [level == _level(F.greatest(f"a_{size}", f"b_{size}")), F.col(f"{axis}.cell") == F.floor(F.greatest(f"a_{lo}", f"b_{lo}") / _side(level))]
    met = a.join(b, "key").filter("a_tok_idx < b_tok_idx")
    for test in same:
        met = met.filter(test)
    box = lambda p: {k: F.col(p + k) for k in ("x1", "y1", "x2", "y2")}
    return met.withColumn("iou", iou(box("a_"), box("b_"))).filter(F.col("iou") >= least).select(F.col("a_card_id").alias("card_id"), F.col("a_tok_idx").alias("a"), F.col("b_tok_idx").alias("b"), F.round("iou", 6).alias("iou"))


def _islands(df: DataFrame, keys: list[str], lo: str, hi: str, name: str) -> DataFrame:
    """Numbers the islands of spans along an axis: a span that begins beyond all before it begins a new one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi, "tok_idx")
    reached = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(lo) < reached, 0).otherwise(1))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dedupe_pages(tokens: DataFrame, least: float = C.IOU_MIN) -> DataFrame:
    """The tokens that ``tokens.dedupe`` keeps, for pages.

    Tokens meet only where their boxes do, so equal texts of a page are first parted into
    islands along y, these along x, and each island is a card of its own to the fold.
    """
    names = tokens.columns
    g = geometry(tokens).withColumn("_canon", canonical(F.col("text")))
    g = _islands(_islands(g, ["card_id", "_canon"], "y1", "y2", "_row"), ["card_id", "_canon", "_row"], "x1", "x2", "_part")
    alone = g.select(F.struct("card_id", "_row", "_part").alias("card_id"), *(F.col(c) if c != "card_id" else F.col("card_id").alias("_page") for c in names))
    kept = dedupe(alone, least)
    return kept.select(*(F.col("_page").alias("card_id") if c == "card_id" else F.col(c) for c in names))


def _page_by_page(work: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on whole pages: rows are held until the page that they belong to is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, AT_ONCE
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            page = table["card_id"].to_numpy()
            ends = np.flatnonzero(page[1:] != page[:-1])
            over = int(ends[-1]) + 1 if len(ends) else 0
            if over:
                yield work(table.slice(0, over))
            rest = table.slice(over).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
            enough = max(AT_ONCE, 2 * rows)  # a page larger than that is not copied with each batch
        if rows:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


class _Canonical(dict):
    """Canonical texts that a task has met, as many as ``REMEMBERED``."""

    def __missing__(self, text: str) -> str:
        out = canonical_of(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = out
        return out


def _met(t: pa.Table, least: float, known: _Canonical) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of two tokens of a page and canonical text whose boxes overlap enough, and by how much: islands along y, in them a sweep along x."""
    page, x1, y1, x2, y2 = (t[c].to_numpy() for c in ("card_id", *CORNERS))
    # Texts repeat, so each different one is made canonical once.
    words = pc.fill_null(t["text"], "").combine_chunks().dictionary_encode()
    numbers: dict[str, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in map(known.__getitem__, words.dictionary.to_pylist())], np.int64)
    run = np.concatenate(([0], np.cumsum(page[1:] != page[:-1])))
    group = run * len(numbers) + codes[words.indices.to_numpy(zero_copy_only=False)]
    by_y = np.lexsort((y1, group))
    new = np.concatenate(([True], group[by_y][1:] != group[by_y][:-1]))
    # Each group is lifted above the one before. What rounding leaves uncertain stays one island, which costs time only.
    lift = (np.cumsum(new) - 1) * (y2.max() - y1.min() + 1.0)
    reached = np.maximum.accumulate(y2[by_y] + lift)
    new[1:] |= y1[by_y][1:] + lift[1:] >= reached[:-1] + 1e-9 * (1.0 + abs(reached[-1]))
    island = np.empty(len(page), np.int64)
    island[by_y] = np.cumsum(new)
    by_x = np.lexsort((x1, island))
    island, x1, y1, x2, y2 = (c[by_x] for c in (island, x1, y1, x2, y2))
    area = np.maximum(1.0, x2 - x1) * np.maximum(1.0, y2 - y1)
    at, shift, found = np.arange(len(by_x)), 1, []
    while len(at := at[: np.searchsorted(at, len(by_x) - shift)]):
        at = at[(island[at + shift] == island[at]) & (x1[at + shift] < x2[at])]
        to = at + shift
        w, h = np.minimum(x2[at], x2[to]) - np.maximum(x1[at], x1[to]), np.minimum(y2[at], y2[to]) - np.maximum(y1[at], y1[to])
        inter = np.where((w > 0) & (h > 0), w * h, 0.0)
        share = inter / np.maximum(1.0, area[at] + area[to] - inter)
        enough = share >= least
        found.append((by_x[at[enough]], by_x[to[enough]], share[enough]))
        shift += 1
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _pairs(least: float) -> Callable[[pa.Table], pa.RecordBatch]:
    known = _Canonical()  # sent empty, so a task has its own

    def work(t: pa.Table) -> pa.RecordBatch:
        a, b, share = _met(t, least, known)
        page, token = t["card_id"].to_numpy(), t["tok_idx"].to_numpy()
        two = token[a] != token[b]
        a, b, share = a[two], b[two], share[two]
        return pa.RecordBatch.from_arrays([pa.array(page[a]), pa.array(np.minimum(token[a], token[b])), pa.array(np.maximum(token[a], token[b])), pa.array(share)], ["card_id", "a", "b", "iou"])

    return work


def _stay(least: float, names: list[str]) -> Callable[[pa.Table], pa.RecordBatch]:
    known = _Canonical()  # sent empty, so a task has its own

    def work(t: pa.Table) -> pa.RecordBatch:
        a, b, _ = _met(t, least, known)
        score, keep = t["score"].to_numpy(), np.ones(t.num_rows, bool)
        order = np.empty(t.num_rows, np.int64)
        order[np.lexsort((t["tok_idx"].to_numpy(), -score, t["x1"].to_numpy(), t["y1"].to_numpy()))] = np.arange(t.num_rows)
        first, later = np.where(order[a] < order[b], a, b), np.where(order[a] < order[b], b, a)
        degree = np.bincount(np.concatenate((a, b)), minlength=t.num_rows)
        pair = (degree[a] == 1) & (degree[b] == 1)
        keep[np.where(score[later] > score[first], first, later)[pair]] = False
        # What meets more than one is folded in order, as ``tokens.dedupe`` does it.
        near: dict[int, list[int]] = {}
        for p, q in zip(a[~pair].tolist(), b[~pair].tolist(), strict=True):
            near.setdefault(p, []).append(q)
            near.setdefault(q, []).append(p)
        place: dict[int, int] = {}
        for n, x in enumerate(sorted(near, key=order.__getitem__)):
            hit = min((k for k in near[x] if k in place), key=place.__getitem__, default=None)
            if hit is None:
                place[x] = n
            elif score[x] > score[hit]:
                place[x], keep[hit] = place.pop(hit), False
            else:
                keep[x] = False
        return t.select(names).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    return work


def _placed(tokens: DataFrame, *more: str) -> DataFrame:
    """What pages are worked out from: narrow rows, corners taken from the box only where no column has them."""
    t = tokens if set(CORNERS) <= set(tokens.columns) else geometry(tokens)
    return t.select("card_id", F.col("tok_idx").cast("long").alias("tok_idx"), "text", *CORNERS, *more)


def _one_row_or_several(tokens: DataFrame, sources: DataFrame, here: Callable[[DataFrame], DataFrame], dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``here`` for pages whose tokens are read from one row of ``sources`` (card_id), and so stand together; ``dealt`` for the others."""
    several = sources.groupBy("card_id").count().filter("count > 1 OR card_id IS NULL").select("card_id")
    n = several.count()
    if not n:
        return here(tokens)
    if n > SEVERAL:
        return dealt(tokens)
    mark = F.broadcast(several.withColumn("_several", F.lit(True)))
    t = tokens.join(mark.withColumnRenamed("card_id", "_id"), F.col("card_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return here(t.filter("_several IS NULL").drop("_several")).unionByName(dealt(t.filter("_several").drop("_several")))


def overlaps_where_read(tokens: DataFrame, sources: DataFrame, least: float = C.IOU_MIN) -> DataFrame:
    """``overlaps`` for tokens that each page has from one row of ``sources`` (card_id), as an exploded text or payload: nothing is dealt.

    A page that a task has read as one row, it can hold. Pages of several rows go to ``overlaps``. Tokens may have their corners
    as columns.
    """
    kind = "card_id long, a long, b long, iou double"
    here = lambda t: _placed(t).mapInArrow(_page_by_page(_pairs(least)), kind).withColumn("iou", F.round("iou", 6))
    return _one_row_or_several(tokens, sources, here, lambda t: overlaps(t, least))


def dedupe_where_read(tokens: DataFrame, sources: DataFrame, least: float = C.IOU_MIN) -> DataFrame:
    """(card_id, tok_idx, text, score) of ``dedupe_pages``, as ``overlaps_where_read``."""
    names = ["card_id", "tok_idx", "text", "score"]
    here = lambda t: _placed(t, "score").mapInArrow(_page_by_page(_stay(least, names)), "card_id long, tok_idx long, text string, score double")
    return _one_row_or_several(tokens, sources, here, lambda t: dedupe_pages(t.drop(*CORNERS), least).select(*names))


def reading_edges(rows: DataFrame, least: float = 0.25) -> DataFrame:
    """(card_id, src, dst) as ``rows.reading_order``, for pages: rows meet in strips of the page, as wide as its middle row.

    Rows that share no strip cannot overlap. Of several strips that two rows share, the one with the
    left end of what they share counts.
    """
    wide = rows.groupBy("card_id").agg(F.greatest(F.lit(1.0), F.median(F.col("x2") - F.col("x1"))).alias("_wide"))
    # What a plan takes rows of exploded arrays to weigh is far too little, so no side may be broadcast by it.
    r = rows.select("card_id", "row_id", "x1", "x2", "y_center").hint("merge").join(wide, "card_id")
    r = r.select("*", F.explode(F.sequence(F.floor(F.col("x1") / F.col("_wide")), F.floor(F.col("x2") / F.col("_wide")))).alias("strip"))
    a, b = (r.select("card_id", "strip", "_wide", *(F.col(c).alias(f"{p}_{c}") for c in ("row_id", "x1", "x2", "y_center"))) for p in "ab")
    left = F.greatest("a_x1", "b_x1")
    over = (F.least("a_x2", "b_x2") - left) / F.greatest(F.lit(1.0), F.col("a_x2") - F.col("a_x1"))
    met = a.hint("merge").join(b.drop("_wide"), ["card_id", "strip"]).filter((F.col("a_row_id") < F.col("b_row_id")) & (F.col("b_y_center") > F.col("a_y_center")) & (F.col("strip") == F.floor(left / F.col("_wide"))))
    return met.filter(over >= least).select("card_id", F.col("a_row_id").alias("src"), F.col("b_row_id").alias("dst"))
