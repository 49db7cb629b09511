"""Benchmark decontamination by template canonicalisation and by the words as they are.

Both sides are canonicalised: numbers, capitalised names inside a sentence, and
units after a number become typed placeholders, other words lower case without
their punctuation. Windows of ``WINDOW`` template tokens, most of them literal
words, are joined by hash; so are windows of ``WINDOW`` words in lower case, of
any kind (of the whole item if it is shorter). An item's first word may be a name
where it is quoted inside a sentence: up to ``MIN_RUN`` tokens, where it is needed,
the first window is there both ways; in longer items such a word is not counted.
Matches on one diagonal form runs, extended over equal words; in a run the slot
values must be consistent: a value on one side always stands against the same
value on the other. So a question asked again with other numbers or names is
caught, and a mere likeness of form is not. The longest consistent parts that
hold a matched window stay. A part of ``MIN_RUN`` tokens (or of a whole shorter
item) contaminates the document.

The benchmark's windows are broadcast only if their number is at most
``BROADCAST_WINDOWS``, which bounds their memory. Beyond that the hashes of windows
are joined by a shuffle; a bitmap of fixed size keeps windows that no item has out of it.
There each window comes with the few tokens on its sides. A window that lies in a part long enough to
contaminate has like tokens next to it, so different surroundings meet first, each
once, and only what agrees goes on as places (text, item, diagonal). For those no more than the tokens of the text
that lie along the item travel, and are compared as in the other way, so both give the same rows.

Defined results: null texts are empty and clean. A null item is empty and matches
nothing; an item of few words matches wherever they stand in a row. Repeated rows
get equal results. Nothing depends on documents' ids, which may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardweave.llm.common import cut, small_or_not, text_of
from cardweave.llm.words import BASE, CHUNK, INVERSE, POWER, mix

WINDOW, MIN_RUN, BROADCAST_WINDOWS = 8, 13, 500_000
#: Literal words that a window must hold.
LITERALS = 5
#: Places of a text that are cut out of it in one row.
LISTED = 256
#: Bits of the bitmap of the benchmark's windows (a power of two; 16 MB).
BITMAP = 1 << 27
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
# Units after a number (fixed list).
UNITS = "mm cm m km inch inches ft feet mile miles g kg mg lb lbs oz ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent kmh mph mb gb tb hz khz mhz v w kw c f k".split()

_KIND = np.zeros(256, np.int8)  # 1 letter, 2 digit, 3 upper-case ASCII letter
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_KIND[list(range(ord("0"), ord("9") + 1))] = 2
_KIND[list(range(ord("A"), ord("Z") + 1))] = 3
_END = np.zeros(256, bool)
_END[list(b".!?:\n")] = True


def _hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * INVERSE[starts]) | np.uint64(4)


def _tokens(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(template codes, values) of a chunk of bytes; values are hashes of the words in lower case."""
    kind = _KIND[b]
    # Latin-1 capitals in UTF-8: 0xC3 and 0x80..0x9E.
    after = np.concatenate(([False], b[:-1] == 0xC3))
    capital = after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
    low = b.copy()
    low[(kind == 3) | capital] += 0x20
    inside = kind > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * POWER[: len(b)], out=total[1:])
    value = _hashes(total, starts, ends)
    count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    upper, digits, stops = count((kind == 3) | capital), count(kind == 2), count(_END[b])
    n_upper, n_digits = upper[ends] - upper[starts], digits[ends] - digits[starts]
    number = n_digits == ends - starts
    two = (b[starts] == 0xC3) & (ends - starts > 1)
    first_upper = (kind[starts] == 3) | (two & capital[np.minimum(starts + 1, len(b) - 1)])
    gap_start = np.concatenate(([0], ends[:-1]))
    opens = stops[starts] - stops[gap_start] > 0
    opens[0] = True
    name = first_upper & (n_upper == 1) & ~opens & (ends - starts > 1)
    before = np.concatenate(([False], number[:-1]))
    unit = before & np.isin(value, _UNIT_VALUES)
    code = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, value)))
    return code, value


def _hash_of(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), np.uint8).astype(np.uint64)
    return (mix(np.array([((b + np.uint64(1)) * POWER[: len(b)]).sum(dtype=np.uint64)], np.uint64)) | np.uint64(4))[0]


_UNIT_VALUES = np.array([_hash_of(u) for u in UNITS], np.uint64)


def template(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Template codes and word values of a whole text."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(b):
        end = min(at + CHUNK, len(b))
        if end < len(b):  # cut where a sentence ends, or else between words, or else anywhere
            for gaps in (np.flatnonzero(_END[b[at:end]]), np.flatnonzero(_KIND[b[at:end]] == 0)):
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
        parts.append(_tokens(b[at:end]))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _rolled(tokens: np.ndarray, width: int, kind: int) -> np.ndarray:
    """A hash of each run of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, kind, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(BASE) + tokens[i : i + n])
    return h


def windows(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows with enough literal words."""
    h = _rolled(code, WINDOW, WINDOW)
    literal = np.concatenate(([0], np.cumsum(code > UNIT)))
    at = np.flatnonzero(literal[WINDOW:] - literal[:-WINDOW] >= LITERALS)
    return at, h[at]


def word_windows(value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all windows of ``width`` words as they are."""
    h = _rolled(value, width, 64 + width)
    return np.arange(len(h)), h


def item_windows(text: str | None, code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(start, hash) of an item's windows of both kinds, and the width of those of words."""
    width = min(WINDOW, len(value))
    if not width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), WINDOW
    found = [windows(code), word_windows(value, width)]
    inside = template("x " + text.lstrip())[0][1 : 1 + WINDOW]
    if inside[0] != code[0] and len(code) <= MIN_RUN:  # its first word is a name inside a sentence
        found.append(windows(np.concatenate((inside[:1], code[1:WINDOW]))))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), width


def _consistent(x: np.ndarray, y: np.ndarray) -> bool:
    pairs = np.unique(np.stack([x, y]), axis=1)
    return len(np.unique(pairs[0])) == pairs.shape[1] == len(np.unique(pairs[1]))


def _consistent_parts(x: np.ndarray, y: np.ndarray, slots: np.ndarray) -> list[tuple[int, int]]:
    """The longest stretches (start, end) in which each value of x at a slot stands against one of y, and back."""
    at = np.flatnonzero(slots)
    if not len(at) or _consistent(x[at], y[at]):
        return [(0, len(x))]
    out, start, last_x, last_y = [], 0, {}, {}
    for i, u, v in zip(at.tolist(), x[at].tolist(), y[at].tolist(), strict=True):
        # The last places where either value stood against others.
        clash = max(max((j for w, j in last_x.get(u, {}).items() if w != v), default=-1), max((j for w, j in last_y.get(v, {}).items() if w != u), default=-1))
        if clash >= start:
            out.append((start, i))
            start = clash + 1
        last_x.setdefault(u, {})[v] = last_y.setdefault(v, {})[u] = i
    return [*out, (start, len(x))]


def surroundings(code: np.ndarray, value: np.ndarray, at: np.ndarray, width: int | np.ndarray) -> list[np.ndarray]:
    """For each window the codes and values before it, nearest first, and those after it; 0 outside of the text."""
    side = MIN_RUN - WINDOW
    code, value = (np.concatenate((np.zeros(side, np.uint64), x, np.zeros(side + WINDOW, np.uint64))).view(np.int64) for x in (code, value))
    before, after = at[:, None] + side - 1 - np.arange(side), (at + width)[:, None] + side + np.arange(side)
    return list(np.concatenate([code[before], value[before], code[after], value[after]], axis=1))


class Index:
    """The windows of some items, for comparing texts with them; ``bits``: of the table that passes over windows of no item."""

    def __init__(self, items: list[tuple[int, str]], bits: int = 20):
        self.items = [(i, *template(t)) for i, t in items]
        rows = [(h, np.full(len(h), k), at, w) for k, ((_, code, value), (_, t)) in enumerate(zip(self.items, items, strict=True)) for at, h, w in [item_windows(t, code, value)]]
        self.hash = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.uint64)])
        self.item = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.start = np.concatenate([r[2] for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.widths = sorted({r[3] for r in rows})
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.start = self.hash[order], self.item[order], self.start[order]
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hash >> self.shift).astype(np.int64)] = True

    def _met(self, at: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """(item, shift, start here, width) of the windows that an item has too."""
        maybe = self.seen[(h >> self.shift).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        mine = np.repeat(at, n)
        theirs = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.item[theirs], mine - self.start[theirs], mine, np.full(len(mine), width)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, first token here, first token of the item, tokens) of every run that contaminates."""
        return self.matches_of(*template(text))

    def matches_of(self, code: np.ndarray, value: np.ndarray, diagonal: int | None = None) -> list[tuple[int, int, int, int]]:
        """The same of a text's tokens; only with items that begin at token ``diagonal``, if it is given."""
        if not len(self.hash):
            return []
        met = [self._met(*windows(code), WINDOW), *(self._met(*word_windows(value, w), w) for w in self.widths)]
        item, shift, mine, width = (np.concatenate(x) for x in zip(*met, strict=True))
        if diagonal is not None:
            item, shift, mine, width = (x[on] for on in [shift == diagonal] for x in (item, shift, mine, width))
        if not len(item):
            return []
        order = np.lexsort((mine, shift, item))
        item, shift, mine, end = item[order], shift[order], mine[order], (mine + width)[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(item) != 0) | (np.diff(shift) != 0))))
        out = []
        for s, e in zip(new, np.append(new[1:], len(mine)), strict=True):
            i, their_code, their_value = self.items[item[s]]
            d, need = int(shift[s]), min(MIN_RUN, len(their_code))
            # Tokens of matched windows on this diagonal, and equal words next to them.
            low, high = max(0, d), min(len(code), len(their_code) + d)
            held = np.zeros(high - low + 1, np.int64)
            np.add.at(held, mine[s:e] - low, 1)
            np.add.at(held, end[s:e] - low, -1)
            held = np.cumsum(held)[:-1] > 0
            like = held | (value[low:high] == their_value[low - d : high - d])
            if len(their_code) > MIN_RUN and low == d and code[low] != their_code[0]:
                like[0] = False
            edge = np.flatnonzero(np.diff(np.concatenate(([False], like, [False])).astype(np.int8)))
            for a, z in zip((edge[::2] + low).tolist(), (edge[1::2] + low).tolist(), strict=True):
                if z - a < need or not held[a - low : z - low].any():
                    continue
                here, there = slice(a, z), slice(a - d, z - d)
                slots = (code[here] <= UNIT) | (their_code[there] <= UNIT)
                for p, q in _consistent_parts(value[here], their_value[there], slots):
                    if q - p >= need and ((mine[s:e] >= a + p) & (end[s:e] <= a + q)).any():
                        out.append((i, a + p, a + p - d, q - p))
        return out


def _found_schema(docs: DataFrame, id_col: str, benchmark: DataFrame, item_col: str) -> str:
    return f"id {docs.schema[id_col].dataType.simpleString()}, text_hash long, items array<{benchmark.schema[item_col].dataType.simpleString()}>, n_matched long"


def _report(ids: pd.Series, hashes: pd.Series, found: list[list[tuple]]) -> pd.DataFrame:
    items = [sorted({m[0] for m in f}) for f in found]
    covered = [len(set().union(*(range(a, a + n) for _, a, _, n in f))) if f else 0 for f in found]
    return pd.DataFrame({"id": ids, "text_hash": hashes, "items": items, "n_matched": covered})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, text_hash, items, n_matched) for each row: the items met, if any, and how many tokens lie in matches."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), text_of(item_text_col).alias("item_text")).distinct()
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("_text"))
    schema = _found_schema(docs, id_col, benchmark, item_col)
    # A token has a letter or digit and, but for the last, a separator: so windows of a kind are at most half the characters.
    bound = items.agg(F.sum(F.octet_length("item_text") + 2)).first()[0] or 0
    if bound <= broadcast_windows:
        shared = spark.sparkContext.broadcast([(r["item"], r["item_text"]) for r in items.collect()])

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(shared.value)
            for frame in frames:
                yield _report(frame["id"], frame["text_hash"], [index.matches(t) for t in frame["_text"]])

        return src.mapInPandas(look, schema)

    item_type = items.schema["item"].dataType.simpleString()

    places = "start long, hash long, width int, around array<long>"

    def emit_items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["item"], frame["item_text"], strict=True):
                code, value = template(text)
                at, h, width = item_windows(text, code, value)
                if len(h):
                    kinds = np.where(np.isin(h, word_windows(value, width)[1]), width, WINDOW).astype(np.int32)
                    yield pd.DataFrame({"item": np.full(len(h), key), "size": np.full(len(h), len(code)), "start": at, "hash": h.view(np.int64), "width": kinds, "around": surroundings(code, value, at, kinds)})

    theirs = cut(items.mapInPandas(emit_items, f"item {item_type}, size long, {places}"))
    widths = sorted(r[0] for r in theirs.select("width").distinct().collect())
    # The bits of a 4 KB page of the bitmap are one row: at most 4,096 rows of what is marked reach the driver.
    bit = f"(hash & {BITMAP - 1}L)"
    marked = theirs.select(F.expr(f"int({bit} >> 15)").alias("page"), F.expr(f"int({bit} & 32767)").alias("bit")).groupBy("page").agg(F.collect_set("bit").alias("bits"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page": frame["page"], "bits": [np.packbits(np.isin(np.arange(1 << 15), b), bitorder="little").tobytes() for b in frame["bits"]]})

    bitmap = np.zeros((BITMAP >> 15, 1 << 12), np.uint8)
    for row in marked.mapInPandas(fold, "page int, bits binary").collect():
        bitmap[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    marks = spark.sparkContext.broadcast(bitmap.reshape(-1))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = marks.value
        for frame in frames:
            for key, text in zip(frame["key"], frame["body"], strict=True):
                code, value = template(text)
                for width, (at, h) in [(WINDOW, windows(code)), *((w, word_windows(value, w)) for w in widths)]:
                    bit = (h & np.uint64(BITMAP - 1)).astype(np.int64)
                    on = there[bit >> 3] >> (bit & 7) & 1 == 1
                    at, h = at[on], h[on]
                    for i in range(0, len(h), 4096):
                        a = at[i : i + 4096]
                        yield pd.DataFrame({"key": np.full(len(a), key), "start": a, "hash": h[i : i + 4096].view(np.int64), "width": np.full(len(a), width, np.int32), "around": surroundings(code, value, a, width)})

    # Equal texts are compared once.
    bodies = src.select(F.col("text_hash").alias("key"), F.col("_text").alias("body")).groupBy("key").agg(F.first("body").alias("body"))
    ours = cut(bodies.mapInPandas(emit, f"key long, {places}"))
    # Surroundings that agree: like tokens in a row on both sides, and the window, make up a part.
    side = MIN_RUN - WINDOW

    def in_a_row(first: int):
        n = F.lit(0)
        for i in reversed(range(first, first + side)):
            like = lambda j: (F.col("here")[j] != 0) & (F.col("here")[j] == F.col("there")[j])
            n = F.when(like(i) | like(i + side), n + 1).otherwise(0)
        return n

    here = ours.select("hash", "width", F.col("around").alias("here")).distinct()
    there = theirs.select("hash", "width", F.least("size", F.lit(MIN_RUN)).alias("need"), F.col("around").alias("there")).distinct()
    agreed = cut(here.join(there, ["hash", "width"]).filter(F.col("width") + in_a_row(0) + in_a_row(2 * side) >= F.col("need")).drop("need").distinct())
    met = ours.withColumnRenamed("around", "here").join(small_or_not(agreed, 100_000), ["hash", "width", "here"])
    of_items = theirs.select("hash", "width", F.col("around").alias("there"), "item", "size", F.col("start").alias("at"))
    hits = met.join(of_items, ["hash", "width", "there"]).select("key", "item", "size", (F.col("start") - F.col("at")).alias("shift")).distinct()
    # So many of a text's hits are a row.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("shift", "item"))
    lists = hits.withColumn("part", F.floor(nth / LISTED)).groupBy("key", "part").agg(F.collect_list(F.struct("item", "shift", "size")).alias("hits")).drop("part")

    def cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, body, listed in zip(frame["key"], frame["body"], frame["hits"], strict=True):
                code, value = (x.view(np.int64) for x in template(body))
                rows = [(key, h["item"], h["shift"], low, code[low:high], value[low:high]) for h in listed for low, high in [(max(0, h["shift"]), min(len(code), h["shift"] + h["size"]))]]
                yield pd.DataFrame(rows, columns=["key", "item", "shift", "low", "code", "value"])

    stretches = lists.join(bodies, "key").mapInPandas(cut_out, f"key long, item {item_type}, shift long, low long, code array<long>, value array<long>")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for frame in frames:
            rows = []
            for key, item, shift, low, code, value, text in zip(*(frame[c] for c in ("key", "item", "shift", "low", "code", "value", "item_text")), strict=True):
                if index is None or last != (item, text):
                    last, index = (item, text), Index([(item, text)], bits=12)
                rows += [(key, item, low + a, n) for _, a, _, n in index.matches_of(np.asarray(code, np.int64).view(np.uint64), np.asarray(value, np.int64).view(np.uint64), shift - low)]
            yield pd.DataFrame(rows, columns=["key", "item", "a", "n"])

    runs = stretches.join(items, "item").mapInPandas(compare, f"key long, item {item_type}, a long, n long")
    # Tokens in matches: runs of one text that overlap are counted once.
    spots = runs.select("key", "item", F.explode(F.sequence("a", F.col("a") + F.col("n") - 1)).alias("at"))
    found = spots.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.countDistinct("at").alias("n_matched"))
    out = src.select("id", "text_hash").join(found, F.col("text_hash") == F.col("key"), "left")
    return out.select("id", "text_hash", F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"), F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that match no item."""
    hits = contaminated(docs, benchmark, id_col, text_col, **options).filter("n_matched > 0").select(F.col("id").alias("__id"), F.col("text_hash").alias("__th")).distinct()
    return docs.join(hits, docs[id_col].eqNullSafe(hits["__id"]) & (F.xxhash64(text_of(text_col)) == hits["__th"]), "left_anti")
