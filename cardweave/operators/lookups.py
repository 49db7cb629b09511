"""Dictionaries and numbering plans as tables of any size: joined, not written into the plan."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweave.plans.stage import stage

#: Length of the grams that hints are found by, and the most patterns that become part of a plan.
GRAM, PATTERNS = 3, 1000
#: Rows of a table up to which it is broadcast.
SMALL = 200_000
#: Words that a task of ``count_hints`` remembers at once, and characters of the longest of them.
REMEMBERED, LONGEST = 300_000, 64


def small_or_not(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table to be broadcast if a count says that it is small; joined by a shuffle otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters: what a look-ahead sees from each place, found in one scan."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def match_hints(lines: DataFrame, hints: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` (with all their columns) and hint for each hint that a line holds, both lower-cased; one row a line and hint.

    Of each hint the gram that is rarest in the lines is its key; a line meets the hints of its own grams
    only, and is then searched for each whole hint. Hints shorter than a gram are their own key. An empty hint is in no line.
    """
    own = hints.select(F.lower("hint").alias("hint")).filter("hint != ''").distinct()
    own = own.withColumn("n", F.least(F.lit(GRAM), F.length("hint")))
    of_hint = reduce(lambda rest, n: F.when(F.col("n") == n, _grams(F.col("hint"), n)).otherwise(rest), range(1, GRAM), _grams(F.col("hint"), GRAM))
    parts = own.select("hint", "n", F.explode(of_hint).alias("gram"))
    sizes = [r[0] for r in own.select("n").distinct().orderBy("n").collect()]  # at most GRAM rows
    if not sizes:
        return lines.withColumn("hint", F.lit(None).cast("string")).limit(0)
    # Written once, so that a line has one number wherever it is read; grams and hints travel with the number, not the text.
    told = stage(lines.withColumns({"_low": F.lower(text), "_id": F.monotonically_increasing_id()}))
    each = F.flatten(F.array(*(_grams(F.col("_low"), n) for n in sizes)))
    known = small_or_not(parts.select("gram").distinct())
    # Lines' grams that no hint has are dropped before anything is shuffled.
    seen = told.select(F.explode(each).alias("gram")).join(known, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("times"))
    rarest = parts.join(seen, "gram").groupBy("hint").agg(F.min_by("gram", F.struct("times", "gram")).alias("gram"))
    may = told.select("_id", F.explode(each).alias("gram")).join(small_or_not(rarest), "gram").groupBy("_id").agg(F.collect_list("hint").alias("_hints"))
    found = told.join(may, "_id").withColumn("_held", F.filter("_hints", lambda h: F.col("_low").contains(h)))
    return found.select(*lines.columns, F.explode("_held").alias("hint"))


class _Held(dict):
    """For each word the numbers of the hints that it holds, found at the first sight of it and remembered; a task's own."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers, self.lengths = numbers, sorted({len(h) for h in numbers})

    def __missing__(self, word: str) -> tuple[int, ...]:
        n, get = len(word), self.numbers.get
        found = {get(word[i : i + k]) for k in self.lengths if k <= n for i in range(n - k + 1)}
        found.discard(None)
        if n <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = tuple(found)
        return tuple(found)


def _tally(hints: list[str]):
    """A task's counts of lines and texts for each hint, from batches of (id, text), texts and hints lower-cased.

    What stands between spaces can only be in what stands between spaces of a line, so each word is searched once, and a line has
    what its words have. A hint of several words is looked for in the lines that hold its longest one.
    """
    plain = [h for h in hints if " " not in h]
    numbers = {h: i for i, h in enumerate(plain)}
    blank, wider = [], {}
    for h in hints:
        if " " in h:
            key = max(h.split(" "), key=len)
            (wider.setdefault(numbers.setdefault(key, len(numbers)), []) if key else blank).append(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, in_lines, in_texts = _Held(numbers), Counter(), Counter()
        words_of = held.__getitem__
        for batch in batches:
            for key, text in (row for k in range(0, batch.num_rows, 100) for row in zip(*(c.to_pylist() for c in batch.slice(k, 100).columns), strict=True)):
                seen = set()
                for line in text.split("\n"):
                    if not line.strip(" "):
                        continue
                    hits = set().union(*map(words_of, set(line.split(" "))))
                    for k in wider.keys() & hits:
                        hits.update(h for h in wider[k] if h in line)
                    hits.update(h for h in blank if h in line)
                    in_lines.update(hits)
                    seen |= hits
                if key is not None:
                    in_texts.update(seen)
        names = {k: k if isinstance(k, str) else plain[k] for k in in_lines if isinstance(k, str) or k < len(plain)}
        yield pa.RecordBatch.from_arrays([pa.array(list(names.values()), pa.string()), pa.array([in_lines[k] for k in names], pa.int64()), pa.array([in_texts[k] for k in names], pa.int64())], ["hint", "n_lines", "n_docs"])

    return run


def count_hints(texts: DataFrame, hints: DataFrame) -> DataFrame:
    """(hint, n_lines, n_docs): in how many lines, and in how many of the texts (id, text), each hint is, both lower-cased; none that is in no line.

    As ``match_hints`` and a grouping of its rows, but a text is read where it is, and only counts are dealt. Lines are
    what stands between line feeds, blank ones left out. Texts with one id count as one. Dictionaries of more than ``SMALL``
    hints are joined.
    """
    own = hints.select(F.lower("hint").alias("hint")).filter("hint != ''").distinct()
    known = [r[0] for r in own.limit(SMALL + 1).collect()]
    if len(known) > SMALL:
        lines = texts.select("id", F.explode(F.split("text", "\n", -1)).alias("text")).filter(F.trim("text") != "")
        return match_hints(lines, own).groupBy("hint").agg(F.count("*").alias("n_lines"), F.countDistinct("id").alias("n_docs"))
    low = texts.select("id", F.lower("text").alias("text")).filter("text is not null")
    twice = texts.groupBy("id").count().filter("count > 1 and id is not null").select("id")
    if not twice.isEmpty():
        again = low.hint("merge").join(twice, "id", "left_semi").groupBy("id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
        low = low.hint("merge").join(twice, "id", "left_anti").unionByName(again)
    counts = low.mapInArrow(_tally(known), "hint string, n_lines long, n_docs long")
    return counts.groupBy("hint").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_docs").alias("n_docs"))


def longest_plan(found: DataFrame, plans: DataFrame, col: str = "phone") -> DataFrame:
    """``found`` with region and number by the plan with the longest calling code that fits; null if none does.

    ``plans``: (code, region, low, high), the numbers of digits after the code. Each number is joined by its
    prefixes, so a table of any number of codes costs as many rows as codes have digits. Of plans that tie, the first region counts.
    """
    plans = plans.select("code", F.col("region").alias("_region"), "low", "high")
    longest = plans.agg(F.max(F.length("code"))).first()[0] or 0
    keyed = stage(found.withColumn("_id", F.monotonically_increasing_id()))
    digits = keyed.filter(F.col(col).startswith("+")).select("_id", F.regexp_replace(col, r"\D", "").alias("d"))
    prefix = digits.select("_id", "d", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("d"))), lambda n: F.substring(F.col("d"), F.lit(1), n))).alias("code")) if longest else digits.select("_id", "d", F.lit("").alias("code"))
    fits = prefix.join(small_or_not(plans), "code").filter((F.length("d") - F.length("code")).between(F.col("low"), F.col("high")))
    number = F.concat(F.lit("+"), F.col("code"), F.lit(" "), F.expr("substring(d, length(code) + 1)"))
    best = fits.groupBy("_id").agg(F.min_by(F.struct(F.col("_region").alias("region"), number.alias("number")), F.struct(-F.length("code"), "_region")).alias("best"))
    return keyed.join(best, "_id", "left").select(*found.columns, F.col("best.region").alias("region"), F.col("best.number").alias("number"))


def ranked_region(lines: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` with region and match of the first pattern, by rank and then region, that a text fits; null if none does.

    ``patterns``: (rank, region, pattern). Patterns are no keys, so they become part of the plan, which a table of more than ``PATTERNS`` cannot.
    """
    rows = patterns.select("rank", "region", "pattern").limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    rows = sorted(((r["rank"], r["region"], r["pattern"]) for r in rows))
    for _, _, p in rows:
        re.compile(p)
    first = lambda form: reduce(lambda rest, r: F.when(F.col(text).rlike(r[2]), form(r)).otherwise(rest), reversed(rows), F.lit(None).cast("string"))
    return lines.withColumns({"region": first(lambda r: F.lit(r[1])), "match": first(lambda r: F.regexp_extract(text, r[2], 0))})
