"""Line dedup by winnowing over the hashes of units, in DataFrame functions only.

A text is cut after line breaks and (``sentences``) after sentence ends, each
unit keeping what ends it. A run of at least ``MIN_UNITS`` units and ``min_words``
words, or one unit of ``long_unit`` words, is a repeat if it also stands at an
earlier place (by id, text, and unit). The units of every repeat are deleted, so
the first occurrence of a run stays.

The window of a unit is the shortest row of units from it on that reaches
``min_words``. Of each window the least unit is selected, where units of more words
are less, and those of as many in the order of their hashes. Neighbouring windows mostly select the
same unit, so there are fewer fingerprints than units. A repeat holds the whole
windows of its minimal runs, and what a window selects depends on nothing else: equal
repeats surely have equal fingerprints, at the same offsets.

Each selected place carries the units around it. Places join by fingerprint; one
that stands alone ends there, which is most of a text. Places that met are extended both ways to the
minimal runs around them: from each unit on the shortest run that counts forwards, and backwards
too. Every unit of a repeat lies in such a run inside of it. Runs that are equal as a whole are ordered by place, and
all but the first are repeats; those that overlap are merged. As places that share a fingerprint are compared by whole runs
and not by pairs, no partner is missed: nothing depends on which other document a fingerprint is met in first. A minimal run has at most
``min_words`` units with words. Units without words (blank lines) are counted
between them, so that long stretches of them cost no more than other units.

Defined results: a null text is an empty one and stays empty. Rows equal in id
and text are one document, and share its fate. Ids may be null (they come
first). Texts keep their bytes outside the deleted units. A very long text is one row: its
units and its selected places are arrays of a few dozen bytes a unit, and no run is longer than
``min_words`` units with words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardweave.llm.common import WORD, cut, passing, small_or_not, text_of

LONG_UNIT, MIN_WORDS, MIN_UNITS = 50, 25, 2
#: A fingerprint of more places than about HOT (some 40 MB in a window) is dealt to PARTS; one in SHARE documents is looked at for that. Results do not depend on it.
HOT, SHARE, PARTS = 200_000, 256, 64
#: Documents and merged runs (some 16 bytes each) that may be broadcast.
BROADCAST_RUNS = 1_000_000
#: Words of a unit, and units of a run, that a packed number can hold; more words count as so many.
MOST = (1 << 16) - 1
SENTENCES = r"(?<=\n)|(?<=[.!?]\x20)"
LINES = r"(?<=\n)"


#: A character that marks where a text is cut; texts that hold it are cut by the pattern instead.
_MARK = "\x00"


def _marked(text: Column, sentences: bool, bare: bool) -> Column:
    """The text with a mark at each place to cut; ``bare``: in the place of the white-space character there."""
    for end in ("\n", ". ", "! ", "? ") if sentences else ("\n",):
        text = F.replace(text, F.lit(end), F.lit((end[:-1] if bare else end) + _MARK))
    return text


def _units(text: Column, sentences: bool, bare: bool = False) -> Column:
    """The units of a text: cut after line breaks, and after sentence ends with a space."""
    by_pattern = F.split(text, SENTENCES if sentences else LINES, -1)
    return F.when(text.contains(_MARK), by_pattern).otherwise(F.split(_marked(text, sentences, bare), _MARK, -1))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: the optimizer puts a column's expression into functions on elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _measured(text: Column, sentences: bool) -> Column:
    """array<struct<h,w,p>>: the hash without the white space at its end, and the words, of each unit."""

    def slow(u: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(F.regexp_replace(u, r"[\x20\x09-\x0D]+\z", "")).alias("h"), F.regexp_count(u, F.lit(WORD)).cast("int").alias("w"), i.alias("p"))

    def fast(u: Column, i: Column) -> Column:
        # Spaces are single and the only white space left: a unit has one word more than spaces between its ends.
        spaces = lambda r: F.octet_length(r) - F.octet_length(F.replace(r, F.lit(" "), F.lit("")))
        words = lambda r: F.when(r == "", 0).when(r.startswith(" "), spaces(r)).otherwise(spaces(r) + 1)
        return _let(F.rtrim(u), lambda r: F.struct(F.xxhash64(r).alias("h"), words(r).cast("int").alias("w"), i.alias("p")))

    plain = F.lit(True)
    for odd in ("  ", "\t", "\r", "\x0b", "\x0c", _MARK):
        plain = plain & ~text.contains(odd)
    return F.when(plain, F.transform(_units(text, sentences, bare=True), fast)).otherwise(F.transform(_units(text, sentences), slow))


def _sums(ws: Column, body) -> Column:
    """``body`` of the list of arrays of the words of each 1, 2 and 4 units in a row."""

    def more(known: list[Column]) -> Column:
        half = 1 << len(known) - 1
        if len(known) == 3:
            return body(known)
        return _let(F.transform(known[-1], lambda x, k: x + F.coalesce(F.get(known[-1], k + half), F.lit(0))), lambda x: more([*known, x]))

    return more([ws])


def _reach(sums: list[Column], levels: Column, k: Column, min_words: int) -> Column:
    """How many units from number k on reach min_words; null if all that are left do not."""
    ones, twos, fours = (F.get(x, k) for x in sums[:3])
    size = 1 << 20

    def step(state: Column, level: Column) -> Column:
        # The place so far and the words still wanted, in one number: rows of units that are not enough are passed, the longest first.
        held = F.get(level["sums"], F.shiftright(state, 20).cast("int"))
        return F.when(held < state.bitwiseAND(size - 1), state - held + level["step"]).otherwise(state)

    end = F.aggregate(levels, k.cast("long") * size + min_words, step)
    far = _let(F.shiftright(end, 20).cast("int"), lambda place: F.when(F.get(sums[0], place).isNotNull(), place - k + 1))
    return F.when(ones >= min_words, 1).when(twos >= min_words, 2).when(twos + F.get(sums[0], k + 2) >= min_words, 3).when(fours >= min_words, 4).otherwise(far)


def _spoken(found: Column, min_words: int) -> Column:
    """array<struct<h,w,p,c>> of the units with words: hash, words, number, and how many units from it on reach min_words."""

    def counted(v: Column) -> Column:
        def of(sums: list[Column]) -> Column:
            # Of fours as many as may be needed: texts with rows that long are few.
            fours, twos, ones = (F.struct(sums[j].alias("sums"), F.lit(1 << j + 20).cast("long").alias("step")) for j in (2, 1, 0))
            levels = F.concat(F.array_repeat(fours, -(-min_words // 4)), F.array(twos, ones))
            return _let(levels, lambda ls: F.transform(v, lambda x, k: F.struct(
                x["h"].alias("h"), x["w"].alias("w"), x["p"].alias("p"), _reach(sums, ls, k, min_words).alias("c"),
            )))

        return _let(F.transform(v, lambda x: x["w"]), lambda ws: _sums(ws, of))

    return _let(F.filter(found, lambda x: x["w"] > 0), counted)


def _selected(rows: Column) -> Column:
    """array<int>: which unit the window of each unit selects, null if too few words are left for one."""

    def of(order: Column) -> Column:
        two = lambda k: F.when(F.get(order, k) <= F.get(order, k + 1), k).otherwise(k + 1)
        least = lambda k, c: _let(F.slice(order, k + 1, c), lambda o: k + F.array_position(o, F.array_min(o)).cast("int") - 1)
        return F.transform(rows, lambda x, k: F.when(x["c"] == 1, k).when(x["c"] == 2, two(k)).when(x["c"] > 2, least(k, x["c"])))

    return _let(F.transform(rows, lambda x: F.shiftleft(-F.least(x["w"], F.lit(MOST)).cast("long"), 40) + x["h"].bitwiseAND((1 << 40) - 1)), of)


def _places(n: Column, rows: Column) -> Column:
    """array<struct<f,n,first,starts,hs,ms>>: each selected unit's hash, and the units around it that the minimal runs from the units that selected it touch.

    ``starts`` units from number ``first`` on, of those in ``hs``, selected it; ``ms`` packs place, words and ``c`` of each.
    """

    def of_places(hs: Column, ms: Column, chosen: Column, opens: Column) -> Column:
        def place(k: Column, i: Column) -> Column:
            # Windows begin and end in order, so those that select one unit are neighbours.
            beyond = F.coalesce(F.get(opens, i + 1), F.size(F.filter(chosen, lambda a: a.isNotNull())))
            a = F.greatest(k - 1, F.lit(0))
            z = F.least(F.coalesce(beyond - 1 + F.get(rows, beyond)["c"], F.size(rows) - 1), F.size(rows) - 1)
            f = F.get(hs, F.get(chosen, k))
            return F.struct(f.alias("f"), n.alias("n"), (k - a).alias("first"), (beyond - k).alias("starts"), F.slice(hs, a + 1, z - a + 1).alias("hs"), F.slice(ms, a + 1, z - a + 1).alias("ms"))

        return F.transform(opens, place)

    packed = lambda x: F.shiftleft(x["p"].cast("long"), 32) + F.shiftleft(F.least(x["w"], F.lit(MOST)).cast("long"), 16) + F.coalesce(x["c"], F.lit(0))
    new = lambda chosen: F.filter(F.transform(chosen, lambda a, k: F.when(a != F.coalesce(F.get(chosen, k - 1), F.lit(-1)), k)), lambda k: k.isNotNull())
    return _let(_selected(rows), lambda chosen: _let(new(chosen), lambda opens: _let(F.transform(rows, packed), lambda ms: _let(rows["h"], lambda hs: of_places(hs, ms, chosen, opens)))))


def _around(hs: Column, ms: Column) -> Column:
    """array<struct<h,w,p,gap,c>>: the units of a place, with the units without words before each; for the first it is right if that is the text's first."""
    p = lambda m: F.shiftright(m, 32).cast("int")
    c = lambda m: F.nullif(m.bitwiseAND(MOST).cast("int"), F.lit(0))
    return F.transform(ms, lambda m, i: F.struct(
        F.get(hs, i).alias("h"), F.shiftright(m, 16).bitwiseAND(MOST).cast("int").alias("w"), p(m).alias("p"), (p(m) - F.coalesce(p(F.get(ms, i - 1)), F.lit(-1)) - 1).alias("gap"), c(m).alias("c"),
    ))


def _described(n: Column, rows: Column, first: Column, starts: Column, long_unit: int) -> Column:
    """array<struct<core,from,to,led,lead,trailed,trail>>: hashes of the shortest runs from each start on, and of those from it that are the shortest up to their last unit.

    A run also counts with ``led`` to ``lead`` units without words before it, and ``trailed`` to
    ``trail`` after it.
    """
    none = F.lit(None).cast("int")

    def of_parts(parts: Column) -> Column:
        def run(a: Column, m: Column, start: Column, end: Column, blanks: tuple = (0, 0, 0, 0)) -> Column:
            core = F.xxhash64(F.get(rows, a)["h"], F.slice(parts, a + 2, m - 1))
            return F.struct(core.alias("core"), start.alias("from"), end.alias("to"), *((x if isinstance(x, Column) else F.lit(x)).cast("int").alias(k) for k, x in zip(("led", "lead", "trailed", "trail"), blanks, strict=True)))

        def of(x: Column, k: Column) -> Column:
            next_one, before = F.get(rows, k + 1), F.get(rows, k - 1)
            at = lambda i: F.get(rows, i)["p"]
            after_of = lambda j: F.coalesce(F.get(rows, j + 1)["gap"], n - 1 - at(j))
            # Two units are needed: one with enough words takes the next (a blank one is met from its own side).
            short_one = (x["c"] == 1) & (x["w"] < long_unit)
            m = F.when(~short_one, x["c"]).when(next_one["gap"] == 0, 2).otherwise(none)
            ahead = F.when(m.isNotNull(), run(k, m, x["p"], at(k + m - 1), (0, F.when(short_one, 0).otherwise(x["gap"]), 0, 0)))
            led = F.when(short_one & (x["gap"] > 0), run(k, F.lit(1), x["p"], x["p"], (1, x["gap"], 0, 0)))
            # After a long unit, which is a run by itself, one with enough words that needs another.
            behind = F.when(short_one & (x["gap"] == 0) & (before["w"] >= long_unit), run(k - 1, F.lit(2), before["p"], x["p"]))
            # The units up to which this one begins the shortest run: from where its own run ends to before the next one's does.
            low, high = k + x["c"] - 1, F.coalesce(k + next_one["c"] - 1, F.size(rows) - 1)
            known = lambda j: (j == low) | (short_one & (j == k + 1) & (F.get(rows, j)["gap"] == 0))
            wanted = F.filter(F.sequence(low, high), lambda j: ~known(j) | (after_of(j) > 0))
            ends = F.transform(wanted, lambda j: run(k, j - k + 1, x["p"], at(j), (0, 0, F.when(known(j), 1).otherwise(0), after_of(j))))
            usual = ~short_one & ((low > high) | ((low == high) & (after_of(low) == 0)))
            return F.when(x["c"].isNull(), F.array().cast(kind)).when(usual, F.array(ahead)).otherwise(F.concat(F.array(ahead, led, behind), F.when(low <= high, ends).otherwise(F.array().cast(kind))))

        return F.flatten(F.transform(F.sequence(first, first + starts - 1), lambda k: of(F.get(rows, k), k)))

    kind = "array<struct<core:bigint,from:int,to:int,led:int,lead:int,trailed:int,trail:int>>"
    return _let(F.transform(rows, lambda x: F.xxhash64(x["h"], x["gap"])), of_parts)


def _fingerprints(src: DataFrame, min_words: int, sentences: bool) -> DataFrame:
    """(id, th, f, n, first, starts, hs, ms): the selected places of each text."""
    places = _let(_measured(F.col("_text"), sentences), lambda found: _let(_spoken(found, min_words), lambda rows: _places(F.size(found), rows)))
    return src.select("id", F.xxhash64("_text").alias("th"), F.inline(places))


def _extended(places: DataFrame, long_unit: int, *keep: str) -> DataFrame:
    """(id, th, hash, from, to) and ``keep``: the minimal runs around places."""
    described = _let(_around(F.col("hs"), F.col("ms")), lambda rows: _described(F.col("n"), rows, F.col("first"), F.col("starts"), long_unit))
    runs = places.select("id", "th", *keep, F.inline(described)).filter("core is not null")
    # Units without words before or after a run make longer ones.
    runs = runs.withColumn("before", F.explode(F.sequence("led", "lead"))).withColumn("after", F.explode(F.sequence("trailed", "trail")))
    return runs.select("id", "th", *keep, F.xxhash64("before", "after", "core").alias("hash"), (F.col("from") - F.col("before")).alias("from"), (F.col("to") + F.col("after")).alias("to"))


def repeated_units(docs: DataFrame, long_unit: int = LONG_UNIT, min_words: int = MIN_WORDS, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, runs array<struct<from,to>>, n_deleted): the units of each document to delete, if any.

    ``th`` is the hash of the text; ``from`` and ``to`` are unit numbers, both included.
    """
    if max(long_unit, min_words) > MOST:
        raise ValueError(f"long_unit and min_words are at most {MOST}")
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    places = _fingerprints(src, min_words, sentences)
    # The first places have rank 1: more than one row if rows are equal in id and text.
    ranked = lambda df, *by: df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy("id", "th", "from")))
    met = lambda df, *by: df.withColumn("met", F.count("*").over(Window.partitionBy(*by)))
    # Fingerprints of very many places, as a share of the documents shows them, are no single groups: their runs
    # are ranked by parts, and then the first places of the parts among themselves.
    some = _fingerprints(src.filter(F.pmod(F.xxhash64("id", F.octet_length("_text")), F.lit(SHARE)) == 0), min_words, sentences)
    hot = cut(some.groupBy("f").agg(F.count("*").alias("seen")).filter(F.col("seen") > HOT // SHARE).select("f"))
    # Equal runs have equal fingerprints, so they are ranked where their places met, without another exchange.
    if hot.isEmpty():
        runs = ranked(_extended(met(places, "f").filter("met > 1"), long_unit, "f"), "f", "hash").filter("rank > 1")
    else:
        parts = places.join(small_or_not(hot.withColumn("hot", F.lit(True))), "f", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("th", "id"), F.lit(PARTS))).otherwise(0))
        found = _extended(met(parts, "f", "part").filter("met > 1 or hot"), long_unit, "f", "part", "hot")
        found = cut(ranked(found, "f", "part", "hash").filter("rank > 1 or hot").select("hash", "id", "th", "from", "to", "rank"))
        runs = found.filter("rank > 1").drop("rank", "hash").unionByName(ranked(found.filter("rank = 1").drop("rank"), "hash").filter("rank > 1").drop("rank", "hash"))
    runs = runs.select("id", "th", "from", "to")
    # Runs overlap: they are merged.
    w = Window.partitionBy("id", "th").orderBy("from", "to")
    runs = runs.withColumn("gap", F.coalesce((F.col("from") > F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("block", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("id", "th", "block").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return merged.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"), F.sum(F.col("to") - F.col("from") + 1).alias("n_deleted"))


def dedup_lines(docs: DataFrame, sentences: bool = True, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_deleted", **limits: int) -> DataFrame:
    """``docs`` with ``text_col`` without its later repeated runs, and ``count_col`` (units deleted), in the place of a column of that name. Other columns stay."""
    with passing():
        found = cut(repeated_units(docs, sentences=sentences, id_col=id_col, text_col=text_col, **limits), outlive=True)
    found = found.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("runs").alias("__runs"), F.col("n_deleted").alias("__n"))
    keyed = docs.withColumn("__hash", F.xxhash64(text_of(text_col)))
    # What is found grows with the documents: it is broadcast only up to so many runs, and joined by a sorted merge beyond.
    n_rows, n_runs = found.agg(F.count("*"), F.sum(F.size("__runs"))).first()
    found = F.broadcast(found) if n_rows + (n_runs or 0) <= BROADCAST_RUNS else found.hint("merge")
    out = keyed.join(found, keyed[id_col].eqNullSafe(found["__id"]) & (keyed["__hash"] == found["__th"]), "left")
    units = _units(text_of(text_col), sentences)
    left = F.filter(units, lambda u, i: ~F.exists("__runs", lambda r: (i >= r["from"]) & (i <= r["to"])))
    text = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(left, ""))
    kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    return out.select(*kept, F.coalesce("__n", F.lit(0)).cast("long").alias(count_col))
