"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweave.plans.stage import drop_stage, passing, stage

#: ``cut`` ends a lineage in the shared folder, ``drop_cut`` deletes that table, ``passing`` all of a block's.
cut, drop_cut, passing = stage, drop_stage, passing

#: One ASCII white-space character, and a run of anything else (the contracts' words).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Words that a task remembers at once, and characters of the longest of them.
REMEMBERED, LONGEST = 300_000, 64


def text_of(text_col: str) -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def recall(words: list[str], known: dict[str, Any], work: Callable[[str], Any]) -> list:
    """``work`` (never None) of each word, from ``known`` if it is there; of ``REMEMBERED`` words there the older half is forgotten.

    A worker outlives its tasks, and serves other operators after them: ``known`` should be a task's own, and go with it.
    """
    found = list(map(known.get, words))
    if None in found:
        for i, w in enumerate(words):
            if found[i] is None:
                hit = known.get(w)
                if hit is None:
                    hit = work(w)
                    if len(w) <= LONGEST:
                        if len(known) >= REMEMBERED:
                            for old in list(islice(known, REMEMBERED // 2)):
                                del known[old]
                        known[w] = hit
                found[i] = hit
    return found


def small_or_not(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most so many; joined by a shuffle otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on keys: rows without an id still find themselves."""
    on = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[k])
    return on
