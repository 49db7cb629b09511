"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that starts anywhere else too.

1. Candidates. Every window of LENGTH bytes has an anchor: the least of its 64-byte
   rolling hashes (the leftmost of equals), which only depends on the window's bytes.
   Equal windows thus have equal anchors at equal offsets. The windows of an anchor's
   occurrence are consecutive; the bytes they span are its context. Anchors that occur
   once have no repeated window. Of the others, occurrences with equal contexts are
   one class; a class of two or more is repeated throughout, and stays as one partner
   for the rest.
2. Groups. The contexts of an anchor are a group. A group of more bytes than
   ``GROUP_SHARDS`` shards is dealt anew: its windows are halved by their offset from the
   anchor, and those of one half have a longer string in common, which is their new
   key. So a very common anchor is no task's burden; a half of one offset holds equal
   windows only.
3. Shards. Groups are packed to shards of about ``SHARD_BYTES``. For each, numpy builds
   the suffix array by Larsson-Sadakane refinement (suffixes are sorted by 8 bytes,
   then only groups that are not yet single are sorted anew by pairs of ranks) and
   common prefixes by Kasai's scan, run over many blocks of the text in step. Suffixes
   that start a window and have LENGTH bytes in common are repeats.
4. Merging. The shards of a group that fills several are merged pair by pair: the
   windows of one are found in the sorted ones of the other by binary search.
5. Spans of repeated bytes go back to their documents by a join.

Texts are UTF-8 bytes; matches never cross documents, and may overlap. A null text is
empty. Rows equal in id and text repeat each other, so all their bytes go if they
have LENGTH or more. Ids may be null. Classes are told apart by 128 bits (anchor and
context); what shards decide is compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut, drop_cut, text_of
from cardweave.llm.words import INVERSE, POWER, mix

LENGTH, ANCHOR, SHARD_BYTES, GROUP_SHARDS = 200, 64, 1_000_000, 4
_CHUNK, _BITS = 1 << 18, 18
WIDTH = LENGTH - ANCHOR + 1
#: Steps of the common-prefix scan: each block of so many bytes is scanned in step with all others.
_STEPS = 128


def _chunk_anchors(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, anchor hash, context hash) for all windows of b."""
    n = len(b)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * POWER[:n], out=total[1:])
    h = mix((total[ANCHOR:] - total[:-ANCHOR]) * INVERSE[: n - ANCHOR + 1])
    low = (h & ~np.uint64((1 << _BITS + 1) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= WIDTH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WIDTH:
        low = np.minimum(low[: -(WIDTH - span)], low[WIDTH - span :])
    place = (low & np.uint64((1 << _BITS + 1) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    end = last + LENGTH
    body = (total[end] - total[first]) * INVERSE[first]
    context = mix(mix(body + (place - first).astype(np.uint64)) + (last - first).astype(np.uint64))
    return place, first, last, h[place], context


def anchors(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for a whole text, windows taken in chunks."""
    parts = []
    for s in range(0, max(len(b) - LENGTH + 1, 0), _CHUNK):
        place, first, last, anchor, context = _chunk_anchors(b[s : s + _CHUNK + LENGTH - 1])
        parts.append((place + s, first + s, last + s, anchor, context))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Sorted(NamedTuple):
    """A shard: its bytes, eight bytes from each place as a number, its window starts in the order of their bytes, and which of these are repeated."""

    text: np.ndarray
    words: np.ndarray
    order: np.ndarray
    hit: np.ndarray


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by Larsson-Sadakane refinement."""
    n = len(words)
    order = np.argsort(words)
    rank = np.empty(n, np.int64)

    def heads(keys: np.ndarray) -> np.ndarray:
        """For each place the first place of its run of equal keys."""
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    place = heads(words[order])
    rank[order] = place
    slots, part, depth = np.arange(n), order, 8
    while True:
        # Only groups of two or more are refined.
        size = np.bincount(place, minlength=n)[place] if len(place) else place
        slots, part, place = slots[size > 1], part[size > 1], place[size > 1]
        if not len(part):
            return order, rank
        ahead = part + depth
        # Beyond the end the shorter suffix comes first.
        key = (place << np.int64(32)) | (np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n - 1 - ahead) + (1 << 31))
        by = np.argsort(key)
        part, key = part[by], key[by]
        place = slots[heads(key)]
        order[slots], rank[part] = part, place
        depth *= 2


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``order`` how many bytes its suffix and the one before have in common, ``most`` at most.

    Kasai's scan: what a suffix shares with its neighbour, the next suffix of the text
    shares but for one byte. Blocks of the text are scanned in step, eight bytes at a time.
    """
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    blocks = np.arange(0, n, _STEPS)
    shared = np.zeros(len(blocks), np.int64)
    steps = [np.uint64(1) << np.uint64(8 * k) for k in range(1, 8)]
    for t in range(min(_STEPS, n)):
        i = blocks[: len(blocks) - (blocks[-1] + t >= n)] + t
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(shared[: len(i)] - 1, 0))
        live = np.flatnonzero((j >= 0) & (h < most))
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            room = n - np.maximum(a, b)
            x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            same = np.full(len(live), 8) if not x.any() else np.where(x == 0, 8, 7 - sum((x >= s).astype(np.int64) for s in steps))
            h[live] += np.minimum(same, np.maximum(room, 0))
            live = live[(same == 8) & (room > 8) & (h[live] < most)]
        shared[: len(i)] = h
        out[i] = np.minimum(h, most)
    return out[order]


def sort_shard(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> Sorted:
    """The shard of these bytes, and which of the windows at ``starts`` are equal to another one."""
    words = words_of(text)
    order, _ = suffix_array(words)
    own = np.zeros(len(text), bool)
    own[starts] = True
    # Windows of one class are neighbours with the whole length in common.
    label = np.cumsum(common_prefixes(words, order, length) < length)
    own = own[order]
    order, label = order[own], label[own]
    return Sorted(text, words, order, np.bincount(label, minlength=1)[label] > 1)


def _compared(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1: how the windows of a at ``at`` compare with those of b at ``bt``; a and b are words."""
    out, live = np.zeros(len(at), np.int8), np.arange(len(at))
    for k in [*range(0, length - 8, 8), length - 8]:
        x, y = a[at[live] + k], b[bt[live] + k]
        apart = x != y
        out[live[apart]] = np.where(x[apart] < y[apart], -1, 1)
        live = live[~apart]
        if not len(live):
            break
    return out


def merge_shards(a: Sorted, b: Sorted, length: int = LENGTH) -> None:
    """Mark in both which windows the other has too: b's are found among a's sorted ones by binary search."""
    if not len(a.order) or not len(b.order):
        return
    low, high = np.zeros(len(b.order), np.int64), np.full(len(b.order), len(a.order))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        less = open_ & (_compared(a.words, a.order[np.minimum(mid, len(a.order) - 1)], b.words, b.order, length) < 0)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    at = np.minimum(low, len(a.order) - 1)
    met = (low < len(a.order)) & (_compared(a.words, a.order[at], b.words, b.order, length) == 0)
    # Equal windows inside a have been marked before, so the first of them is enough.
    a.hit[at[met]] = True
    b.hit[met] = True


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    return src.withColumn("th", F.xxhash64("_text"))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _occurrences(keyed: DataFrame, kind: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), 200):
                part = frame.iloc[s : s + 200]
                found = [anchors(_bytes(t)) for t in part["_text"]]
                n = [len(x[0]) for x in found]
                if sum(n):
                    place, first, last, anchor, context = (np.concatenate(x) for x in zip(*found, strict=True))
                    at = np.repeat(np.arange(len(part)), n)
                    yield pd.DataFrame({"id": part["id"].iloc[at].to_numpy(), "th": part["th"].iloc[at].to_numpy(), "place": place, "first": first, "last": last, "anchor": anchor.view(np.int64), "context": context.view(np.int64)})

    return keyed.select("id", "th", "_text").mapInPandas(run, f"id {kind}, th long, place long, first long, last long, anchor long, context long")


def _with_texts(keyed: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    w = wanted.withColumnsRenamed({"id": "w_id", "th": "w_th"})
    return keyed.join(w, keyed.id.eqNullSafe(w.w_id) & (keyed.th == w.w_th), how).drop("w_id", "w_th")


def _halve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of the two halves of each piece's offsets, keyed by what all windows of a half have in common."""
    names = ["id", "th", "grp", "near", "far", "at", "first", "n", "digest", "body"]
    for frame in frames:
        rows = []
        for i, th, grp, near, far, at, first, n, body in zip(*(frame[c] for c in ("id", "th", "grp", "near", "far", "at", "first", "n", "body")), strict=True):
            half = (near + far) // 2
            for p, q in ((near, half), (half + 1, far)):
                # Windows of the piece, by their starts, whose offset is from p to q.
                a, z = max(0, at - q), min(len(body) - LENGTH, at - p)
                if a <= z and p <= q:
                    core = hashlib.blake2b(body[at - p : at - q + LENGTH] + f"{p},{q},{grp}".encode(), digest_size=8).digest()
                    piece = body[a : z + LENGTH]
                    digest = hashlib.blake2b(piece + f"{at - a}".encode(), digest_size=16).digest()
                    rows.append((i, th, int.from_bytes(core, "little", signed=True), p, q, at - a, first + a, n, digest, piece))
        yield pd.DataFrame(rows, columns=names)


def _compare(shard_bytes: int):
    """Over pieces in the order of their groups: (id, th, lo, hi) of what is repeated."""

    def unit(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        size = part["body"].map(len).to_numpy(np.int64)
        shard = (np.cumsum(size) - size) // shard_bytes
        done: list[tuple[Sorted, pd.DataFrame, np.ndarray]] = []
        for k in np.unique(shard):
            own, length = part[shard == k], size[shard == k]
            begin, windows = np.cumsum(length) - length, length - LENGTH + 1
            starts = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
            done.append((sort_shard(np.frombuffer(b"".join(own["body"]), np.uint8), starts), own, begin))
        for (a, _, _), (b, _, _) in combinations(done, 2):
            merge_shards(a, b)
        for s, own, begin in done:
            start = np.sort(s.order[s.hit])
            row = np.searchsorted(begin, start, "right") - 1
            single = own["n"].to_numpy()[row] == 1
            row, start = row[single], start[single] - begin[row[single]] + own["first"].to_numpy(np.int64)[row[single]]
            if len(row):
                new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(start) != 1))))
                end = np.append(new[1:], len(row)) - 1
                yield pd.DataFrame({"id": own["id"].iloc[row[new]].to_numpy(), "th": own["th"].iloc[row[new]].to_numpy(), "lo": start[new], "hi": start[end] + LENGTH})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        last = None
        for frame in frames:
            grp = frame["grp"].to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1]))) if len(grp) else np.zeros(0, int)
            for s, e in zip(edge, np.append(edge[1:], len(grp)), strict=True):
                if size >= shard_bytes and grp[s] != last:
                    yield from unit(pd.concat(held, ignore_index=True))
                    held, size = [], 0
                part = frame.iloc[s:e]
                held.append(part)
                size += int(part["body"].map(len).sum())
                last = grp[s]
        if held:
            yield from unit(pd.concat(held, ignore_index=True))

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """(id, th, spans array<struct<lo,hi>>): repeated bytes of each text, from lo up to hi, not merged."""
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["id"].dataType.simpleString()
    all_of = cut(_occurrences(keyed, kind))
    again = cut(all_of.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    some = cut(all_of.join(again, "anchor"))
    drop_cut(all_of, again)
    classes = cut(some.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "first", "last", "place")).alias("rep")))
    # Anchors with a class of one and another class to compare it with.
    open_ones = cut(classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("classes > 1 and least = 1").select("anchor"))
    span = ("id", "th", "lo", "hi")
    whole = cut(some.join(classes.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("id", "th", F.col("first").alias("lo"), (F.col("last") + LENGTH).alias("hi")))
    drop_cut(some)
    wanted = classes.join(open_ones, "anchor").select("rep.*", "anchor", "n")
    per_text = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "n", "first", "last", "place")).alias("parts"))

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, th, text, parts in zip(frame["id"], frame["th"], frame["_text"], frame["parts"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(i, th, p["anchor"], 0, WIDTH - 1, p["place"] - p["first"], p["first"], p["n"], raw[p["first"] : p["last"] + LENGTH]) for p in parts]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["id", "th", "grp", "near", "far", "at", "first", "n", "body"])
                    rows = []
            yield pd.DataFrame(rows, columns=["id", "th", "grp", "near", "far", "at", "first", "n", "body"])

    piece = f"id {kind}, th long, grp long, near long, far long, at long, first long, n long"
    pieces = cut(_with_texts(keyed, per_text, "inner").mapInPandas(fetch, f"{piece}, body binary"))
    drop_cut(classes, open_ones)
    found, small = [whole], []
    while True:
        large = cut(pieces.groupBy("grp").agg(F.sum(F.length("body")).alias("bytes")).filter(F.col("bytes") > group_shards * shard_bytes).select("grp"))
        if large.isEmpty():
            small.append(pieces)
            break
        # Groups of many shards: their halves are classes and groups in their turn.
        small.append(cut(pieces.join(large, "grp", "left_anti")))
        halves = cut(pieces.join(large, "grp", "left_semi").mapInPandas(_halve, f"{piece}, digest binary, body binary"))
        drop_cut(pieces)
        rep = F.min(F.struct("id", "th", "near", "far", "at", "first", "body")).alias("rep")
        equal = cut(halves.groupBy("grp", "digest").agg(F.sum("n").alias("total"), rep))
        found.append(cut(halves.filter("n = 1").join(equal.filter("total > 1").select("grp", "digest"), ["grp", "digest"]).select("id", "th", F.col("first").alias("lo"), (F.col("first") + F.length("body")).alias("hi"))))
        still = equal.groupBy("grp").agg(F.count("*").alias("classes"), F.min("total").alias("least")).filter("classes > 1 and least = 1").select("grp")
        pieces = cut(equal.join(still, "grp").select("rep.*", "grp", F.col("total").alias("n")).select("id", "th", "grp", "near", "far", "at", "first", "n", "body"))
        drop_cut(halves, equal)
    of_shards = small[0]
    for more in small[1:]:
        of_shards = of_shards.unionByName(more)
    volume = of_shards.agg(F.sum(F.length("body"))).first()[0] or 0
    dealt = of_shards.select("id", "th", "grp", "first", "n", "body").repartition(int(volume // (2 * shard_bytes)) + 1, "grp").sortWithinPartitions("grp")
    found.append(cut(dealt.mapInPandas(_compare(shard_bytes), f"id {kind}, th long, lo long, hi long")))
    drop_cut(*small)
    spans = found[0].select(*span)
    for more in found[1:]:
        spans = spans.unionByName(more.select(*span))
    return spans.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): the remaining bytes of each text."""
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["id"].dataType.simpleString()
    spans = cut(repeated_spans(docs, id_col, text_col, **options))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, text, found in zip(frame["id"], frame["_text"], frame["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, at, removed, runs, open_to = [], 0, 0, 0, -1
                for lo, hi in sorted((p["lo"], p["hi"]) for p in (found if found is not None else ())):
                    if lo > open_to:
                        kept.append(raw[at:lo])
                        runs += 1
                    if hi > open_to:
                        removed += hi - max(lo, open_to, 0) if open_to >= 0 else hi - lo
                        open_to = at = hi
                kept.append(raw[at:])
                rows.append((i, len(raw), removed, runs, b"".join(kept)))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_texts(keyed, spans, "left").select("id", "_text", "spans").mapInPandas(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
