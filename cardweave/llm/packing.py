"""Best-fit packing: document pieces into sequences of a fixed number of tokens.

Only the histogram of piece lengths (at most ``size`` rows, however many
documents there are) reaches the driver. There patterns of few lengths that
fill a sequence are enumerated, how often to repeat each is fitted to the
histogram by non-negative least squares and rounded down, and what is left
over is packed best fit first. The result is a plan of places, run-length coded:
at most a few thousand rows, whatever the input. Every piece then finds its
place by its rank among the pieces of its length. Ranks come from windows over
(length, bucket), with as many buckets as the pieces of a length ask for, and
bucket totals, so a length that holds most pieces is no hot group. Pieces that
fill a sequence need no place.

Nulls: a null text is an empty one, and has only the end token. Repeated rows
are packed each on their own. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardweave.llm.common import cut, recall, text_of

SIZE, END_ID = 2048, 0
#: Pieces in one ranking group.
BUCKET_ROWS = 20_000

# The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _plain_byte_level(tokenizer) -> bool:
    """Whether a tokenizer is byte-pair merges by rank over byte-level pieces by PATTERN, and nothing else."""
    form = json.loads(tokenizer.to_str())
    pieces, model, vocab = form["pre_tokenizer"] or {}, form["model"], form["model"].get("vocab", {})
    if form["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    if (pieces.get("type"), pieces.get("use_regex"), pieces.get("add_prefix_space")) != ("ByteLevel", True, False):
        return False
    # Ids in the order of merges, and no two merges to one token.
    made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    return None not in made and all(a < b for a, b in itertools.pairwise(made))


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, as the tokenizer file gives them.

    A space always begins a pre-token unless it ends a run of white space, and
    merges never cross pre-tokens: without double or trailing spaces, the ids of
    a text are those of its pieces between spaces, which can be remembered.
    Pieces that are new are merged by rank, which for this vocabulary (ids in
    the order of merges) is the same thing and faster. Texts that may hold a
    special token go through the tokenizer itself, as do all texts if the file
    describes any other tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer_path)
        self.merge = None
        self.known: dict[str, bytes] = {}
        if not _plain_byte_level(self.full):
            return
        # Byte-level files write each byte as a printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.full.get_vocab(with_added_tokens=False).items() if all(c in byte for c in token)}
        added = {x.content for x in self.full.get_added_tokens_decoder().values()}
        for x in added:
            ranks.pop(x.encode(), None)
        self.starts = tuple({x[:2] for x in added})
        self.merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.merge is None or any(x in text for x in self.starts):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text or text.endswith(" "):
            return array("I", self.merge(text)).tobytes()
        first, *rest = text.split(" ")
        ids = recall(rest, self.known, lambda w: array("I", self.merge(" " + w)).tobytes())
        return array("I", self.merge(first)).tobytes() + b"".join(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    """One for each file and worker process."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first is the shorter one."""
    first = n - size * ((n - 1) // size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenize(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, n_tokens): the pieces of each row's ids and the end id."""
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_path)
        try:
            for frame in frames:
                rows = []
                for at, text in enumerate(frame["_text"]):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    rows += [(at, k, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n) for k, (s, m) in enumerate(cut_points(n, size))]
                at, piece, start, length, crc, n = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [()] * 6))
                yield pd.DataFrame({"id": frame["id"].iloc[at].to_numpy(), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc, "n_tokens": n})
        finally:
            encode.known.clear()  # the encoder stays with the worker, the words go with the task

    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, n_tokens long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with a small |a x - b|: multiplicative updates, for non-negative a and b."""
    x = np.full(a.shape[1], b.sum() / max(1.0, a.sum()))
    ab = a.T @ b
    for _ in range(rounds):
        x *= ab / np.maximum(a.T @ (a @ x), 1e-12)
    return x


def patterns_of(lengths: np.ndarray, counts: np.ndarray, size: int, parts: int = 3, most: int = 1500) -> list[tuple[int, ...]]:
    """Tuples of two to ``parts`` lengths that fill ``size`` exactly, the commonest lengths first.

    The bound ``most`` is on the patterns tried, not on pieces: those in no
    pattern are packed best fit afterwards.
    """
    have = {int(x): int(c) for x, c in zip(lengths, counts, strict=True)}
    found: list[tuple[float, tuple[int, ...]]] = []
    common = [x for x, _ in sorted(have.items(), key=lambda i: (-i[1], i[0]))]
    for x in common:
        y = size - x
        if y in have and y <= x:
            found.append((min(have[x], have[y]), (x, y)))
    if parts >= 3:
        for i, x in enumerate(common[:160]):
            for y in common[i : 160]:
                z = size - x - y
                if z in have and z > 0:
                    found.append((min(have[x], have[y], have[z]) / 2, tuple(sorted((x, y, z), reverse=True))))
    best = dict.fromkeys(p for _, p in sorted(found, key=lambda f: (-f[0], f[1])))
    return list(best)[:most]


def plan_places(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern as (length, how many), repeats)]: together they hold every piece of the histogram."""
    left = {x: c for x, c in histogram.items() if c > 0 and x < size}
    plan: list[tuple[list[tuple[int, int]], int]] = []
    lengths = np.array(sorted(left), np.int64)
    patterns = patterns_of(lengths, np.array([left[x] for x in lengths.tolist()], np.int64), size) if len(lengths) else []
    if patterns:
        row = {int(x): i for i, x in enumerate(lengths)}
        a = np.zeros((len(lengths), len(patterns)))
        for j, p in enumerate(patterns):
            for x in p:
                a[row[x], j] += 1
        weight = 1 / np.sqrt(np.array([left[x] for x in lengths.tolist()], float))
        fit = nnls(a * weight[:, None], np.array([left[x] for x in lengths.tolist()], float) * weight)
        for j in np.argsort(-fit, kind="stable"):
            uses = [(x, patterns[j].count(x)) for x in sorted(set(patterns[j]), reverse=True)]
            k = min(int(fit[j]), *(left[x] // m for x, m in uses))
            if k > 0:
                plan.append((uses, k))
                for x, m in uses:
                    left[x] -= k * m
    # The rest, best fit first: the longest piece, then always the longest that still fits; repeated while the lengths last.
    present = sorted(x for x, c in left.items() if c)
    while present:
        room, uses = size, []
        top = len(present)
        while top and room >= present[0]:
            top = min(top, bisect.bisect_right(present, room))
            if not top:
                break
            x = present[top - 1]
            m = min(left[x], room // x)
            uses.append((x, m))
            room -= m * x
            top -= 1
        k = min(left[x] // m for x, m in uses)
        plan.append((uses, k))
        for x, m in uses:
            left[x] -= k * m
        present = [x for x in present if left[x]]
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, per sequence, offset): how pieces of that length are placed."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for uses, k in plan:
        offset = 0
        for x, m in uses:
            rows.setdefault(x, []).append((taken.get(x, 0), sequence, m, offset))
            taken[x] = taken.get(x, 0) + k * m
            offset += x * m
        sequence += k
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def rank_in_length(pieces: DataFrame, keys: list[str], counts: dict[int, int]) -> DataFrame:
    """``pieces`` with rank: 0, 1, 2 ... among those of equal length. ``counts`` says how many each length has.

    Only a length of more than BUCKET_ROWS pieces is dealt to several buckets.
    """
    buckets = pieces.sparkSession.createDataFrame([(x, max(1, n // BUCKET_ROWS + 1)) for x, n in counts.items()] or [(0, 1)], "length long, buckets long")  # at most as many rows as lengths
    bucketed = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.col("buckets"))).drop("buckets")
    sums = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*keys)) - 1
    return bucketed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("bucket", "own", "before")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (id, piece, length, ...), a written table, with sequence_id and offset."""
    spark = pieces.sparkSession
    part = pieces.filter(F.col("length") < size)
    histogram = {int(r["length"]): int(r["n"]) for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_places(histogram, size)
    table = spark.sparkContext.broadcast(places(plan))
    ranked = rank_in_length(part, ["id", "piece"], histogram)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = table.value
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for x in np.unique(length):
                own = length == x
                t = where[int(x)]
                r = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                past = rank[own] - r[:, 0]
                sequence[own] = r[:, 1] + past // r[:, 2]
                offset[own] = r[:, 3] + past % r[:, 2] * x
            yield frame.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema]
    placed = ranked.select(*part.columns, "rank").mapInPandas(place, ", ".join([*fields, "sequence_id long", "offset long"]))
    # Full pieces: a sequence each, with numbers that the plan does not use.
    full = pieces.filter(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, n_tokens, sequence_id, offset) of every piece of every row."""
    return pack(cut(tokenize(docs, tokenizer_path, size, end_id, id_col, text_col)), size)
