"""MinHash near-duplicates: minima of many universal hashes, banding, verification, components.

Rows with one set of shingles are a class, met by a fingerprint of the set;
all further work is on class representatives (the least id). Their band keys
file them in buckets. In each bucket every member is tried against the least
and the greatest one (not against all): the signatures first, then the full
sets. Components of those links follow. What stars can miss is a link between
members of a bucket that are in different components, so in buckets that still
hold several, every member outside the commonest component is tried against all
members of other components. Such a bucket is dealt to cells of bounded size,
a block of strangers with a block of members each. A cell compares signatures,
tries a pair only in the first bucket that it shares, by sets whose hashes are cut
to 32 bits, and stops for a component that a member has already been linked with.
So no candidate pair across components is left untried, and only what these sets
link is a row, for confirmation.

With 30 bands of 5 minima a pair at a similarity of 0.8 is missed with a
probability of 7e-6, one at 0.9 with 1e-12. Signatures for verification keep
one byte of each minimum; a pair is dropped unseen only at an estimate four
standard deviations below the threshold. Every link is confirmed on full sets.

Nulls: a null text is an empty one. A text without words has no shingles, and is
linked with nothing. A row without an id takes no part: its component is null
and it is kept. Rows that share an id are one document in the graph: they count
as linked. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut, drop_cut, text_of
from cardweave.llm.components import components
from cardweave.llm.words import mix, shingle_set, word_hashes

BANDS, ROWS = 30, 5
#: Members and bytes of their sets in a block of a cell, and how many candidates of a member are confirmed at once.
BLOCK, BLOCK_BYTES, AT_ONCE = 512, 8_000_000, 32
_N = BANDS * ROWS
_RANDOM = np.random.default_rng(20240607)
_A = (_RANDOM.integers(0, 1 << 31, _N, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, _N, dtype=np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 512):
        out = np.minimum(out, (np.multiply.outer(_A, x[s : s + 512]) + _B[:, None]).min(axis=1))
    return out


def packed(signature: np.ndarray) -> np.ndarray:
    """The last byte of each minimum, eight to a number."""
    return np.pad((signature & np.uint32(255)).astype(np.uint8), (0, -len(signature) % 8)).view(np.int64)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def _fingerprint(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def describe(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, fp, bands, signature) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, fp, bands, signatures = [], [], [], []
            for text in frame["_text"]:
                s = shingle_set(word_hashes(text), k)
                n.append(len(s))
                fp.append(_fingerprint(s.tobytes()) if len(s) else None)
                m = minima(s) if len(s) else None
                bands.append(band_keys(m) if len(s) else None)
                signatures.append(packed(m) if len(s) else None)
            yield pd.DataFrame({"id": frame["id"], "n_shingles": n, "fp": fp, "bands": bands, "signature": signatures})

    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, n_shingles long, fp binary, bands array<long>, signature array<long>")


def _enough(percent: int) -> int:
    """How many of the signature's bytes must agree for a link to be possible."""
    least = percent / 100
    estimate = least - 4 * (least * (1 - least) / _N) ** 0.5
    return int(np.floor(_N * (estimate + (1 - estimate) / 256)))


def _alike(su: Column, sv: Column, percent: int) -> Column:
    """Whether signatures (arrays of longs, one byte for each hash) agree often enough for a link."""

    def differing(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(0x0101010101010101))

    count = F.aggregate(F.zip_with(su, sv, differing), F.lit(0), lambda t, x: t + x)
    return count <= _N - _enough(percent)


def _sizes_fit(nu: Column, nv: Column, percent: int) -> Column:
    return 100 * F.least(nu, nv) >= percent * F.greatest(nu, nv)


def _agreeing(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) that may be links by size and signature."""
    a, b = (signatures.select(F.col("rep").alias(x), F.col("signature").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "uv")
    return pairs.join(a, "u").join(b, "v").filter(_sizes_fit(F.col("nu"), F.col("nv"), percent) & _alike(F.col("su"), F.col("sv"), percent)).select("u", "v")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = []
            for x, y in zip(frame["su"], frame["sv"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[ok, ["u", "v"]]

    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInPandas(run, f"u {kind}, v {kind}")


def _short(shingles: bytes) -> bytes:
    """The set with 32-bit hashes: equal shingles stay equal, so what two sets share is not underrated but for repeats inside a set."""
    return np.unique((np.frombuffer(shingles, np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes()


class _Cell:
    """The strangers (rows) and members (columns) of a cell, and the links between them."""

    def __init__(self, frame: pd.DataFrame, percent: int):
        self.percent = percent
        self.side = frame["side"].to_numpy()
        self.key = np.int64(frame["key"].iloc[0]).astype(np.int32)
        self.main = frame["main"].iloc[0]
        self.rep, self.component, self.n = (frame[c].to_numpy() for c in ("rep", "component", "n_shingles"))
        self.signature = np.stack([np.frombuffer(x, np.uint8) for x in frame["signature"]])
        self.bands = np.stack([np.frombuffer(x, np.int32) for x in frame["bands"]])
        self.sets = [np.frombuffer(x, np.uint32) for x in frame["shingles"]]
        self.size = np.array([len(x) for x in self.sets])
        self.root: dict = {}

    def _find(self, x):
        while (up := self.root.get(x, x)) != x:
            x = up
        return x

    def _linked(self, u: int, candidates: np.ndarray) -> np.ndarray:
        """Which candidates are links of u by the short sets; those that a set loses to repeats count as shared."""
        size, n = self.size[candidates], self.n[candidates]
        body = np.concatenate([self.sets[j] for j in candidates])
        at = np.minimum(np.searchsorted(self.sets[u], body), self.size[u] - 1)
        both = np.add.reduceat((self.sets[u][at] == body).astype(np.int64), np.cumsum(size) - size) + np.minimum(n - size, self.n[u] - self.size[u])
        return 100 * both >= self.percent * (n + self.n[u] - both)

    def links(self) -> list[tuple]:
        out = []
        members, enough = np.flatnonzero(self.side == 1), _enough(self.percent)
        signature, bands, n, component, rep = (x[members] for x in (self.signature, self.bands, self.n, self.component, self.rep))
        for u in np.flatnonzero(self.side == 0):
            # Two strangers of one bucket meet twice: once is enough.
            fit = (component != self.component[u]) & ((component == self.main) | (rep < self.rep[u])) & (100 * np.minimum(n, self.n[u]) >= self.percent * np.maximum(n, self.n[u]))
            some = np.flatnonzero(fit)
            agree = (signature[some] == self.signature[u]).sum(axis=1)
            some, agree = some[agree >= enough], agree[agree >= enough]
            # The first shared band's bucket tries the pair.
            first = np.argmax(bands[some] == self.bands[u], axis=1)
            here = self.bands[u][first] == self.key
            some = some[here][np.argsort(-agree[here], kind="stable")]
            while len(some):
                now, some = some[:AT_ONCE], some[AT_ONCE:]
                for j in members[now][self._linked(u, members[now])]:
                    a, b = self._find(self.component[u]), self._find(self.component[j])
                    if a != b:
                        self.root[max(a, b)] = min(a, b)
                        out.append((self.rep[u], self.rep[j]))
                if self.root and len(some):
                    own = self._find(self.component[u])
                    some = some[[self._find(x) != own for x in component[some]]]
        return out


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of one bucket that are in different components."""
    labelled = members.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = cut(labelled)
    counts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = cut(counts.groupBy("key").agg(F.count("*").alias("components"), F.max_by("component", F.struct("n", "component")).alias("main")).filter("components > 1").select("key", "main"))
    size = sets.groupBy("rep").agg(F.sum("n_shingles").alias("n"))
    inside = cut(labelled.join(mixed, "key").join(size, "rep").withColumn("stranger", F.col("component") != F.col("main")))
    # A block holds so many members, and so many bytes of sets: blocks of a bucket are dealt by a hash.
    sizes = inside.groupBy("key").agg(*(F.greatest(F.ceil(F.count(F.when(c, 1)) / BLOCK), F.ceil(F.sum(F.when(c, 4 * F.col("n"))) / BLOCK_BYTES)).alias(k) for k, c in (("rows", F.col("stranger")), ("columns", F.lit(True)))))
    dealt = inside.join(cut(sizes), "key").withColumn("hash", F.xxhash64("rep"))
    own = lambda n: F.pmod(F.col("hash"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fields = ["key", "rep", "component", "main"]
    cells = dealt.filter("stranger").select(*fields, F.lit(0).alias("side"), own("rows").alias("i"), every("columns").alias("j")).unionByName(dealt.select(*fields, F.lit(1).alias("side"), own("columns").alias("j"), every("rows").alias("i")))

    def shorten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "rep": frame["rep"], "n_shingles": frame["n_shingles"], "shingles": [_short(x) for x in frame["shingles"]],
                "signature": [np.asarray(x, np.int64).tobytes()[:_N] for x in frame["signature"]], "bands": [np.asarray(x, np.int64).astype(np.int32).tobytes() for x in frame["bands"]],
            })

    kind = members.schema["rep"].dataType.simpleString()
    short = sets.join(inside.select("rep").distinct(), "rep", "left_semi").mapInPandas(shorten, f"rep {kind}, n_shingles long, shingles binary, signature binary, bands binary")
    cells = cells.join(short, "rep").withColumn("cell", F.xxhash64("key", "i", "j"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def close() -> Iterator[pd.DataFrame]:
            if held:
                found = _Cell(pd.concat(held, ignore_index=True), percent).links()
                held.clear()
                if found:
                    yield pd.DataFrame(found, columns=["u", "v"])

        last = None
        for frame in frames:
            at = np.stack([frame[c].to_numpy() for c in ("cell", "key", "i", "j")])
            edge = np.flatnonzero(np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(axis=0)))) if len(frame) else np.zeros(0, int)
            for s, e in zip(edge, np.append(edge[1:], len(frame)), strict=True):
                if tuple(at[:, s]) != last:
                    yield from close()
                    last = tuple(at[:, s])
                held.append(frame.iloc[s:e])
        yield from close()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = cut(cells.repartition(n, "cell").sortWithinPartitions("cell", "key", "i", "j").mapInPandas(run, f"u {kind}, v {kind}").distinct())
    drop_cut(labelled, mixed, inside)
    found = cut(_confirmed(pairs, sets, percent).distinct())
    drop_cut(pairs)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; shingles of k words, links from percent / 100 on."""
    rows = cut(describe(docs, k, id_col, text_col))
    known = rows.filter("fp is not null and id is not null")
    reps = cut(known.groupBy("fp").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    # Buckets of two or more.
    filed = reps.select("rep", F.explode("bands").alias("key"))
    shared = cut(filed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high"))
    members = cut(filed.join(shared, "key"))
    candidates = cut(members.select("rep").distinct())

    def with_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(word_hashes(t), k).tobytes() for t in frame["_text"]]
            yield pd.DataFrame({"rep": frame["rep"], "fp": [_fingerprint(s) for s in sets], "shingles": sets})

    kind = reps.schema["rep"].dataType.simpleString()
    signatures = cut(reps.join(candidates, "rep", "left_semi").select("rep", "fp", "n_shingles", "signature", "bands"))
    texts = docs.select(F.col(id_col).alias("rep"), text_of(text_col).alias("_text")).join(candidates, "rep", "left_semi")
    sets = texts.mapInPandas(with_sets, f"rep {kind}, fp binary, shingles binary").groupBy("rep", "fp").agg(F.first("shingles").alias("shingles"))
    # Rows that share an id stand for one document, each with its own set.
    sets = cut(signatures.join(sets, ["rep", "fp"]).select("rep", "n_shingles", "signature", "bands", "shingles"))
    star = members.select(F.col("rep").alias("u"), F.explode(F.array("low", "high")).alias("v")).filter("u != v")
    pairs = cut(_agreeing(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), signatures, percent))
    first = cut(_confirmed(pairs, sets, percent).distinct())
    drop_cut(pairs, shared, candidates)
    same_id = known.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b")
    # Rows of one id in several classes tie these together.
    tied = known.join(same_id.select("id"), "id", "left_semi").join(reps.select("fp", "rep"), "fp").filter("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    labels = cut(components(first.unionByName(tied)))
    last = _across(members, labels, sets, percent)
    drop_cut(first, members, sets, signatures)
    if not last.isEmpty():
        before = labels
        labels = cut(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(last)))
        drop_cut(before)
    drop_cut(last)
    of_class = reps.select("fp", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    # Rows without words are their own components, and no hot key of the join.
    out = rows.filter("fp is not null").select("id", "n_shingles", "fp").join(of_class, "fp", "left").select("id", "n_shingles", "component")
    out = out.unionByName(rows.filter("fp is null").select("id", "n_shingles", F.col("id").alias("component")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    """Two-word shingles at 0.8 over ``documents``."""
    return near_duplicates(docs, k=2, percent=80).withColumnRenamed("id", "doc_id")
