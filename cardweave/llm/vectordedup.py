"""Near-duplicate vectors over a flat, robust-pruned graph.

Equal vectors are one class first. A k-means fit on a bounded sample gives cells; each class goes to
its nearest few, so shards overlap. Each shard builds a graph on its members: nearest candidates and a few
random ones, thinned by robust pruning, with reverse edges. The adjacency lists of a vector from all its shards are
united. Each shard then searches the united graph for each of its members: greedily from the shard's medoid, and from
what is within range on and on, until no neighbour within range is left. What that finds is verified in double precision.
A pair that shares several cells is counted in the first of them, so no list of pairs is ever shuffled: a
task sends counts and, for components, one edge for each vector. A shard above a bound is dealt into parts by hash, and a task takes
two parts, so each pair of the shard meets in one task of bounded size. An audit compares a
sample of vectors with all vectors and widens shards and beam until recall is reached.

Defined results: vectors that are null, zero, empty, or hold nulls, NaN or infinities link with nothing, and vectors of different lengths do not link.
Equal rows link with each other, also under one id. A row without an id is a vector like others and cannot name a component; where no vector has an id the component is null and
the row is kept. A cosine of exactly the threshold links. An empty table gives an empty result. Other columns, whatever their names, are not read.
Vectors are told apart by 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut, passing
from cardweave.llm.components import components
from cardweave.llm.vectors import add_up, finite, matrix

#: Vectors (the first by hash) that the cells are fitted on, and cells at most.
SAMPLE, CELLS = 16_384, 1024
#: Members that a shard aims at, and has at most before it is dealt into parts of half as many.
SHARD, LARGEST = 1500, 4096
#: Neighbours kept of the nearest candidates and of random ones, and how many candidates of each.
NEAR, FAR, NEAR_OF, FAR_OF = 24, 8, 64, 24
ALPHA = 1.2
#: Vectors whose links are counted against all vectors, the recall to reach, and how often to widen for it.
AUDIT, RECALL, TRIES = 512, 0.98, 3
#: Queries searched in step, and (query, node) pairs compared at a time.
TOGETHER, PAIRS = 256, 1 << 17
#: Single precision guides the search; what it sees this far below the threshold is still verified.
MARGIN = 1e-3


@dataclass
class Width:
    """How many cells a vector goes to, and how many of the best nodes a search keeps."""

    overlap: int = 3
    beam: int = 48
    step: int = 4


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow on the way."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _unpacked(v: pd.Series | list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of packed ones, which are as narrow as the table's."""
    raw = b"".join(v)
    return unit(np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(v) else np.float64).reshape(-1, dim).astype(np.float64))


def fit_cells(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample of unit vectors."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres)
    return centres


def robust_prune(sims: np.ndarray, cand: np.ndarray, of: np.ndarray, keep: int) -> np.ndarray:
    """Neighbours for each row: the nearest candidate again and again, without those that are much nearer to it than to the row.

    ``cand`` are candidates of each row (-1 for none), ``of`` their cosines with the row, ``sims`` the members' cosines. -1 fills up.
    """
    out, rows = np.full((len(cand), keep), -1, np.int64), np.arange(len(cand))
    of = np.where(cand >= 0, of, -np.inf)
    for i in range(keep):
        best = of.argmax(1)
        there = np.isfinite(of[rows, best])
        if not there.any():
            break
        star = cand[rows, best]
        out[there, i] = star[there]
        # alpha * d(star, c) <= d(row, c), with d squared = 2 - 2 cos
        near = ALPHA**2 * (1 - sims[star[:, None], cand]) <= 1 - of
        of[near | (cand == star[:, None])] = -np.inf
    return out


def build(v: np.ndarray) -> np.ndarray:
    """Adjacency lists (-1 fills up) of a shard of unit vectors in single precision."""
    n = len(v)
    if n < 2:
        return np.full((n, 1), -1, np.int64)
    sims = v @ v.T
    np.fill_diagonal(sims, -np.inf)
    k = min(NEAR_OF, n - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(n).integers(0, n, (n, FAR_OF))
    far[far == np.arange(n)[:, None]] = -1
    np.fill_diagonal(sims, 1.0)
    rows = np.arange(n)[:, None]
    lists = np.hstack([robust_prune(sims, near, sims[rows, near], NEAR), robust_prune(sims, far, sims[rows, far], FAR)])
    # Reverse edges, the nearest of them, so a node that is no one's near neighbour elsewhere can be reached as well.
    src, dst = np.repeat(np.arange(n), lists.shape[1]), lists.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((-sims[dst, src], dst))
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    first = rank < NEAR
    back = np.full((n, NEAR), -1, np.int64)
    back[dst[first], rank[first]] = src[first]
    return np.hstack([lists, back])


def _compare(v: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.empty(len(q), np.float32)
    for a in range(0, len(q), PAIRS):
        out[a : a + PAIRS] = np.einsum("ij,ij->i", v[q[a : a + PAIRS]], v[node[a : a + PAIRS]])
    return out


def _fresh(adj: np.ndarray, q: np.ndarray, node: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) pairs of expanded nodes that were not seen yet; they are marked."""
    nb = adj[node]
    qq = np.repeat(q, nb.shape[1])
    nb = nb.ravel()
    ok = nb >= 0
    qq, nb = qq[ok], nb[ok]
    flat = qq * seen.shape[1] + nb
    flat = np.unique(flat[~seen.ravel()[flat]])
    seen.ravel()[flat] = True
    return flat // seen.shape[1], flat % seen.shape[1]


def search(v: np.ndarray, adj: np.ndarray, queries: np.ndarray, starts: np.ndarray, cos: float, width: Width) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within range that a search of the graph for each query meets, from the start nodes on."""
    n, m = len(v), len(queries)
    seen, local = np.zeros((m, n), bool), np.arange(m)
    beam = min(width.beam, n)
    ids = np.full((m, beam + width.step * adj.shape[1] + len(starts)), -1, np.int64)
    sim = np.full(ids.shape, -np.inf, np.float32)
    done = np.zeros(ids.shape, bool)
    at, to = np.repeat(local, len(starts)), np.tile(starts, m)
    seen[at, to] = True
    ids[:, : len(starts)], sim[:, : len(starts)] = starts, _compare(v, queries[at], to).reshape(m, -1)
    hit_q, hit_n = [at], [to]
    hit_s = [sim[:, : len(starts)].ravel()]
    while True:
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        ids[:, :beam], sim[:, :beam], done[:, :beam] = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(done, order, 1)
        ids[:, beam:], sim[:, beam:], done[:, beam:] = -1, -np.inf, False
        open_ = ~done[:, :beam] & (ids[:, :beam] >= 0)
        take = open_ & (np.cumsum(open_, 1) <= width.step)
        q, slot = np.nonzero(take)
        if not len(q):
            break
        done[q, slot] = True
        q, node = _fresh(adj, q, ids[q, slot], seen)
        s = _compare(v, queries[q], node)
        place = beam + np.arange(len(q)) - np.searchsorted(q, q)
        ids[q, place], sim[q, place] = node, s
        hit_q.append(q), hit_n.append(node), hit_s.append(s)
    # Range expansion: each node in range is expanded, whatever the beam had room for.
    expanded = np.zeros((m, n), bool)
    q, node, s = np.concatenate(hit_q), np.concatenate(hit_n), np.concatenate(hit_s)
    inside = s >= cos - MARGIN
    q, node = q[inside], node[inside]
    found_q, found_n = [q], [node]
    while len(q):
        expanded[q, node] = True
        new_q, new_n = [], []
        for a in range(0, len(q), PAIRS // 32):
            fq, fn = _fresh(adj, q[a : a + PAIRS // 32], node[a : a + PAIRS // 32], seen)
            ok = _compare(v, queries[fq], fn) >= cos - MARGIN
            new_q.append(fq[ok]), new_n.append(fn[ok])
        q, node = np.concatenate(new_q), np.concatenate(new_n)
        found_q.append(q), found_n.append(node)
    return np.concatenate(found_q), np.concatenate(found_n)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches by the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low), np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_of_shard(cid: np.ndarray, copies: np.ndarray, v: np.ndarray, cells: np.ndarray, part: np.ndarray, adj: np.ndarray, cell: int, cos: float, width: Width) -> pd.DataFrame:
    """(cid, n, peer): verified links of the pairs that this task counts, and one member of the same group in it for each vector."""
    n, single = len(cid), v.astype(np.float32)
    parts = np.unique(part)
    starts = np.array([np.flatnonzero(part == p)[(single[part == p] @ single[part == p].mean(0)).argmax()] for p in parts])
    a, b = [], []
    for at in range(0, n, TOGETHER):
        queries = np.arange(at, min(n, at + TOGETHER))
        q, node = search(single, adj, queries, starts, cos, width)
        q = queries[q]
        keep = q != node
        a.append(np.minimum(q, node)[keep]), b.append(np.maximum(q, node)[keep])
    pair = np.unique(np.concatenate(a) * n + np.concatenate(b))
    a, b = pair // n, pair % n
    if len(parts) > 1:
        apart = part[a] != part[b]
        a, b = a[apart], b[apart]
    ok = np.zeros(len(a), bool)
    for s in range(0, len(a), PAIRS):
        x, y = a[s : s + PAIRS], b[s : s + PAIRS]
        shared = (cells[x][:, :, None] == cells[y][:, None, :]).any(2)
        first = np.where(shared, cells[x], np.iinfo(np.int64).max).min(1) == cell
        ok[s : s + PAIRS] = first & (np.einsum("ij,ij->i", v[x], v[y]) >= cos)
    a, b = a[ok], b[ok]
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    root = _roots(n, a, b)
    some = np.flatnonzero(links)
    return pd.DataFrame({"cid": cid[some], "n": links[some].astype(np.int64), "peer": cid[root[some]]})


def _tasks(placed: DataFrame) -> DataFrame:
    """A row for each class and cell, with the number of parts that the cell is dealt into and the part of the class."""
    each = placed.withColumn("cell", F.explode("cells"))
    sizes = each.groupBy("cell").agg(F.ceil(F.when(F.count("*") > LARGEST, F.count("*") / (LARGEST // 2)).otherwise(1)).cast("int").alias("parts"))
    # At most CELLS rows.
    return each.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("cid", "cell"), F.col("parts")).cast("int"))


def _links(placed: DataFrame, dim: int, cos: float, width: Width) -> DataFrame:
    """(cid, n, peer) of all shards."""
    tasks = cut(_tasks(placed))

    def lists(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cid = pdf["cid"].to_numpy()
        return pd.DataFrame({"cid": cid, "adj": [cid[r[r >= 0]] for r in build(_unpacked(pdf["v"], dim).astype(np.float32))]})

    own = tasks.select("cell", "part", "cid", "v").groupBy("cell", "part").applyInPandas(lists, "cid long, adj array<long>")
    union = own.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj"))
    met = tasks.join(union, "cid")
    # A cell in parts: a task for each two of them. The graph of a task is what the united lists say about its members.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("*", other.alias("other")).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        cid = pdf["cid"].to_numpy()
        size = pdf["adj"].map(len).to_numpy()
        src, dst = np.repeat(np.arange(len(cid)), size), np.concatenate(pdf["adj"].to_list()) if size.sum() else np.zeros(0, np.int64)
        to = np.minimum(np.searchsorted(cid, dst), len(cid) - 1)
        here = cid[to] == dst
        src, to = src[here], to[here]
        rank = np.arange(len(src)) - np.searchsorted(src, src)
        adj = np.full((len(cid), int(rank.max(initial=0)) + 1), -1, np.int64)
        adj[src, rank] = to
        return links_of_shard(cid, pdf["copies"].to_numpy(np.float64), _unpacked(pdf["v"], dim), np.array(pdf["cells"].to_list(), np.int64), pdf["part"].to_numpy(), adj, key[0], cos, width)

    return met.select("cell", "lo", "hi", "cid", "copies", "cells", "part", "v", "adj").groupBy("cell", "lo", "hi").applyInPandas(find, "cid long, n long, peer long")


def _place(classes: DataFrame, dim: int, n: int, width: Width) -> DataFrame:
    """(cid, copies, v, cells): packed vectors and their nearest cells. The fit takes a sample, the cells take all."""
    k = max(1, min(CELLS, round(n * width.overlap / SHARD)))
    sample = classes.orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    centres = fit_cells(unit(matrix(sample, dim).astype(np.float64)), k) if k > width.overlap else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = matrix(b.column(2), dim)
            v = unit(raw.astype(np.float64))
            cells = np.zeros((len(v), 1), np.int64)
            if centres is not None:
                cells = np.argpartition(-(v @ centres.T), width.overlap - 1, axis=1)[:, : width.overlap].astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(list(cells), pa.list_(pa.int64()))], ["cid", "copies", "v", "cells"])

    return cut(classes.select("cid", "copies", "v").mapInArrow(place, "cid long, copies long, v binary, cells array<long>"))


def _recall(placed: DataFrame, found: DataFrame, dim: int, cos: float) -> float:
    """Share of a sample's links, counted against all vectors, that the graph has found."""
    asked = placed.select("cid", "copies", "v").orderBy(F.xxhash64("cid"), "cid").limit(AUDIT).toArrow()
    queries, ids = _unpacked(asked.column("v").to_pylist(), dim), asked.column("cid").to_numpy()
    own = asked.column("copies").to_numpy()

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(len(ids))
        for b in batches:
            out += (queries @ _unpacked(b.column(0).to_pylist(), dim).T >= cos) @ b.column(1).to_numpy()
        return out

    truth = dict(zip(ids.tolist(), (add_up(placed.select("v", "copies"), part) - own).tolist(), strict=True))
    got = {r["cid"]: r["n"] for r in found.filter(F.col("cid").isin(ids.tolist())).groupBy("cid").agg(F.sum("n").alias("n")).collect()}
    whole = sum(max(0.0, t) for t in truth.values())
    return 1.0 if not whole else sum(min(got.get(c, 0), t) for c, t in truth.items()) / whole


def _near_classes(classes: DataFrame, dim: int, n: int, cos: float, width: Width) -> tuple[DataFrame, float]:
    for i in range(TRIES):
        now = Width(width.overlap + 2 * i, width.beam << i, width.step)
        with passing():
            placed = _place(classes, dim, n, now)
            found = cut(_links(placed, dim, cos, now), outlive=True)
            recall = _recall(placed, found, dim, cos)
        if recall >= RECALL:
            break
    if recall < 0.9:
        raise RuntimeError(f"the graph finds {recall:.3f} of the sampled links after {TRIES} widenings")
    return found, recall


def near_vectors(vectors: DataFrame, cos: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", width: Width | None = None) -> tuple[DataFrame, list[float]]:
    """((id, n_links, component_id) of each row, the recall that the audit measured for each length of vectors)."""
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        vectors = vectors.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(finite(vector_col), F.col(vector_col)).alias("v"))
    usable = F.col("v").isNotNull() & F.exists("v", lambda c: c != 0)
    rows = rows.withColumns({"h1": F.when(usable, F.xxhash64("v")), "h2": F.when(usable, F.xxhash64(F.lit(1), "v"))})
    with passing():
        classes = cut(
            rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("v").alias("v")).withColumn("cid", F.monotonically_increasing_id())
        )
        found, recalls = [], []
        for r in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # a row for each length
            f, recall = _near_classes(classes.filter(F.size("v") == r["d"]), r["d"], r["count"], cos, width or Width())
            found.append(f), recalls.append(recall)
        if not found:
            return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")), []
        links = found[0]
        for f in found[1:]:
            links = links.unionByName(f)
        group = components(links.select(F.col("cid").alias("u"), F.col("peer").alias("v")))
        named = classes.join(group, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
        about = cut(
            named.join(counts, "cid", "left").join(least, "component").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), outlive=True
        )
    out = rows.select("id", "h1", "h2").join(about, ["h1", "h2"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), recalls


def near_vectors_digest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector; kept: it names its component."""
    out, _ = near_vectors(vectors, id_col=id_col, vector_col=vector_col)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
