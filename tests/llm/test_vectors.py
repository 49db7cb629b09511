"""Operators on embedding vectors against brute force in numpy, and their odd rows."""

import hashlib

import numpy as np
import pytest

from cardweave.llm import clustering, vectordedup, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHES = ("id", "x", "v", "h", "h1", "cid", "cluster", "distance", "component", "n_links", "kept", "far", "cells", "embedding_", "n", "whitened")


def _table(spark, vectors, ids=None):
    rows = [(int(i), [float(c) for c in v], 0) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def _odd(spark, dim=64):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(dim)], 0) for i in range(40)]
    rows += [(3, rows[3][1], 1), (50, rows[3][1], None), (None, rows[4][1], 0), (60, None, 0), (61, [], 0), (62, [1.0] * 3, 0), (63, [None] * dim, 0)]
    rows += [(64, [float("nan")] * dim, 0), (65, [float("inf")] + [0.0] * (dim - 1), 0), (66, [0.0] * dim, 0), (67, [2.0 * c for c in rows[5][1]], 0)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'y' as {c}" for c in CLASHES))


def _clusters(ids, vectors, k=16, rounds=3):
    x = np.floor(64 * vectors).astype(np.int64)
    start = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = x[start].copy()

    def nearest():
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at, _ = nearest()
        for j in set(at.tolist()):
            c[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(0)]
    return (*nearest(), c)


def _near(ids, vectors, cos):
    """Links and components by comparing all vectors."""
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = np.einsum("ik,jk->ij", u, u) >= cos
    np.fill_diagonal(link, False)
    label = {i: i for i in range(len(ids))}
    for a, b in zip(*np.nonzero(link), strict=True):
        old, new = label[a], label[b]
        if old != new:
            label = {i: new if g == old else g for i, g in label.items()}
    least = {}
    for i, g in label.items():
        least[g] = min(least.get(g, ids[i]), ids[i])
    return link.sum(1), [least[label[i]] for i in range(len(ids))]


def test_clusters_equal_comparison_with_every_centroid(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = df.collect()
    ids, v = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    at, d, c = _clusters(ids, v)
    got = {r["vec_id"]: r for r in clustering.cluster_digest(df).collect()}
    assert len(got) == len(ids)
    for i, k, e in zip(ids, at, d, strict=True):
        assert (got[i]["cluster"], got[i]["distance"], got[i]["inertia"]) == (k, e, d.sum())
        assert got[i]["cluster_inertia"] == d[at == k].sum()
        assert got[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[k].tolist())).encode()).hexdigest()


def test_bounds_never_exceed_distances_and_leave_centroids_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 64))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 64))
    pivots = clustering.choose_pivots(x[:256])
    assert len(pivots) == clustering.PIVOTS
    far = clustering.pivot_distances(x, pivots)
    low = clustering.lower_bounds(far, clustering.pivot_distances(centres, pivots), clustering.pivot_distances(pivots, pivots))
    exact = np.sqrt(((x[:, None, :] - centres[None]) ** 2).sum(2))
    assert (low <= exact).all() and (low > 0.3 * exact).any()
    at, d, tried = clustering.nearest(x, far, centres, pivots)
    assert (d == ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1)).all() and tried < 0.5 * exact.size
    # On the bound itself rounding must not exclude: pivots, vectors and centroids on one circle.
    t = np.arange(12) * np.pi / 6
    ring = np.round(np.stack([np.cos(t), np.sin(t)], 1) * 1e6).astype(np.int64)
    f = clustering.pivot_distances(ring, ring[:4])
    low = clustering.lower_bounds(f, f, clustering.pivot_distances(ring[:4], ring[:4]))
    assert (low**2 * (1 - clustering.SLACK) <= ((ring[:, None] - ring[None]) ** 2).sum(2) * (1 + clustering.SLACK)).all()


def test_cluster_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    v = [[0.0] * 64, [2.0] + [0.0] * 63, [1.0] + [0.0] * 63] + [[0.0] * 64] * 5
    rows = clustering.cluster_vectors(_table(spark, v), k=4)
    at, d, c = _clusters(list(range(8)), np.array(v), k=4)
    assert {r["id"]: (r["cluster"], r["distance"]) for r in rows[0].collect()} == dict(enumerate(zip(at.tolist(), d.tolist(), strict=True)))
    assert rows[1] == c.tolist()


def test_cluster_odd_rows(spark):
    df = _odd(spark)
    kept = [r for r in df.collect() if r["embedding"] and len(r["embedding"]) == 64 and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    at, d, _ = _clusters([r["vec_id"] for r in kept], np.array([r["embedding"] for r in kept]))
    got = clustering.cluster_digest(df)
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in got.collect()) == sorted((repr(r["vec_id"]), int(k), int(e)) for r, k, e in zip(kept, at, d, strict=True))
    assert clustering.cluster_digest(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.cluster_digest(_table(spark, [[1e9] * 64])).collect()


def _check_whitening(ids, v, rows, k):
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    w = z @ q / np.sqrt(e)
    got, place = np.full((n, k), np.nan), {i: j for j, i in enumerate(ids)}
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        got[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int(((n * x[i] - s) ** 2).sum()) and r["identity_error"] < 1e-10
        assert abs(r["explained"] / (e[c] / np.trace(z.T @ z / n)) - 1) < 1e-12
    sign = np.sign((got * w).sum(0))
    assert np.abs(got * sign - w).max() < 1e-8


def test_whitening_equals_a_dense_eigensolver(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = df.collect()
    _check_whitening([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), whitening.whitening_digest(df).collect(), 32)


def test_whitening_odd_rows(spark):
    df = _odd(spark, 8)
    good = [r for r in df.collect() if r["embedding"] and len(r["embedding"]) == 8 and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    out = whitening.whitening_digest(df).collect()
    assert len(out) == 8 * len(good) and {r["n"] for r in out} == {len(good)}
    assert whitening.whitening_digest(df.limit(0)).count() == 0
    assert whitening.whitening_digest(_table(spark, [[1.0, 2.0]] * 4)).count() == 0  # equal vectors have no component
    rank2 = whitening.whitening_digest(_table(spark, [[a, b, a + b, a - b] for a in range(4) for b in range(5)])).collect()
    assert {r["component"] for r in rank2} == {1, 2}
    with pytest.raises(Exception, match="too large"):
        whitening.whitening_digest(_table(spark, [[1e30, 0.0], [0.0, 1.0]])).collect()


@pytest.mark.parametrize("dim,n,k", [(64, 500, 32), (200, 900, 20), (30, 12, 32), (5, 40, 8)])
def test_jacobi_davidson_residuals_reach_double_precision(dim, n, k):
    x = np.random.default_rng(dim).standard_normal((n, dim)) * np.linspace(1, 2, dim)
    x -= x.mean(0)
    calls = []
    values, vectors, worst = whitening.jacobi_davidson(lambda y: calls.append(y.shape) or x.T @ (x @ y) / n, dim, k)
    true = np.linalg.eigvalsh(x.T @ x / n)[::-1][:k]
    assert len(values) == min(k, n - 1, dim) and np.abs(values - true[: len(values)]).max() < 1e-13 * true[0]
    assert worst < 1e-12 and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and len(calls) < 150


def test_minres_solves_indefinite_systems_for_all_columns():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    b = rng.standard_normal((20, 3))
    assert np.abs(a @ whitening.minres(lambda y: a @ y, b, 60, 1e-13) - b).max() < 1e-8


def _families(n_single=150, sizes=(2, 3, 5, 40), dim=32, noise=0.03, seed=1):
    rng = np.random.default_rng(seed)
    v = [rng.standard_normal(dim) for _ in range(n_single)]
    for s in sizes:
        c = rng.standard_normal(dim)
        v += [c + noise * np.sqrt(dim) * rng.standard_normal(dim) * rng.random() for _ in range(s)]
    return np.array(v, np.float32).astype(np.float64)[rng.permutation(n_single + sum(sizes))]


@pytest.mark.parametrize("shard,largest", [(1500, 4096), (60, 4096), (60, 30)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, shard, largest):
    """One shard, overlapping shards, and shards dealt into parts."""
    monkeypatch.setattr(vectordedup, "SHARD", shard)
    monkeypatch.setattr(vectordedup, "LARGEST", largest)
    v = _families()
    ids = [7 * i for i in range(len(v))]
    links, comp = _near(ids, v, 0.9)
    got, recalls = vectordedup.near_vectors(_table(spark, v, ids))
    got = {r["id"]: r for r in got.collect()}
    assert min(recalls) >= 0.98 and links.sum() > 100
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, links, strict=True))
    assert sum(got[i]["n_links"] for i in ids) >= 0.98 * links.sum()
    if shard == 1500:
        assert [got[i]["n_links"] for i in ids] == links.tolist() and [got[i]["component_id"] for i in ids] == comp


def test_near_vectors_copies_are_not_expanded(spark):
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    v = np.array([a] * 3000 + [a + 1e-3] * 2 + [b] * 2)
    got = {r["vec_id"]: r for r in vectordedup.near_vectors_digest(_table(spark, v)).collect()}
    assert {got[i]["n_links"] for i in range(3002)} == {3001} and {got[i]["component_id"] for i in range(3002)} == {0}
    assert (got[3002]["n_links"], got[3003]["component_id"], got[3003]["kept"]) == (1, 3002, False)


def test_near_vectors_odd_rows(spark):
    df = _odd(spark)
    rows = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectordedup.near_vectors_digest(df).collect()), key=repr)
    expect = {i: (0, i, True) for i in [*range(40), *range(60, 68)]}
    expect |= {50: (2, 3, False), 4: (1, 4, True), None: (1, 4, False), 5: (1, 5, True), 67: (1, 5, False)}
    assert len(rows) == df.count() and [r for r in rows if r[0] != 3] == sorted(((i, *e) for i, e in expect.items() if i != 3), key=repr)
    assert [r for r in rows if r[0] == 3] == [(3, 2, 3, True)] * 2
    assert vectordedup.near_vectors_digest(df.limit(0)).count() == 0


def test_threshold_is_exact_and_the_graph_is_searched_from_its_medoid():
    v = _families(400, (30, 30), 24).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    adj = vectordedup.build(v)
    assert adj.shape[1] < 100 and ((adj >= 0).sum(1) > 5).all()
    start = np.array([int((v @ v.mean(0)).argmax())])
    q, node = vectordedup.search(v, adj, np.arange(200), start, 0.9, vectordedup.Width())
    found = set(zip(q.tolist(), node.tolist(), strict=True))
    true = {(a, b) for a, b in zip(*np.nonzero(v[:200] @ v.T >= 0.9), strict=True)}
    assert len(true & found) >= 0.98 * len(true)
