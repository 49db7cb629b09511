import re

import numpy as np

from cardweave.llm import quality
from cardweave.llm.quality import count_rules, judge_quality
from tests.llm.docs import clashing, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_repeat = len(covered)
    failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_repeat, failed


def base(rows):
    return sorted(((r["id"], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)


def test_query_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = judge_quality(docs).collect()
    assert base(got) == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)
    assert not any(r.kept and r.base_failed for r in got)


def test_odd_rows(spark):
    want = sorted(((r.doc_id, *brute(r.text)) for r in table(spark).collect()), key=repr)
    assert base(judge_quality(clashing(spark)).collect()) == want
    assert judge_quality(table(spark, [])).count() == 0


def test_long_way_counts_alike(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    want = {r["id"]: r.n_repeat_words for r in count_rules(docs).collect()}
    monkeypatch.setattr(quality, "_POSITION", 8)
    assert want == {r["id"]: r.n_repeat_words for r in count_rules(docs).collect()}


def test_outliers_go_and_others_stay(spark):
    rnd = np.random.default_rng(2)
    words = [f"{chr(97 + x % 26)}{'o' * (x % 9)}{x}" for x in range(3000)]
    rows = []
    for i in range(900):
        text = " ".join(words[x] for x in rnd.integers(0, 3000, int(np.exp(rnd.normal(5.5, 0.5)))))
        if i % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en" if i % 3 else "fr", f"s{i % 2}", 0))
    got = {r["id"]: r for r in judge_quality(table(spark, rows)).collect()}
    fine = [i for i, r in got.items() if r.n_words >= 50 and i % 10]
    assert all(not got[i].kept for i in got if i % 10 == 0)
    assert sum(not got[i].kept for i in fine) <= 0.01 * len(fine)


def halved(x, target, start):
    """Concentration steps in numpy, as ``robust_distances`` defines them."""
    n, d = x.shape
    share = next(p for p in quality._HALVES if min(1.0, (n + d + 1) / (2 * n)) - 0.01 <= p)
    floors = np.array(quality.FLOORS) ** 2
    m, c = start
    best = None
    while True:
        c = c + np.diag(np.maximum(floors - np.diag(c), 0))
        d2 = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(axis=1)
        near = x[d2 <= np.sort(d2)[int(np.ceil(share * n)) - 1]]
        m, c = near.mean(axis=0), (len(near) * np.cov(near.T, bias=True) + quality.PRIOR * np.diag(target)) / (len(near) + quality.PRIOR)
        c = c + np.diag(np.maximum(floors - np.diag(c), 0))
        det = np.linalg.slogdet(c)[1]
        if best and det >= best[0] - quality.SETTLED:
            return best
        best = det, m, c


def lower_median(x):
    return np.sort(x, axis=0)[int(np.ceil(len(x) / 2)) - 1]


def numpy_distances(x, par, grp):
    floors, d = np.array(quality.FLOORS) ** 2, x.shape[1]
    spread = lambda y: np.maximum((1.4826 * lower_median(np.abs(y - lower_median(y)))) ** 2, floors)
    out, overall = np.zeros(len(x)), spread(x)
    for g in set(grp):
        y = x[grp == g]
        above = x[par == par[grp == g][0]]
        target = (len(above) * spread(above) + quality.PRIOR * overall) / (len(above) + quality.PRIOR)
        m = lower_median(y)
        s = np.sqrt(np.maximum((1.4826 * lower_median(np.abs(y - m))) ** 2, target))
        z = (y - m) / s
        norm = np.maximum((z * z).sum(axis=1), 1e-12)[:, None]
        shapes = [np.eye(d), d * (z.T @ (z / norm)) / len(z) + 0.1 * np.eye(d), np.cov(np.tanh(z).T, bias=True) + 0.1 * np.eye(d)]
        _, m, c = min((halved(y, target, (m, shape * np.outer(s, s))) for shape in shapes), key=lambda f: f[0])
        d2 = ((y - m) @ np.linalg.inv(c + np.diag(np.maximum(floors - np.diag(c), 0))) * (y - m)).sum(axis=1)
        out[grp == g] = d2 / max(1.0, lower_median(d2[:, None])[0] / quality.MEDIAN)
    return out


def test_distances_equal_numpy(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for g, (par, n) in enumerate((("a", 300), ("a", 12), ("b", 90), ("b", 5), (None, 40), (None, 1))):
        mix = rnd.normal(size=(5, 5)) * 0.3 + np.eye(5)
        y = rnd.normal(size=(n, 5)) @ mix + g
        y[: n // 6] += rnd.normal(6, 1, size=5)
        y[:, 3] *= rnd.random(n) < 0.2
        rows += [(g * 1000 + k, 60, par, f"s{g}", *map(float, v)) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, n_words long, g0 string, g1 string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = {r["id"]: r.d2 for r in quality.robust_distances(df, ["g0", "g1"]).collect()}
    x = np.array([r[4:] for r in rows])
    want = numpy_distances(x, np.array([str(r[2]) for r in rows]), np.array([r[3] for r in rows]))
    assert np.allclose([got[r[0]] for r in rows], want, rtol=1e-4)


def test_labelled_rows(spark):
    """The good texts that pass the base rules stay, and nearly all of the bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    passed = judge_quality(docs).filter("not base_failed").join(labels.withColumnRenamed("doc_id", "id"), "id")
    got = {(r.quality, r.kept): r["count"] for r in passed.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.005 * got[1, True]
    assert got.get((0, True), 0) <= 0.05 * got[0, False]
