import collections
import random

import numpy as np

from cardweave.llm.suffixdedup import LENGTH, common_prefixes, merge_shards, remove_repeats, sort_shard, suffix_array, words_of
from tests.llm.docs import clashing, table


def brute(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(r[k : k + LENGTH] for _, r in raws for k in range(len(r) - LENGTH + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - LENGTH + 1):
            if seen[r[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), runs, bytes(c for c, g in zip(r, gone) if not g)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r["id"], r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, **options).collect()), key=repr)


def texts(rnd):
    for size, alphabet, length in ((400, 2, 20), (3000, 3, 13), (500, 1, 200), (5000, 20, 9), (30, 2, 8), (9, 1, 8), (1500, 250, 16)):
        text = rnd.integers(0, alphabet, size).astype(np.uint8)
        text[size // 2 : size // 2 + 150] = text[: len(text[size // 2 : size // 2 + 150])]
        yield text, length


def test_suffix_array_and_common_prefixes():
    for text, length in texts(np.random.default_rng(5)):
        raw = text.tobytes()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        order, rank = suffix_array(words_of(text))
        assert order.tolist() == want and rank[order].tolist() == list(range(len(raw)))
        lcp = common_prefixes(words_of(text), order, length).tolist()
        for k in range(1, len(raw)):
            x, y = raw[want[k - 1] :], raw[want[k] :]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[k] == min(n, length)


def test_shards_and_merging():
    rnd = np.random.default_rng(3)
    for text, length in texts(rnd):
        starts = np.sort(rnd.choice(len(text) - length + 1, (len(text) - length) // 2, replace=False))
        count = collections.Counter(bytes(text[s : s + length]) for s in starts)
        one = sort_shard(text, starts, length)
        assert {s: h for s, h in zip(one.order.tolist(), one.hit.tolist())} == {s: count[bytes(text[s : s + length])] > 1 for s in starts.tolist()}
        cut = len(starts) // 3
        a, b = sort_shard(text, starts[:cut], length), sort_shard(text, starts[cut:], length)
        merge_shards(a, b, length)
        got = {s: h for x in (a, b) for s, h in zip(x.order.tolist(), x.hit.tolist())}
        # Of windows that one shard holds twice, the merging marks the first; the shard has marked all.
        assert got == {s: count[bytes(text[s : s + length])] > 1 for s in starts.tolist()}


def test_query_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def made(rnd):
    words = [f"w{x}é" if x % 9 == 0 else f"word{x}" for x in range(500)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [say(rnd.choice([8, 25, 32, 40, 120])) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [say(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, max(1, len(s) // 4))
            parts += [s[a : len(s) - rnd.randrange(0, max(1, len(s) // 4))], say(rnd.randrange(0, 9))]
        rows.append((i, " ".join(parts), "en", "s", 0))
    rows += [(100, "ab" * 150, "en", "s", 0), (101, "x" * 199, "en", "s", 0), (102, "x" * 199, "en", "s", 0), (103, "y" * 201, "en", "s", 0), (104, shared[0] * 9, "en", "s", 0)]
    return rows


def test_planted_passages(spark):
    rows = made(random.Random(2))
    want = brute([r[:2] for r in rows])
    assert got(table(spark, rows)) == want
    assert got(table(spark, rows), shard_bytes=2000) == want
    assert got(table(spark, rows), shard_bytes=700, group_shards=3) == want  # shards of a group are merged
    assert got(table(spark, rows), shard_bytes=300, group_shards=1) == want  # all groups are halved


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in table(spark).collect() if r.doc_id != 6 and r.doc_id != 7]
    df = clashing(spark).filter("doc_id is null or doc_id not in (6, 7)")
    assert got(df) == brute(rows)
    long = [(6, "word " * 30000, "en", "s", 0), (7, "x" * 300000 + "".join(random.Random(1).choices("abcdefgh", k=400)), "en", "s", 0)]
    a, b = got(table(spark, long))
    assert (a[2], a[3]) == (150000, 1) and b[2] == 300000 and b[3] == 1
    assert got(table(spark, [])) == []
