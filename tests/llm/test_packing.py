import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardweave.llm.packing import Encoder, cut_points, pack_documents, plan_places
from tests.llm.docs import clashing, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["a²b½ x", "日本語 text", "\x1c áb", "it's we'll 12３ _a__b  \n\n x ", "a<|endoftext|>b", "", " ", "  ", "a \x85\x85 b", "x \n y", "\n\n a\n \n b", "é กำ ٣٤ Ⅷ", "a \n", "tab\t\tx \t y", " lead", "don't DON'T"]


def test_encoder_equals_tokenizer(spark, tiny):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    encode, full = Encoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        for t in texts:
            assert encode(t) == np.array(full.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_tokenizers_encode_by_themselves(tmp_path):
    import json

    form = json.loads(Tokenizer.from_file(PATH).to_str())
    form["pre_tokenizer"]["add_prefix_space"] = True
    other = str(tmp_path / "other.json")
    with open(other, "w") as f:
        json.dump(form, f)
    assert Encoder(other).merge is None and Encoder(PATH).merge is not None
    full = Tokenizer.from_file(other)
    assert all(Encoder(other)(t) == np.array(full.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ODD_TEXTS[:4])


def hold(rows, texts, size):
    """Round trip: the pieces are the documents, and each sequence is gapless and within size."""
    full = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in texts:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        for k, (s, m) in enumerate(cut_points(len(ids) // 4, size)):
            want[(i, k, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]))] += 1
    assert want == collections.Counter((r["id"], r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    return len(by), sum(r.length for r in rows) / size


def test_query_round_trip(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    n, least = hold(pack_documents(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= 1.03 * least + 1


@pytest.mark.parametrize("size", [8, 64])
def test_small_sizes(spark, tiny, size):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    hold(pack_documents(docs, PATH, size).collect(), [(r.doc_id, r.text) for r in docs.collect()], size)


def test_odd_rows(spark):
    hold(pack_documents(clashing(spark), PATH).collect(), [(r.doc_id, r.text) for r in table(spark).collect()], 2048)
    assert pack_documents(table(spark, []), PATH).count() == 0


def test_plan_holds_the_histogram():
    rnd = np.random.default_rng(1)
    histogram = collections.Counter(rnd.integers(1, 2048, 30000).tolist()) | {7: 100000, 1024: 5001}
    got = collections.Counter()
    sequences = 0
    for uses, k in plan_places(histogram):
        assert sum(x * m for x, m in uses) <= 2048
        sequences += k
        for x, m in uses:
            got[x] += k * m
    assert got == collections.Counter(histogram)
    assert sequences <= 1.01 * sum(x * c for x, c in histogram.items()) / 2048 + 1
