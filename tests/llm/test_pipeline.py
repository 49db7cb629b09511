import corpus_pipeline as cp
from cardweave.plans import stage as stage_module
from tests.llm.docs import clashing
from tests.llm.test_decontaminate import brute as contaminated_by
from tests.llm.test_linededup import check_deletions
from tests.llm.test_neardup import brute as groups_of
from tests.llm.test_packing import hold


def test_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before = docs
        out = stage(spark, docs, tiny)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    texts = {r.doc_id: r.text for r in after}
    assert all(texts[i] == t for i, t in ((r.doc_id, r.text) for r in before) if i in texts)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in texts for i in clean) >= 0.95 * len(clean)
    before, after = seen["line_dedup"]
    left = {r.doc_id: r.text for r in after}
    check_deletions([(r.doc_id, r.text) for r in before], [(r.doc_id, r.text, left[r.doc_id]) for r in before if r.doc_id in left])
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_dedup"]
    want = {i for i, _, _, kept in groups_of([(r.doc_id, r.text) for r in before], 5, 80) if kept}
    assert {r.doc_id for r in after} == want and len(after) == len(want)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    short = [(r.doc_id, r.text) for r in before if len(r.text) < 4000]
    hits = {i for i, found in contaminated_by(short, items).items() if found}
    assert {i for i, _ in short} - {r.doc_id for r in after} == hits
    before, after = seen["packing"]
    hold([type("R", (), {**r.asDict(), "__getitem__": lambda self, k: self.doc_id})() for r in after], [(r.doc_id, r.text) for r in before], 2048)


def test_odd_rows(spark, tiny, tmp_path):
    docs = clashing(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tiny)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_empty_tables(spark, tiny):
    empty = clashing(spark).limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, tiny).count() == 0, name


def test_run_is_its_stages(spark, tiny, tmp_path, monkeypatch):
    """``run`` gives what the stages give one after the other, and leaves only tables that its result reads."""
    shared = tmp_path / "shared"
    with monkeypatch.context() as m:
        m.setattr(stage_module, "shared_folder", lambda session: str(shared))
        out = cp.run(spark, tiny)
        got = sorted(tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
        left = list(shared.iterdir())
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, tiny)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert got == sorted(tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert len(left) <= 3
