"""What a worker process holds of the words that its tasks have seen."""

import numpy as np
import pandas as pd
import public_tokenizers

from cardweave.llm import common
from cardweave.llm.common import recall
from cardweave.llm.packing import tokenize
from cardweave.llm.toxicity import Lexicon, Model, score_texts


def test_recall_is_bounded_within_one_text(monkeypatch):
    monkeypatch.setattr(common, "REMEMBERED", 100)
    known, asked = {}, []

    def work(w):
        asked.append(w)
        return [w.upper()]

    words = [f"w{i}" for i in range(1000)] + ["w999"] * 5 + ["x" * 65] * 2
    assert recall(words, known, work) == [[w.upper()] for w in words]
    assert len(known) <= 100 and "w999" in known and max(map(len, known)) <= 64
    assert asked.count("w999") == 1 and recall(["w999", "w0"], known, work) == [["W999"], ["W0"]]
    assert asked.count("w0") == 2 and len(known) <= 100


def test_nothing_is_remembered_after_a_task(spark, tiny):
    """A worker outlives its tasks: what it kept would add up over the stages of the pipeline."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(8)

    def held(frames):
        from cardweave.llm import packing, toxicity

        for _ in frames:
            pass
        words = [len(e.known) for e in packing._ENCODERS.values()] + [len(x) for x in toxicity._MACHINE if isinstance(x, dict)]
        yield pd.DataFrame({"words": words or [0]})

    model = Model(Lexicon([("awful", False, 3.0, 1e-5)]), *(np.ones(n) for n in (11, 10, 10)), 0.1)
    for table in (tokenize(docs, public_tokenizers.path("byte_bpe_50k.json")), score_texts(docs, model)):
        table.write.format("noop").mode("overwrite").save()
        assert {r.words for r in spark.range(8).repartition(8).mapInPandas(held, "words long").collect()} == {0}

