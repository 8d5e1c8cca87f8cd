"""What a Python worker holds for a batch, as it keeps that memory while it lives."""

import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from revtables.llm import texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_hashes_of_a_slice_take_their_own_array_only():
    data = np.arange(texts.SLICE_BYTES, dtype=np.uint64).astype(np.uint8)
    texts.powers(len(data))
    tracemalloc.start()
    sums = texts.prefix_hashes(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * sums.nbytes


def test_kept_powers_follow_the_longest_text(monkeypatch):
    monkeypatch.setattr(texts, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    for n in (texts.SLICE_BYTES, texts.SLICE_BYTES + 1):
        texts.powers(n)
    assert len(texts._powers[0]) <= n + texts.POWERS_STEP


@pytest.mark.parametrize("stage", ["near duplicates", "decontamination"])
@pytest.mark.parametrize(("asked", "held"), [("10000", "1000"), ("0", "1000"), ("300", "300")])
def test_stages_bound_their_batches(spark, tmp_path, stage, asked, held):
    spark.createDataFrame([("i", "some words of an item")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a b c d", "en", "web", 7), (2, None, "en", "web", 0)], DOCS)
    before = spark.conf.get(ARROW_ROWS)
    try:
        spark.conf.set(ARROW_ROWS, asked)
        out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
        assert spark.conf.get(ARROW_ROWS) == held
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    finally:
        spark.conf.set(ARROW_ROWS, before)
