"""Each stage of the pipeline against a plain version, and over odd rows."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as pipeline
from revtables.llm import pii, toxicity
from revtables.llm.queries import held_out

SF = "/root/testdata/sf0.001"
STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_toxic_documents_go(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(toxicity.training_rows(documents, labels))
    bad = {r["doc_id"] for r in toxicity.with_score(documents.select("doc_id", "text"), model).where("score >= 0.7").collect()}
    out = STAGE["toxicity"](spark, documents, SF)
    assert rows(out) == rows(documents.where(~F.col("doc_id").isin(*bad, -1)))


def test_one_of_each_group_stays(spark, documents):
    want = {i for i, (_, c) in brute.near_duplicates([(r["doc_id"], r["text"]) for r in documents.collect()], 5, 80).items() if i == c}
    assert rows(STAGE["near duplicates"](spark, documents, SF)) == rows(documents.where(F.col("doc_id").isin(*want)))


def test_contaminated_documents_go(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.decontamination([(r["doc_id"], r["text"]) for r in documents.collect()], items)
    clean = [i for i, v in found.items() if not v[4]]
    assert rows(STAGE["decontamination"](spark, documents, SF)) == rows(documents.where(F.col("doc_id").isin(*clean)))


def test_personal_data_is_masked(spark, documents):
    spans = {r["doc_id"]: r["spans"] for r in pii.with_spans(documents.select("doc_id", "text")).collect()}
    before = {r["doc_id"]: r["text"] for r in documents.collect()}
    for row in STAGE["personal data"](spark, documents, SF).collect():
        text, at = "", 0
        for s in spans[row["doc_id"]]:
            if s["start"] >= at:
                text += before[row["doc_id"]][at : s["start"]] + f"[{s['kind']}]"
            at = max(at, s["end"])
        assert row["text"] == text + before[row["doc_id"]][at:] and row["n_chars"] == len(row["text"])


def test_odd_rows_pass_through_every_stage(spark, documents):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f", None, "s", 11), (2, "a b c d e f", None, "s", 11), (3, "x" * 200_000, "en", None, 1)]
    df = spark.createDataFrame(odd, documents.schema)
    clashing = df.withColumns({"row": F.lit(1), "score": F.lit("s"), "found": F.lit(2), "spans": F.lit(3), "set_id": F.lit(4)})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clashing, SF)
        assert out.columns == clashing.columns
        assert out.count() == (4 if name == "near duplicates" else len(odd)), name
        assert stage(spark, clashing.limit(0), SF).count() == 0
    assert pipeline.STAGES[-1][1](spark, clashing, SF).count() <= len(odd)
    assert pipeline.STAGES[-1][1](spark, clashing.limit(0), SF).count() == 0


def test_whole_run(spark):
    out = pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and out.where("probability <= 0 OR probability > 1").count() == 0
