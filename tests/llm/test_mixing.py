"""What the sample holds, not only what the weights say, with the parameters of production."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from revtables.llm import mixing


@pytest.fixture(scope="module")
def uneven(spark):
    """Documents of 20 words, of which a hundredth come from one source and a fiftieth are in one language."""
    return spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("word " * 20), F.when(F.col("id") % 10 == 0, "!! ").otherwise("")).alias("text"),
        F.when(F.col("id") % 100 == 7, "rare").otherwise("common").alias("source"),
        F.when(F.col("id") % 50 < 2, "fr").otherwise("en").alias("lang"),
        F.lit(100).alias("n_chars"),
    )


def shares_and_targets(table, column):
    for m, power in mixing.POWERS.items():
        target = table.groupby(m)["n_tokens"].sum() ** power
        yield (table[column] * table["n_tokens"]).groupby(table[m]).sum() / (table[column] * table["n_tokens"]).sum(), target / target.sum()


def test_sample_meets_its_targets(spark, uneven):
    table = mixing.repeated(uneven).toPandas()
    assert table["copies"].max() > 1
    for share, target in shares_and_targets(table, "expected"):
        assert np.allclose(share, target, atol=1e-3)
    for share, target in shares_and_targets(table, "copies"):
        assert np.allclose(share, target, atol=0.03)
    assert abs((table["expected"] * table["n_tokens"]).sum() - mixing.RATE * table["n_tokens"].sum()) < 1e-6 * table["n_tokens"].sum()
    assert ((table["copies"] - table["expected"]).abs() < 1).all()


def test_pipeline_hands_on_every_copy(spark, uneven):
    out = dict(pipeline.STAGES)["mixing"](spark, uneven, "").toPandas()
    tokens = (out["copies"] * out["n_tokens"]).groupby(out["source"]).sum()
    sizes = np.array([3960.0, 40.0]) ** mixing.POWERS["source"]
    assert np.allclose([tokens["common"] / tokens.sum(), tokens["rare"] / tokens.sum()], sizes / sizes.sum(), atol=0.03)


def test_repeats_on_odd_rows(spark, uneven):
    odd = uneven.limit(5).withColumns({"text": F.when(F.col("doc_id") > 2, "a b c"), "lang": F.lit(None).cast("string")})
    out = mixing.repeated(odd).collect()
    assert len(out) == 5 and not any(r["copies"] for r in out if not r["n_tokens"])
    assert mixing.repeated(odd.limit(0)).count() == 0
