"""A corpus pipeline over ``documents``: five stages, each one of the operators.

Every stage takes what the one before it kept. Its decisions take effect: rejected rows go,
personal data is masked. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtables.llm import mixing, pii, toxicity
from revtables.llm.decontamination import is_contaminated, search_items
from revtables.llm.near_duplicates import near_duplicates
from revtables.llm.queries import held_out, table
from revtables.llm.texts import pack
from revtables.session import bounded_batches, cut_lineage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on labelled rows of this input."""
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    scored = toxicity.with_score(pack(docs, "text"), model)
    return scored.where(F.col("score") < toxicity.REJECT_FROM).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; repeated rows count as copies."""
    bounded_batches(spark)
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text"))
    kept = near_duplicates(docs.select(key.alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_key"))
    rows = docs.withColumn("_key", key)
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark phrases."""
    bounded_batches(spark)
    found = search_items(pack(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(~is_contaminated()).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    found = pii.with_spans(pack(docs, "text"))
    text = pii.masked(F.col("row.text"), F.col("spans"))
    out = found.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the sample, each with its copies in it and the weight they were drawn with.

    ``expected`` is the mean of ``copies``, and ``probability`` that of being in the sample at all.
    """
    out = mixing.repeated(docs).where("copies > 0").withColumn("probability", F.least(F.lit(1.0), "expected"))
    return out.withColumns({c: F.round(c, 9) for c in ("weight", "expected", "probability")})


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("mixing", mix),
]
#: The classifier and the signatures have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
