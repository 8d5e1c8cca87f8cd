"""Mixing sources to target weights by iterative proportional fitting.

The tokens of every cell (source, language, topic) are scaled in turn so that the sums by
source, by language and by topic meet their targets, round after round. The factor of its
cell, times a rate that makes the expected tokens meet the budget, is the probability with
which a document is sampled; the draw is a hash of its id, so it is the same in every run.
Only cells, never documents, take part in the rounds, and all of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtables.session import cut_lineage

MARGINS = ("source", "lang", "topic")
#: A target is the share of tokens to this power, scaled to one: 1 keeps the shares, 0 makes all equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.3}
ROUNDS = 8
#: Rounds between two written tables, so that a plan stays short.
ROUNDS_A_TABLE = 4
#: Rounds in which cells that must be taken whole are set aside, at most.
CAP_ROUNDS = 40
#: Expected tokens of the sample, as a share of all.
RATE = 0.5
TOPICS = (("table", " | "), ("markup", "%%%"), ("shout", "!! "))


def tokens(text: Column) -> Column:
    """Words that white space parts; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """What kind of writing a text is, by the first sign that it has: a stand-in for a topic model."""
    out = F.when(F.length(F.coalesce(text, F.lit(""))) < 500, "note").otherwise("prose")
    for name, sign in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(sign)), name).otherwise(out)
    return out


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the margins, tokens) and the fitted weight of each, which sum to one.

    A null margin value is a value of its own. Cells without tokens have weight 0.
    """
    shares = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in powers:
        of_value = cells.groupBy(m).agg(F.sum("tokens").alias("t")).where("t > 0")
        raised = of_value.withColumn("raised", F.pow(F.col("t").cast("double"), F.lit(powers[m])))
        sums = raised.agg(F.sum("raised").alias("all"))
        targets = raised.join(F.broadcast(sums)).select(F.col(m).alias("_value"), (F.col("raised") / F.col("all")).alias(f"_{m}"))
        shares = shares.join(targets, F.col(m).eqNullSafe(F.col("_value")), "left").drop("_value")
    shares = cut_lineage(shares)
    for i in range(rounds):
        for m in powers:
            now = F.sum("weight").over(Window.partitionBy(m))
            shares = shares.withColumn("weight", F.when(now > 0, F.col("weight") / now * F.col(f"_{m}")).otherwise(0.0))
        if (i + 1) % ROUNDS_A_TABLE == 0:
            shares = cut_lineage(shares)
    return shares.select(*[c for c in cells.columns], "weight")


def draw(key: Column) -> Column:
    """A number from 0 to 1 that is fixed for a key (a null key draws 0)."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("double") / float(1 << 48), F.lit(0.0))


def probabilities(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """``cells`` (margins, tokens, weight) and the probability of a document of each.

    Sampling is without replacement, so no probability is above 1: cells that would need
    more are taken whole, and the others share what is left of the budget by weight.
    """
    cells = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    scale, whole = 0.0, None
    for _ in range(CAP_ROUNDS):
        full = F.col("ratio") * scale >= 1
        sums = cells.agg(
            F.sum("tokens").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("whole"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if sums["whole"] == whole or not sums["open"] or not sums["all"]:
            break
        whole, scale = sums["whole"], (rate * sums["all"] - sums["whole"]) / sums["open"]
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * scale)).drop("ratio")


def _with_topic(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), tokens(F.col("text")).alias("n_tokens"))


def _cells(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))


def _of_cell(rows: DataFrame, fitted: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the columns of their cell."""
    fitted = fitted.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], *columns)
    same = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    return rows.join(fitted, same[0] & same[1] & same[2])


def mixed(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and sampled of each document.

    ``docs`` has doc_id, text, source and lang; other columns are ignored. ``weight`` is the
    fitted weight of the document's cell. Null margins are values of their own; documents
    without words have no weight and are not sampled. Repeated rows draw alike.
    """
    rows = _with_topic(docs)
    fitted = cut_lineage(probabilities(rake(_cells(rows), powers, rounds), rate))
    out = _of_cell(rows, fitted, "weight", "probability")
    sampled = (F.col("n_tokens") > 0) & (draw(F.col("doc_id")) < F.col("probability"))
    return out.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", sampled.alias("sampled"))


def repeats(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """``cells`` (margins, tokens, weight) and how often a document of each is expected in the sample.

    Nothing stops at 1, so the expected tokens of a cell are its weight's share of the budget.
    """
    budget = F.col("all") * F.lit(float(rate))
    expected = F.when(F.col("tokens") > 0, F.col("weight") * budget / F.col("tokens")).otherwise(0.0)
    return cells.join(F.broadcast(cells.agg(F.sum("tokens").alias("all")))).withColumn("expected", expected).drop("all")


def repeated(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, expected and copies of each document.

    As :func:`mixed`, but a document may stand in the sample more than once: ``copies`` times,
    the whole part of ``expected`` and one more if the draw of its id is below the rest.
    """
    rows = _with_topic(docs)
    out = _of_cell(rows, cut_lineage(repeats(rake(_cells(rows), powers, rounds), rate)), "weight", "expected")
    whole = F.floor("expected")
    copies = F.when(F.col("n_tokens") > 0, whole + (draw(F.col("doc_id")) < F.col("expected") - whole).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", *MARGINS, "n_tokens", "weight", "expected", copies.alias("copies"))
