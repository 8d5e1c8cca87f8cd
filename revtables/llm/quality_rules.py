"""Quality rules: plain counts, and how much likelier a text is under trusted texts.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets, one of
trusted texts and one of the whole corpus, give every bucket the logarithm of its ratio;
the verdict on a text is the mean over its n-grams against a threshold. All of it is Spark
expressions; only the table of buckets, whose size is fixed, comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
#: Added to the count of every bucket.
SMOOTHING = 1.0
#: A text is kept if its n-grams are on average likelier under trusted texts by so much.
KEEP_FROM = -0.05
SPACES = " \t\n\x0b\f\r"
LEAST_WORDS = 50
MOST_REPEATED = 50


def _bound(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def _positions(n: Column, size: int) -> Column:
    """The places where a window of ``size`` begins, none if it is too long."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of three that stand twice or more, from the hashes of the words."""
    windows = F.transform(_positions(F.size(hashes), 3), lambda i: F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]))

    def in_order(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda a, b: F.coalesce(F.get(pairs, a)["w"] == F.get(pairs, b)["w"], F.lit(False))
        repeated = F.filter(F.sequence(F.lit(0), n - 1), lambda k: same(k, k + 1) | same(k, k - 1))
        return _bound(F.sort_array(F.transform(repeated, lambda k: pairs[k]["at"])), covered)

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def counted(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_bound(pairs, in_order))

    return _bound(windows, counted)


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _word_buckets(hashes: Column) -> Column:
    return F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("short"))


def _buckets(of_words: Column) -> Column:
    """The bucket of every word, and above those the bucket of every pair of words."""
    pairs = F.transform(
        _positions(F.size(of_words), 2),
        lambda i: F.pmod(F.xxhash64(of_words[i], of_words[i + 1]), F.lit(BUCKETS)).cast("int") + BUCKETS,
    )
    return F.concat(F.transform(of_words, lambda w: w.cast("int")), pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """By bucket, log of its probability in trusted texts over that in all texts.

    ``docs``: doc_id, text; ``trusted``: doc_id of trusted ones. Every text counts. Without
    trusted texts all ratios are 0.
    """
    # Trusted texts have no bound, so their ids are never broadcast; buckets move, not texts.
    named = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("one", F.lit(1)).hint("merge")
    rows = docs.select("doc_id", _word_buckets(_hashes(_text())).alias("words")).join(named, "doc_id", "left")
    found = rows.select(F.coalesce("one", F.lit(0)).alias("one"), F.explode(_bound(F.col("words"), _buckets)).alias("bucket"))
    counts = found.groupBy("bucket").agg(F.sum("one").alias("t"), F.count("*").alias("r")).collect()
    target, raw = [smoothing] * (2 * BUCKETS), [smoothing] * (2 * BUCKETS)
    for row in counts:
        target[row["bucket"]] += row["t"]
        raw[row["bucket"]] += row["r"]
    if not any(row["t"] for row in counts):
        return [0.0] * (2 * BUCKETS)
    from math import log

    out = []
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        t, r = sum(target[half]), sum(raw[half])
        out += [log(a / t) - log(b / r) for a, b in zip(target[half], raw[half])]
    return out


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def with_verdict(docs: DataFrame, ratios: list[float], keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` (with a column text) and ``quality``: the counts, log_ratio, base_failed and kept.

    A null text counts as empty; a text without words fails. ``log_ratio`` is the mean over
    the n-grams of the text (0 without any). A column called quality is replaced.
    """
    text = _text()
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    mean = lambda b: F.when(
        F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, k: a + table[k]) / F.size(b)
    ).otherwise(F.lit(0.0))
    of_words = lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), _repeat_words(h).cast("long").alias("n_repeat_words"), _bound(_bound(_word_buckets(h), _buckets), mean).alias("log_ratio")
    )
    measured = docs.drop("quality").withColumn(
        "quality",
        F.struct(
            _bound(_hashes(text), of_words).alias("words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    q = F.col("quality")
    n, repeated, ratio = q["words"]["n_words"], q["words"]["n_repeat_words"], q["words"]["log_ratio"]
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    return measured.withColumn(
        "quality",
        F.struct(
            n.alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
            repeated.alias("n_repeat_words"), ratio.alias("log_ratio"), failed.alias("base_failed"), (~failed & (ratio >= keep_from)).alias("kept"),
        ),
    )
