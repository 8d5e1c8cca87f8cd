"""Toxicity of texts: a linear classifier over character n-grams.

A feature is an n-gram of 3 to 5 characters, told from others by 64 bits and present in a text or not. Its value is
its naive Bayes log-count ratio, the logarithm of how much likelier toxic training texts
are to have it; a logistic regression over these values, fitted on labelled texts, gives
the score. Presence counts once, so a long text is not toxic for its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.llm.texts import LOWER, code_points, mix, slices, utf8
from revtables.session import cut_lineage

SIZES = (3, 4, 5)
#: Low bits of a hash that tell most n-grams that are no features before they are looked up.
COARSE = 1 << 18
#: Hashes that a task holds before it counts and hands them on.
HELD = 2_000_000
#: The classifier is fitted on so many labelled rows at most, those of the smallest hash.
TRAINING_ROWS = 12_000
#: and on so many features at most, those with the largest weight of evidence.
FEATURES = 6_000
#: A feature counts if so many training texts have it.
LEAST_TEXTS = 4
REJECT_FROM = 0.7


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(size, hash of the n-gram from each place on) over all texts, and the bounds of the texts."""
    points, at = code_points(LOWER[data], offsets)
    points = points.astype(np.uint64) + np.uint64(1)
    points = np.where((points >= 10) & (points <= 14), np.uint64(33), points)
    grams = []
    total = np.zeros(len(points), np.uint64)
    for size in range(1, max(SIZES) + 1):
        total = total[: max(0, len(points) - size + 1)] * np.uint64(1_000_003) + points[size - 1 :]
        if size in SIZES:
            grams.append((size, mix(total + (np.uint64(size) << np.uint64(56))).view(np.int64)))
    return grams, at


def text_features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    grams, at = _grams(data, offsets)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        of_text = [g[a : z - size + 1] for size, g in grams if z - a >= size]
        out.append(np.unique(np.concatenate(of_text)) if of_text else np.zeros(0, np.int64))
    return out


def chosen_features(data: np.ndarray, offsets: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text and each of the sorted ``features`` (by its place in them) that it has, once."""
    grams, at = _grams(data, offsets)
    coarse = np.zeros(COARSE, bool)
    coarse[features & (COARSE - 1)] = True
    pairs = [np.zeros(0, np.int64)]
    for size, g in grams:
        place = np.flatnonzero(coarse[g & (COARSE - 1)])
        k = np.searchsorted(features, g[place])
        hit = features[np.minimum(k, len(features) - 1)] == g[place] if len(features) else np.zeros(len(place), bool)
        place, k = place[hit], k[hit]
        text = np.searchsorted(at, place, side="right") - 1
        inside = place + size <= np.asarray(at)[text + 1]
        pairs.append(text[inside] * len(features) + k[inside])
    found = np.unique(np.concatenate(pairs))
    return (found // len(features), found % len(features)) if len(features) else (found, found)


def _sliced(batch: pa.RecordBatch):
    """Number of texts, their bytes and offsets, slice by slice."""
    data, offsets = utf8(batch.column("text"))
    for a, z in slices(offsets):
        yield z - a, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]


def _featured(batch: pa.RecordBatch):
    for _, data, offsets in _sliced(batch):
        yield from text_features(data, offsets)


def _chosen(batch: pa.RecordBatch, features: np.ndarray):
    """Texts and places of features as of :func:`chosen_features`, over the whole batch."""
    first = 0
    for n, data, offsets in _sliced(batch):
        text, k = chosen_features(data, offsets, features)
        yield text + first, k
        first += n


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled documents, those with the smallest hash.

    A document with several labels counts as toxic if one says so; labels that are null or
    name no document are left out.
    """
    by_doc = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def fit(rows: DataFrame) -> Model | float:
    """Fit on (text, toxic). Without texts of both kinds, the share of toxic ones instead."""

    def counts(batches):
        def told(held):
            kinds = [np.concatenate([x for label, x in held if label == k] or [np.zeros(0, np.int64)]) for k in (1, 0)]
            some, place = np.unique(np.concatenate(kinds), return_inverse=True)
            toxic = np.bincount(place[: len(kinds[0])], minlength=len(some))
            clean = np.bincount(place[len(kinds[0]) :], minlength=len(some))
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array(toxic), pa.array(clean)], ["gram", "toxic", "clean"])

        held, size = [], 0
        for batch in batches:
            for label, found in zip(batch.column("toxic").to_pylist(), _featured(batch)):
                held.append((int(bool(label)), found))
                size += len(found)
                if size >= HELD:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    rows = cut_lineage(rows)
    n_clean, n_toxic = (rows.where(F.col("toxic") == k).count() for k in (0, 1))
    if not n_clean or not n_toxic:
        return n_toxic / max(1, n_clean + n_toxic)
    per_gram = rows.mapInArrow(counts, "gram long, toxic long, clean long").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    p, q = (F.col("toxic") + 1) / (n_toxic + 2), (F.col("clean") + 1) / (n_clean + 2)
    evidence = F.abs(F.log(p / q)) * F.sqrt(F.least("toxic", F.lit(n_toxic)) + F.col("clean") * n_toxic / n_clean)
    best = (
        per_gram.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
        .select("gram", F.log(p / q).alias("ratio"), evidence.alias("evidence"))
        .orderBy(F.desc("evidence"), "gram").limit(FEATURES).collect()
    )
    best = sorted((r["gram"], r["ratio"]) for r in best)
    features, ratios = np.array([g for g, _ in best], np.int64), np.array([r for _, r in best])

    def chosen(batches):
        for batch in batches:
            parts = list(_chosen(batch, features))
            text, k = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            found = [k[a:z].astype(np.int32) for a, z in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"]
            )

    table = rows.mapInArrow(chosen, "toxic int, found array<int>").toPandas()
    weights, bias = _regression(table["found"].tolist(), table["toxic"].to_numpy(np.float64), ratios)
    return Model(features, weights * ratios, bias)


def _regression(found: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, rounds: int = 300, penalty: float = 0.3):
    """Logistic regression by accelerated gradient steps on sparse rows."""
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    column = np.concatenate([np.asarray(x, np.int64) for x in found]) if len(found) else np.zeros(0, np.int64)
    value = ratios[column]
    n, m = len(y), len(ratios)
    w, bias = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column] * value, n) + bias
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.append(np.bincount(column, miss[row] * value, m) / n + penalty / n * w, miss.mean())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:m], bias - float(step[m])
    return w, bias


def with_score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``docs`` (with a column text) and the score of each whole text, from 0 to 1.

    A null text is scored as an empty one, and an empty text has the score of no evidence.
    A column that is called score already is replaced.
    """
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    docs = docs.drop("score")
    def run(batches):
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for text, k in _chosen(batch, model.features):
                z += np.bincount(text, model.weights[k], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
