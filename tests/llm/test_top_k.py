"""Bit-sliced search against plain inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtables.llm import queries, top_k
from revtables.llm.top_k import Adder, highest, score_slices, signed_digits, slices_of

SF = "/root/testdata/sf0.001"


def plain(rows, is_query, k):
    """Of (id, vector): sorted (query_id, rank, vec_id, score)."""

    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) or abs(x) >= 65_536 for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    known = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    out = []
    for own, q in known:
        if own is None or not is_query(own):
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), i is None, i) for i, v in known if i != own]
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(own, r + 1, i, -s) for r, (s, _, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(queries.op13_exact_top_k(spark, SF)) == plain(rows, lambda i: i % 100 == 0, 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, -2.0]), (1, [1.0, -2.0]), (2, [1.0, -2.0]), (2, [1.0, -2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 0.0]),
        (6, [float("inf"), 0.0]), (7, []), (8, [0.0, 0.0, 9.0]), (9, [-60_000.5, 65_000.25]), (10, [65_536.0, 0.0]), (None, [3.0, -2.0]), (11, [0.0004, -0.0004]),
        (20, [5.0]), (20, [5.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, block int")
    for k in (1, 3, 50):
        assert found(top_k.top_k(df, F.col("vec_id") >= 0, k)) == plain(rows, lambda i: i >= 0, k)
    assert top_k.top_k(df, F.lit(None).cast("boolean"), 3).count() == 0
    assert top_k.top_k(df.limit(0), F.col("vec_id") >= 0, 3).count() == 0


@pytest.mark.parametrize("block,most", [(7, 3), (40, 1000)])
def test_many_ties_over_many_blocks(spark, monkeypatch, block, most):
    monkeypatch.setattr(top_k, "LEAST_QUERIES", 1)
    monkeypatch.setattr(top_k, "MOST_QUERIES", most)
    dice = random.Random(3)
    rows = [(i, [dice.choice((-1.0, 0.0, 0.5)) for _ in range(3)]) for i in range(60)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(40)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(top_k.top_k(df, F.col("vec_id") % 10 == 0, 10, block=block)) == plain(rows, lambda i: i % 10 == 0, 10)


def test_slices_add_up():
    dice = np.random.default_rng(1)
    for _ in range(40):
        n, dims, size = dice.integers(1, 150), dice.integers(1, 9), int(dice.choice([1, 50, 1 << 26]))
        rows, query = dice.integers(-size, size, (n, dims)), dice.integers(-size, size, dims)
        plus, minus = signed_digits(query)
        assert (plus - minus == query).all() and not ((plus | minus) & ((plus | minus) << 1)).any()
        low, bits, slices = slices_of(rows)
        words = slices.shape[2]
        total, constant = score_slices(slices, low, query, Adder(bits + 4, words), Adder(bits + 34, words))
        scores = top_k.scores_of(total, np.arange(n), constant)
        assert scores == [sum(int(a) * int(b) for a, b in zip(r, query)) for r in rows]
        every = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
        k = int(dice.integers(1, 12))
        want = sorted(range(n), key=lambda i: (-scores[i], i))[:k]
        assert sorted(highest(total, every, k).tolist()) == sorted(want)
