import random

import pytest
from pyspark.sql import functions as F

from revtables.operators import chain as chains
from revtables.operators.chain import chain, first_parents, frontier
from revtables.operators.interval_join import interval_join
from revtables.operators.positions import with_position, with_previous


def test_positions_with_one_time_for_most_rows(spark):
    rng = random.Random(3)
    data = [(7 if n % 3 else rng.randrange(100), n) for n in range(5000)]
    rng.shuffle(data)
    placed = with_position(spark.createDataFrame(data, "t int, id int"), [F.col("t"), F.col("id")])
    assert {(r.t, r.id): r.position for r in placed.collect()} == {x: i for i, x in enumerate(sorted(data))}


def test_previous_with_one_key_for_most_rows(spark):
    data = [("hot" if n % 3 else f"k{n % 50}", n, f"v{n}") for n in range(3000)] + [(None, 1, "n1"), (None, 2, "n2")]
    got = with_previous(spark.createDataFrame(data, "k string, n int, v string"), ["k"], ["n"], ["v"]).collect()
    last, want = {}, {}
    for k, n, v in sorted(data, key=lambda x: (x[0] or "", x[1])):
        want[k, n] = last.get(k)
        last[k] = v
    assert {(r.k, r.n): r.previous_v for r in got} == want


def test_interval_join_finds_each_pair_once(spark):
    rng = random.Random(5)
    points = [(rng.randrange(2), rng.randrange(400)) for _ in range(200)]
    spans = [(rng.randrange(2), a, a + rng.choice([-1, 0, 3, 64, 300])) for a in (rng.randrange(400) for _ in range(80))]
    p = spark.createDataFrame(points, "f int, x int")
    s = spark.createDataFrame(spans, "f int, a int, b int")
    got = sorted(map(tuple, interval_join(p, s, ["f"], "x", "a", "b").select("f", "x", "a", "b").collect()))
    assert got == sorted((f, x, a, b) for f, x in points for g, a, b in spans if f == g and a <= x <= b)


def test_giant_intervals_go_to_few_bins(spark):
    # nested blocks: one around the whole file, halves, quarters and so on
    spans = [(k * (1 << 20 - depth), (k + 1) * (1 << 20 - depth) - 1) for depth in range(9) for k in range(1 << depth)]
    intervals = spark.createDataFrame(spans, "a long, b long").withColumn("f", F.lit(1))
    points = spark.range(0, 1 << 20, 4099).select(F.lit(1).alias("f"), F.col("id").alias("x"))
    joined = interval_join(points, intervals, ["f"], "x", "a", "b")
    assert joined.count() == 9 * points.count()
    exploded = next(
        int(n) for n in [spark.createDataFrame(spans, "a long, b long").select(
            F.sum(F.floor(F.col("b") / (64 * F.pow(F.lit(4), F.ceil(F.log(4.0, (F.col("b") - F.col("a") + 1) / 64))))
                          ) - F.floor(F.col("a") / (64 * F.pow(F.lit(4), F.ceil(F.log(4.0, (F.col("b") - F.col("a") + 1) / 64))))) + 1)
        ).first()[0]]
    )
    assert exploded <= 2 * len(spans)


def commits(spark, parents):
    return spark.createDataFrame([(c, list(p)) for c, p in parents.items()], "commit_id long, parent_ids array<long>")


@pytest.mark.parametrize("few", [20_000, 3])
@pytest.mark.parametrize("binary", [False, True])
def test_chain_over_many_stretches(spark, monkeypatch, few, binary):
    monkeypatch.setattr(chains, "STRETCH", 40)
    monkeypatch.setattr(chains, "FEW_STEPS", few)
    rng = random.Random(11)
    number = list(range(1, 401))
    if binary:
        rng.shuffle(number)
    name = (lambda n: bytearray(number[n].to_bytes(4, "big"))) if binary else (lambda n: number[n] + (1 << 60))
    rows = []
    for n in range(300):
        # the chain with some dates far off, and branches that leave it
        time = n * 10 if rng.random() < 0.9 else rng.randrange(3000)
        rows.append((name(n), [name(n - 1)] * (n > 0) + [name(399)] * (n % 9 == 1), time))
    rows += [(name(300 + k), [name(rng.randrange(300))], rng.randrange(3000)) for k in range(100)]
    table = spark.createDataFrame(rows, f"commit_id {'binary' if binary else 'long'}, parent_ids array<{'binary' if binary else 'long'}>, author_seconds long")
    start = F.lit(bytes(name(299))) if binary else F.lit(name(299))
    got = {bytes(r.commit_id) if binary else r.commit_id: r.position for r in chain(table, start).collect()}
    assert got == {bytes(name(n)) if binary else name(n): 299 - n for n in range(300)}
    assert chain(table, F.lit(b"none") if binary else F.lit(1)).count() == 0


def test_chain_takes_first_parents_and_ends_at_a_missing_one(spark):
    parents = {n: [n - 1, 500 + n] for n in range(2, 40)} | {1: [999]} | {500 + n: [] for n in range(40)}
    table = commits(spark, parents)
    got = {r.commit_id: r.position for r in chain(table, F.lit(39)).collect()}
    assert got == {39 - n: n for n in range(39)}
    assert {r.commit_id: r.parent_id for r in first_parents(table).where("commit_id < 3").collect()} == {1: None, 2: 1}
    assert [tuple(r) for r in chain(table, F.lit(520)).collect()] == [(520, 0)]


def test_frontier(spark):
    positions = spark.createDataFrame([(100 - n, n) for n in range(10)], "commit_id long, position long")

    def todo(*stored):
        table = spark.createDataFrame([(c, c * 10) for c in stored], "commit_id long, seconds_since_epoch long")
        return sorted(r.commit_id for r in frontier(positions, table).collect())

    assert todo() == list(range(91, 101))
    assert todo(95, 96, 97) == [91, 92, 93, 94, 98, 99, 100]
    assert todo(*range(91, 101)) == []
    assert todo(1) == list(range(91, 101))
