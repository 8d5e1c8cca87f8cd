"""Long arrays and texts in expressions, and the operators that use them."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from revtables.llm import arrays, chat, pii


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 33, 1024, 1025, 40_000])
def test_running(spark, n):
    dice = random.Random(n)
    values = [dice.randrange(100) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    row = df.select(arrays.running_sum(F.col("v")).alias("s"), arrays.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).first()
    total, most, sums, tops = 0, 0, [], []
    for x in values:
        total, most = total + x, max(most, x)
        sums.append(total)
        tops.append(most)
    assert row["s"] == sums and row["m"] == tops


def test_cuts(spark):
    dice = random.Random(1)
    text = "".join(dice.choices("ab\n é漢😀", k=5000))
    spans = [tuple(sorted(dice.choices(range(5001), k=2))) for _ in range(100)] + [(0, 5000), (0, 0), (5000, 5000), (999, 1000), (1000, 2000), (4999, 5000)]
    df = spark.createDataFrame([(text, a, z) for a, z in spans], "t string, a int, z int")
    got = df.select("a", "z", arrays.cut(arrays.chunks(F.col("t")), F.col("a"), F.col("z")).alias("c")).collect()
    assert all(r["c"] == text[r["a"] : r["z"]] for r in got)


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{k}@b.de 1.2.3.{k % 300} é" for k in range(20_000))
    row = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(
        "spans", pii.masked(F.col("text"), F.col("spans")).alias("m")
    ).first()
    listed = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"])
    emails, ips, cards, phones, digest = brute.personal_data(text)
    assert (emails, cards, phones, brute.sha256(listed)) == (20_000, 0, 0, digest) and len(row["spans"]) == emails + ips
    assert row["m"] == " ".join(f"[email] {'[ip]' if k % 300 < 256 else f'1.2.3.{k % 300}'} é" for k in range(20_000))


def test_many_turns_in_one_conversation(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"turn {k} <|im_sep|> 😀") for k in range(20_000)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).first()
    assert [(t["role"], t["text"]) for t in row["t"]] == [r[2:] for r in rows] and row["l"] == [r[3] for r in rows if r[2] == "assistant"]
