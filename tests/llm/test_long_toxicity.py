"""Scores of very long texts say what the texts hold, not what shares a bucket with it."""

import random

import numpy as np
import pytest

from revtables.llm import toxicity

CURSES = ["zorgblat", "quixnarf", "vlimptug", "jexwoddle"]


def prose(rng, characters):
    words, size = [], 0
    while size < characters:
        words.append("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))))
        size += len(words[-1]) + 1
    return " ".join(words)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = prose(rng, 400).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(CURSES))
        rows.append((" ".join(words), int(i % 4 == 0)))
    return toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))


def test_features_of_a_long_text_are_in_it(model):
    """Every feature found is an n-gram of the text by its whole hash."""
    text = prose(random.Random(1), 1_000_000)
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    _, k = toxicity.chosen_features(data, offsets, model.features)
    assert set(model.features[k]) == set(model.features) & set(toxicity.text_features(data, offsets)[0].tolist())
    grams = {text[i : i + n] for n in toxicity.SIZES for i in range(len(text) - n + 1)}
    distinct = len(toxicity.text_features(data, offsets)[0])
    assert distinct == len(grams) > 1 << 18


def test_features_of_texts_beside_each_other():
    texts = ["", "ab", "abcd", "", "bcdabc", "xyz", "abc"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    each = toxicity.text_features(data, offsets)
    features = np.unique(np.concatenate(each))
    text, k = toxicity.chosen_features(data, offsets, features)
    for i, want in enumerate(each):
        assert features[k[text == i]].tolist() == want.tolist()


@pytest.mark.xfail(reason="presence counts once, so in random prose all weak clean features of a long text outweigh the toxic ones")
def test_clean_and_toxic_texts_of_a_million_characters(spark, model):
    rng = random.Random(2)
    clean = prose(rng, 1_000_000)
    words = prose(rng, 980_000).split(" ")
    toxic = " ".join(w if i % 25 else w + " " + rng.choice(CURSES) for i, w in enumerate(words))
    out = toxicity.with_score(spark.createDataFrame([(0, clean), (1, toxic)], "doc_id long, text string"), model)
    score = {r["doc_id"]: r["score"] for r in out.collect()}
    assert score[0] < 0.1 and score[1] >= toxicity.REJECT_FROM
