"""The audit of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from revtables.llm import queries, source_audit
from revtables.llm.source_audit import audit, eight_bytes, sorted_pointers

SF = "/root/testdata/sf0.001"


def plain(rows, least=10, most=10):
    """Of (text, lang, source): the sorted rows of the audit."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: Counter({t: counts[lang, s][t] for t in kept}) for s in sources}
        whole = sum(of.values(), Counter())

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        share, all_ = {s: shares(c) for s, c in of.items()}, shares(whole)
        for s in sources:
            pairs = [(sum(apart(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(apart(share[s][t], all_[t]), t) for t in kept if of[s][t] and share[s][t] > all_[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < most]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    assert found(queries.op12_source_audit(spark, SF)) == plain(rows)


@pytest.mark.parametrize("size,tile", [(60, 1), (4 << 20, 256)])
def test_odd_rows(spark, monkeypatch, size, tile):
    monkeypatch.setattr(source_audit, "TILE", tile)
    monkeypatch.setattr(source_audit, "LEAST_SHARDS", 2)
    dice = random.Random(5)
    words = ["É", "é", "Fee", "fee", "x", "longerthaneight", "longerthaneighu", "longerthan", "漢字", "a" * 300, "a" * 301, "b1c", "\0z"]
    rows = [(" ".join(dice.choices(words, k=dice.randint(0, 40))), dice.choice(["en", "de", None]), dice.choice(["s", "t", "u", None])) for _ in range(60)]
    rows += [(None, "en", "only"), ("", "none", "a"), ("1 2 3", "none", "b"), ("rare", "fr", "one"), (None, None, None)] + [("tie tie", "it", "x"), ("tie tie", "it", "y")] * 3
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, value int, terms int")
    for least in (1, 3, 10):
        assert found(audit(df, least, 3, size)) == plain(rows, least, 3)
    assert audit(df.limit(0)).count() == 0


def test_pointers_in_order():
    dice = random.Random(2)
    for small in (2, 70, 1 << 14):
        words = [bytes(dice.choices(b"ab\xc3", k=dice.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(400)] + [b"same"] * 300
        dice.shuffle(words)
        data = np.frombuffer(b" ".join(words), np.uint8)
        start = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        end = start + [len(w) for w in words]
        order, begins = sorted_pointers(eight_bytes(data), start, end, small)
        assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
        told = [words[order[i]] for i in begins]
        assert told == sorted(set(words))
