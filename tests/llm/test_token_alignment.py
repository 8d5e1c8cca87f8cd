"""Alignment of two tokenizers against a plain version, text by text."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from revtables.llm import queries
from revtables.llm.token_alignment import BYTE_LEVEL, PIECES, Block, aligned, vocabularies

SF = "/root/testdata/sf0.001"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts):
    """For each text its numbers, with loops over tokens."""
    v = vocabularies(BYTE_LEVEL, PIECES)
    cut, counts = [], Counter()
    for text in texts:
        ids = [t.ids([text])[0] for t in (v.first, v.second)] if text else [[], []]
        sides = []
        for t, side in zip((v.first, v.second), ids):
            at, spans = 0, []
            for i in side:
                spans.append((i, at, at + len(t.bytes[i])))
                at += len(t.bytes[i])
            sides.append(spans)
        if not text or any(b"".join(t.bytes[i] for i in side) != b" " + text.encode() for t, side in zip((v.first, v.second), ids)):
            sides = [[], []]
        links = [(i, j) for i, a, z in sides[0] for j, c, e in sides[1] if a < e and c < z] if len(sides[0]) < 3000 else None
        if links is None:
            links, k = [], 0
            for i, a, z in sides[0]:
                while sides[1][k][2] <= a:
                    k += 1
                m = k
                while m < len(sides[1]) and sides[1][m][1] < z:
                    links.append((i, sides[1][m][0]))
                    m += 1
        cut.append((sides, links))
        counts.update(links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (first, second), links in cut:
        ends = sorted({s[2] for s in first} & {s[2] for s in second})
        groups, a, b = [], 0, 0
        for end in ends:
            parts = []
            for side, start in ((first, a), (second, b)):
                k = start
                while k < len(side) and side[k][2] <= end:
                    k += 1
                parts.append((",".join(str(s[0]) for s in side[start:k]), k))
            (one, a), (other, b) = parts
            groups.append(f"{one}|{other}")
        told = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(first), len(second), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), told))
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows])))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, SF).collect()}
    assert got == want


ODD = [
    None, "", " ", "a", "a", "  two  spaces ", "line\nline\r\n\ttab", "É à ü 漢字 😀 end", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ a", "\0x\x7f", "a" * 5000,
    "é ﬁ   ​ x", "the the the", "1234567 89.01", "x" * 40 + " y" * 40, "un" * 3, "aaa aaaa aaaaa", "naïve café", "அக",
]


@pytest.mark.parametrize("size", [30, 4 << 20])
def test_odd_texts(spark, size):
    rows = [(i, t, 1, "x", "y z") for i, t in enumerate(ODD)] + [(None, "the the the", 2, "x", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, alignment string, `odd name` string")
    want = plain([r[1] for r in rows])
    out = aligned(df, ["doc_id", "n_a", "alignment", "odd name"], size=size)
    assert out.columns == ["doc_id", "n_a", "odd name", "alignment"]
    got = {r["doc_id"]: tuple(r["alignment"][c] for c in COLUMNS) for r in out.collect()}
    assert got == {r[0]: w for r, w in zip(rows, want)}
    assert want[8][0] > 0 and want[9][0] == 0 and want[0] == want[1] == (0, 0, 0, 0, 0, 0, "")
    assert aligned(df.limit(0), ["doc_id"]).count() == 0
    assert aligned(df.where("text IS NULL"), ["doc_id"]).select(F.max("alignment.n_a")).first()[0] == 0


def test_both_libraries_cut_alike(spark):
    v = vocabularies(BYTE_LEVEL, PIECES)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t or "" for t in ODD]
    # white space, marks, digits and letters of every kind, next to each other in all ways
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}  {chr(c)}{chr(c)}!{chr(c)}'s" for c in [*range(0x3100), *range(0x1F000, 0x20000, 7), *range(0x30000, 0x32000, 5)]]
    texts += [" " * n + "x" for n in (199_999, 200_000, 3_000_000)] + ["a" * 200_000, "\n" * 200_000, "!" * 200_000]
    assert v.first.table is not None and v.first.ids(texts) == v.first.slower_ids(texts)


def test_same_bytes():
    v = vocabularies(BYTE_LEVEL, PIECES)
    assert all(v.same[i] < 0 or v.second.bytes[v.same[i]] == b for i, b in enumerate(v.first.bytes))
    assert (v.same >= 0).sum() > 10_000
    assert sorted({b for b in v.first.bytes if len(b) == 1}) == [bytes([k]) for k in range(256)]
    assert Block(v, ["", "▁"]).written_groups() == []
