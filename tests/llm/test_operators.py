"""Each operator against a plain version, over the small tables and over rows that are odd."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from revtables.llm import chat, html_text, mixing, pii, quality_rules, queries, suffix_dedup, toxicity, warc
from revtables.llm.decontamination import is_contaminated, n_hit, search_items
from revtables.llm.fm_index import FmIndex
from revtables.llm.html_tree import parse
from revtables.llm.near_duplicates import near_duplicates

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 9000
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (6, "É à ü 漢字 😀 end"), (7, LONG), (8, LONG + "x"),
    (9, "a" * 5000), (None, "no id here at all"), (10, "\0\0 zero \0"), (11, "the same line\nthe same line\n\nthe same line"),
    (12, "+1 (743) 555-3824 card 4539 1488 0343 6467 mail a.b@c.de, 1.2.3.4 and 999.1.1.1 b@c"), (13, "tie"), (14, "tie"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "score", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


def rows_of(df, *columns):
    return {r[columns[0]]: tuple(r[c] for c in columns[1:]) for r in df.collect()}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


# 1 ---------------------------------------------------------------------------------


def test_suffix_dedup_query(spark, documents):
    got = rows_of(queries.op1_suffix_dedup(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(pairs(documents))


def _dedup(df, length, gram):
    out = suffix_dedup.with_kept(df, length, gram)
    return sorted((r["doc_id"] or 0, r["dedup"]["n_bytes"], len(r["dedup"]["removed"]), brute.sha256(bytes(r["dedup"]["kept"]))) for r in out.collect())


def _plain(rows, length):
    keyed = list(enumerate(t for _, t in rows))
    out = brute.suffix_dedup(keyed, length)
    return sorted((rows[k][0] or 0, v[0], v[2], v[3]) for k, v in out.items())


@pytest.mark.parametrize("many,most", [(400, 20_000), (2, 20_000), (2, 3)])
def test_suffix_dedup_on_odd_rows(spark, odd, monkeypatch, many, most):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "MOST_PIECES", most)
    dice = random.Random(3)
    passage = "".join(dice.choice("abcdef ") for _ in range(90))
    short = [(i, t) for i, t in ODD if len(t or "") < 6000]
    more = [(100 + k, "".join(dice.choice("abc") for _ in range(50)) + passage[: 60 + k] + "".join(dice.choice("abc") for _ in range(50))) for k in range(30)]
    df = spark.createDataFrame(short + more, "doc_id long, text string")
    assert _dedup(df, 40, 8) == _plain(short + more, 40)
    assert _dedup(empty(spark), 40, 8) == []


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 30_000)
    dice = random.Random(9)
    noise = lambda n: "".join(dice.choices("abcdefgh é", k=n))
    passage, other = noise(3000), noise(700)
    rows = [(1, noise(29_000) + passage + noise(150_000) + other + noise(20_000) + passage), (2, noise(500) + other + noise(40)), (3, "ab" * 45_000), (4, None), (5, noise(399))]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, dedup string")
    assert _dedup(df, 400, 32) == _plain(rows, 400)


def test_suffixes_in_order():
    dice = random.Random(5)
    for alphabet in (b"a", b"ab", b"abcd", bytes(range(256))):
        for _ in range(30):
            body = bytes(dice.choice(alphabet) for _ in range(dice.randint(1, 300))) + b"\0"
            symbols = np.frombuffer(body, np.uint8)
            inside = np.sort(np.array(dice.sample(range(len(body) - 1), dice.randint(1, len(body) - 1))))
            order = suffix_dedup.sorted_suffixes(symbols, inside, 1000)
            assert set(inside.tolist()) <= set(order.tolist())
            texts = [body[i:] for i in order.tolist()]
            assert [t.rstrip(b"\0") for t in texts] == sorted(t.rstrip(b"\0") for t in texts) or 0 in alphabet
            shared = suffix_dedup.common_prefixes(symbols, order, 64)
            for k in range(1, len(order)):
                n = 0
                while n < 64 and n < min(len(texts[k]), len(texts[k - 1])) and texts[k][n] == texts[k - 1][n]:
                    n += 1
                assert min(shared[k], len(texts[k]), len(texts[k - 1])) == n or shared[k] == n


# 2 ---------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    out = queries.op2_toxicity(spark, sf).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    seen = {(r["toxic"], r["predicted"]): r["n"] for r in out.where("held_out AND lang = 'en'").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert seen.get((1, 1), 0) >= 0.85 * (seen.get((1, 1), 0) + seen.get((1, 0), 0))
    assert seen.get((0, 1), 0) <= 0.02 * (seen.get((0, 0), 0) + seen.get((0, 1), 0))


def test_toxicity_on_odd_rows(spark, odd):
    rows = spark.createDataFrame([("you idiot clown", 1), ("fine words here", 0), (None, 0), ("", 1)] * 5, "text string, toxic int")
    model = toxicity.fit(rows)
    scored = toxicity.with_score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.with_score(empty(spark), model).count() == 0
    for no_model in (toxicity.fit(rows.limit(0)), toxicity.fit(rows.where("toxic = 1"))):
        assert isinstance(no_model, float)
        assert toxicity.with_score(odd, no_model).count() == len(ODD)


# 3 ---------------------------------------------------------------------------------


def test_html_text_of_the_pages(spark):
    import html
    import re

    out = rows_of(queries.op3_html_text(spark, SF), "page_id", "text", "n_chars")
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", row["html"], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert out[row["page_id"]] == (want, len(want))


def test_html_text_on_odd_pages(spark):
    odd = [None, "", "   ", "plain text", "<p>a &amp; b<p>c", "<script>x</script>", "<b", "<!-- open", "<div " * 50, "<p title='>'>x</p>", "<p>" + LONG, "<p>a</p>" * 3000]
    df = spark.createDataFrame([(i, h, "own") for i, h in enumerate(odd)], "page_id long, html string, text string")
    model = html_text.fit(html_text.training_pages(spark.read.parquet(f"{SF}/pages.parquet"), 20), rounds=20)
    out = {r["page_id"]: r["text"] for r in html_text.with_text(df, model).collect()}
    assert len(out) == len(odd) and out[0] == out[1] == out[2] == out[5] == ""
    assert html_text.with_text(df.limit(0), model).count() == 0
    assert html_text.with_text(df, html_text.fit([])).count() == len(odd)


def test_messages_give_the_marginals():
    nodes = parse("<div><p>a b c</p><ul><li>d</li><li>e f</li></ul></div>")
    dice = np.random.default_rng(1)
    model = html_text.Model(dice.normal(size=html_text.FEATURES), dice.normal(size=(len(html_text.KINDS), 2, 2)))
    forest = html_text.Forest([nodes])
    n = len(nodes)
    score = np.bincount(forest.row, model.weights[forest.feature], n)
    total, on = 0.0, np.zeros(n)
    for state in range(1 << n):
        y = [(state >> i) & 1 for i in range(n)]
        e = sum(score[i] * y[i] for i in range(n)) + sum(model.ties[forest.kind[i], y[nodes[i].parent], y[i]] for i in range(1, n))
        total += np.exp(e)
        on += np.exp(e) * np.array(y)
    assert np.allclose(forest.beliefs(model)[0], on / total)


# 4 ---------------------------------------------------------------------------------


def test_chat_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(queries.op4_chat(spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.chat(turns)


def test_chat_round_trip_of_odd_turns(spark):
    turns = [
        (1, 0, "user", "<|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "<\\|im_sep|>\\<|"), (1, 3, "assistant", ""), (1, 4, None, "x\n"),
        (2, 0, "a\nb<|im_end|>", "x"), (3, None, "assistant", "<<||>>"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, 0, "user", LONG),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.formatted(df)
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l"))
    for row in read.collect():
        want = sorted(((k is not None, k or 0, r or "", t or "") for c, k, r, t in turns if c == row["conv_id"]))
        assert [(t["role"], t["text"]) for t in row["t"]] == [w[2:] for w in want]
        assert row["l"] == [w[3] for w in want if w[2] == "assistant"]
    assert chat.formatted(df.limit(0)).count() == 0


# 5 ---------------------------------------------------------------------------------


def test_personal_data_query(spark, documents):
    got = rows_of(queries.op5_personal_data(spark, SF), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {i: brute.personal_data(t) for i, t in pairs(documents)}


def test_personal_data_on_odd_texts(spark, odd):
    texts = [t for _, t in ODD] + [
        "a@b.c_d@e.f", "x@y", "a@b..c", "1.2.3.4.5.6.7.8", "1.2.3", "+1+1234567890", "+12 34567890 ", "4539148803436467 4539 1488 0343 6467",
        "😀 a@b.de 😀 1.1.1.1", "1.1.1.1@a.b", "." * 3000 + "@a.b", "1 " * 4000, "9" * 5000, "a@b" + ".c" * 4000, "007.1.1.255", "@@a@b.c@d.e",
        "IBAN DE89370400440532013000 here", "my ssn 123-45-6789", "123-45-6789", "call 743-555-3824",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = pii.with_spans(df).collect()
    for row in out:
        base = [s for s in row["spans"] if s["base"]]
        counts = [sum(s["kind"] == k for s in base) for k in ("email", "ip", "card", "phone")]
        listed = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
        assert (*counts, brute.sha256(listed)) == brute.personal_data(row["text"]), row["text"]
    kinds = {r["text"]: [s["kind"] for s in r["spans"]] for r in out}
    assert kinds["IBAN DE89370400440532013000 here"] == ["iban"] and kinds["my ssn 123-45-6789"] == ["ssn"]
    assert kinds["123-45-6789"] == [] and kinds["call 743-555-3824"] == ["local_phone"]
    masked = {r["text"]: r["m"] for r in pii.with_spans(df).select("text", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert masked["😀 a@b.de 😀 1.1.1.1"] == "😀 [email] 😀 [ip]" and masked[""] == "" and masked[None] is None
    assert pii.with_spans(empty(spark)).count() == 0


# 6 ---------------------------------------------------------------------------------


def test_near_duplicates_query(spark, documents):
    got = rows_of(queries.op6_near_duplicates(spark, SF), "doc_id", "n_shingles", "component_id")
    assert got == brute.near_duplicates(pairs(documents), 3, 85)


def test_near_duplicates_in_one_large_group(spark, monkeypatch):
    from revtables.llm import near_duplicates as module

    monkeypatch.setattr(module, "BLOCK", 20)
    dice = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(dice.randint(0, 6)):
            words[dice.randrange(len(words))] = f"x{dice.randrange(10_000)}"
        rows.append((1000 - i, " ".join(words)))
    want = brute.near_duplicates(rows, 3, 85)
    got = rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85), "doc_id", "n_shingles", "component_id")
    assert got == want


def test_near_duplicates_on_odd_rows(spark, odd):
    out = near_duplicates(odd, 3, 85)
    assert out.count() == len(ODD)
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()]
    assert (13, 13, True) in got and (14, 13, False) in got and (8, 8, True) in got and (None, None, True) in got
    assert near_duplicates(empty(spark)).count() == 0


# 7 ---------------------------------------------------------------------------------


def test_raking_meets_its_targets(spark, documents):
    rows = mixing.mixed(documents, rounds=30)
    cells = rows.groupBy(*mixing.MARGINS).agg(F.first("weight").alias("w"), F.sum("n_tokens").alias("t"))
    table = cells.toPandas()
    for m, power in mixing.POWERS.items():
        target = table.groupby(m)["t"].sum() ** power
        assert np.allclose(table.groupby(m)["w"].sum() / table["w"].sum(), target / target.sum(), atol=0.02)
    totals = rows.agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).first()
    assert abs(totals["e"] - mixing.RATE * totals["t"]) < 1e-6 * totals["t"]


def test_mixing_on_odd_rows(spark, odd):
    df = odd.withColumns({"source": F.when(F.col("doc_id") > 5, "a"), "lang": F.lit(None).cast("string"), "weight": F.lit("x")})
    out = mixing.mixed(df).collect()
    assert len(out) == len(ODD) and not any(r["sampled"] for r in out if not r["n_tokens"])
    assert mixing.mixed(df.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------


def test_warc_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    got = rows_of(queries.op8_warc(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.archive(pages)


def test_warc_on_odd_pages(spark):
    pages = [(1, "u\r\nv", None), (2, None, ""), (3, "http://é", "x\r\n\r\ny"), (4, "u", "x\r\n\r\ny"), (4, "u", "x\r\n\r\ny"), (None, "u", "z"), (5, "u", LONG)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.read_archives(warc.write_archives(warc.with_first(df), archive_bytes=64)).collect()
    assert len(out) == len(pages) and not any(r["problem"] for r in out)
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in out if r["record_type"] == "response"}
    assert texts["<urn:page:3>"] == "x\r\n\r\ny" and texts["<urn:page:5>"] == LONG and texts["<urn:page:1>"] == "" and len(texts) == 4
    assert warc.read_archives(warc.write_archives(warc.with_first(df.limit(0)))).count() == 0


def test_broken_archives_are_told():
    whole = warc.archive([warc.record(k, "u", b"body %d" % k, warc.digest(b"body %d" % k), None) for k in range(3)])
    assert [warc.parse(f)["payload"] for f in warc.frames(whole)] == [b"body 0", b"body 1", b"body 2"]
    with pytest.raises(warc.BadRecord):
        list(warc.frames(whole[:-3]))
    one = warc.record(1, "u", b"body", warc.digest(b"body"), None)
    for bad in (one[:-1], one.replace(b"body", b"bodx"), one.replace(b"WARC/1.1", b"WARK"), one.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)


# 9 ---------------------------------------------------------------------------------


def test_quality_query(spark, documents):
    got = rows_of(queries.op9_quality_rules(spark, SF), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality(t) for i, t in pairs(documents)}


def test_quality_on_odd_texts(spark, odd):
    ratios = quality_rules.log_ratios(odd, odd.where("doc_id > 5"))
    for row in quality_rules.with_verdict(odd, ratios).collect():
        q = row["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == brute.quality(row["text"])
    assert set(quality_rules.log_ratios(odd, odd.limit(0))) == {0.0}
    assert quality_rules.with_verdict(empty(spark), quality_rules.log_ratios(empty(spark), odd)).count() == 0


# 10 --------------------------------------------------------------------------------


def test_decontamination_query(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows_of(queries.op10_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.decontamination(pairs(documents), items)


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_decontamination_on_odd_texts(spark, odd, block):
    items = [(1, "tie"), (2, None), (3, ""), (4, "lorem ipsum dolor lorem ipsum"), (4, "one two"), (5, "The SAME line the same"), (6, "É à"), (None, "x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for row in search_items(odd, table, 4, block).select("text", "found", n_hit().alias("n"), is_contaminated().alias("c")).collect():
        want = brute.decontamination([(0, row["text"])], [i for i in items if i[0] is not None], 4)[0]
        names = sorted(map(str, row["found"]["items"]))
        assert (row["found"]["n_words"], row["n"], len(names), brute.sha256(",".join(names)), row["c"]) == want
    assert search_items(odd, table.limit(0)).where(is_contaminated()).count() == 0
    assert search_items(empty(spark), table).count() == 0


def test_decontamination_by_texts_as_ids(spark):
    items = spark.createDataFrame([("q-1", "one two three"), ("q-10", "three"), ("Q", "none"), (None, "one")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero ONE two three", "x"), (2, None, "y")], "doc_id long, text string, found string")
    rows = {r["doc_id"]: (r["found"]["items"], r["found"]["n_words"]) for r in search_items(docs, items, 2, 1).collect()}
    assert rows == {1: (["q-1", "q-10"], 4), 2: ([], 0)}


def test_full_text_index_finds_every_place():
    dice = np.random.default_rng(2)
    runs = [dice.integers(1, 4, dice.integers(1, 40)) for _ in range(20)]
    row = np.concatenate([np.append(r, 0) for r in runs])
    starts = np.concatenate([[0], np.flatnonzero(row == 0)[:-1] + 1])
    index = FmIndex(row, starts, 3)
    for size in (1, 2, 4):
        phrases = dice.integers(1, 4, (15, size))
        low, high = index.search(phrases)
        for phrase, a, z in zip(phrases, low, high):
            want = [i for i in range(len(row) - size + 1) if (row[i : i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want
