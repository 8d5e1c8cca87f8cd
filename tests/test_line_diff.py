import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revtables.operators import line_diff as ld
from revtables.operators.alignment import align


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def lcs_length(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b):
            previous, best[j + 1] = best[j + 1], previous + 1 if x == y else max(best[j], best[j + 1])
    return best[-1]


def check_alignment(a, b, kept):
    kept = sorted(kept)
    assert all(a[i] == b[j] for i, j in kept)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:]))


LINES = st.lists(st.sampled_from("abcdefgh"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_small_lists_are_aligned_best(a, b):
    kept = align(a, b)
    check_alignment(a, b, kept)
    assert len(kept) == lcs_length(a, b)


@pytest.mark.parametrize("lines", [850, 950, 1200, 20_000])
def test_repeated_lines_are_aligned_best_at_every_size(lines):
    rng = random.Random(lines)
    a = [rng.choice(["{", "}", "", "  end"]) for _ in range(lines)]
    b = list(a)
    for _ in range(5):
        b.insert(rng.randrange(len(b)), rng.choice(["{", "}", "new"]))
    kept = align(a, b)
    check_alignment(a, b, kept)
    assert len(kept) == lines


def test_large_lists_with_moved_blocks():
    rng = random.Random(1)
    a = [f"line {n}" for n in range(30000)] + ["}"] * 3000
    b = a[10000:] + a[:10000]
    for n in rng.sample(range(len(b)), 500):
        b[n] = "changed"
    kept = align(a, b)
    check_alignment(a, b, kept)
    assert len(kept) > 20000


def test_novel_lines(spark):
    cases = [
        ("line1\nline2\nline3", "line1\nline2\nline3\nline4", [], [3]),
        ("line1\nline2\nline3\nline4", "line1\nline2\nline3", [3], []),
        ("a\nb\n", "a\nb", [], []),
        ("", "a\n", [], [0]),
        ("a", "", [0], []),
        ("", "", [], []),
        ("a\nb\nc\n", "a\nx\nc\n", [1], [1]),
        ("a\r\nb", "a\nb", [0], [0]),
        ("\n", "", [0], []),
        ("x\ny\nz", "z\nx\ny", [2], [0]),
        ("é\xff", "é\xfe", [0], [0]),
    ]
    pairs = spark.createDataFrame(
        [(n, bytearray(b.encode("latin-1")), bytearray(a.encode("latin-1"))) for n, (b, a, _, _) in enumerate(cases)],
        "id int, before binary, after binary",
    )
    got = {r.id: (r.novel_lhs, r.novel_rhs) for r in ld.line_diff(pairs).collect()}
    assert got == {n: (lhs, rhs) for n, (_, _, lhs, rhs) in enumerate(cases)}


def random_pairs(spark, count=60):
    rng = random.Random(7)
    data = []
    for n in range(count):
        before = [rng.choice(["a", "b", "", "}", "é", f"u{rng.randrange(30)}"]) for _ in range(rng.randrange(25))]
        after = [x for x in before if rng.random() > 0.2]
        for _ in range(rng.randrange(5)):
            after.insert(rng.randrange(len(after) + 1), rng.choice(["new", "}", "b"]))
        ends = rng.choice(["", "\n"]), rng.choice(["", "\n"])
        data.append((n, bytearray(("\n".join(before) + ends[0]).encode()), bytearray(("\n".join(after) + ends[1]).encode())))
    return spark.createDataFrame(data, "id int, before binary, after binary")


def test_edits_rebuild_the_after_content(spark):
    pairs = random_pairs(spark).cache()
    edits = ld.byte_edits(pairs, ld.line_diff(pairs), ["id"])
    rebuilt = {r.id: bytes(r.rebuilt) for r in ld.apply_edits(pairs, edits, ["id"]).collect()}
    assert rebuilt == {r.id: bytes(r.after) for r in pairs.collect()}


def test_shifted_starts_apply_one_after_the_other(spark):
    pairs = random_pairs(spark).cache()
    edits = ld.byte_edits(pairs, ld.line_diff(pairs), ["id"]).collect()
    for pair in pairs.collect():
        content, after = bytes(pair.before), bytes(pair.after)
        for e in sorted((e for e in edits if e.id == pair.id), key=lambda e: e.seq):
            start, size = e.shifted_start_byte, e.old_end_byte - e.start_byte
            content = content[:start] + after[e.new_start_byte : e.new_end_byte] + content[start + size :]
        assert content == after


def test_end_of_file_newline_is_an_edit(spark):
    pairs = spark.createDataFrame(
        [(0, bytearray(b"a\nb"), bytearray(b"a\nb\n")), (1, bytearray(b"a\n"), bytearray(b"a"))], "id int, before binary, after binary"
    )
    edits = ld.byte_edits(pairs, ld.line_diff(pairs), ["id"])
    assert rows(edits, "id", "edit", "start_byte", "old_end_byte", "new_start_byte", "new_end_byte") == [
        (0, "end of file", 3, 3, 3, 4),
        (1, "end of file", 1, 2, 1, 1),
    ]


def test_hunks(spark):
    pairs = spark.createDataFrame(
        [(0, bytearray(b"a\nb\nc\nd"), bytearray(b"x\na\nc\ny\nd\nz"))], "id int, before binary, after binary"
    )
    hunks = ld.hunks(ld.line_diff(pairs), ["id"])
    assert rows(hunks, "hunk", "before_start", "before_end", "after_start", "after_end") == [
        (0, 0, 0, 0, 1),
        (1, 1, 2, 2, 2),
        (2, 3, 3, 3, 4),
        (3, 4, 4, 5, 6),
    ]


def test_multiset_diff_matches_copies(spark):
    pairs = spark.createDataFrame([(0, bytearray(b"a\na\nb"), bytearray(b"b\na\nc"))], "id int, before binary, after binary")
    assert rows(ld.multiset_line_diff(pairs, ["id"]), "side", "row") == [("lhs", 1), ("rhs", 2)]


@pytest.mark.parametrize("text,starts", [("a\nbb\n", [(0, 0, 2), (1, 2, 5), (2, 5, 5)]), ("é", [(0, 0, 2)]), ("", [(0, 0, 0)])])
def test_line_starts(spark, text, starts):
    files = spark.createDataFrame([(0, bytearray(text.encode()))], "id int, content binary")
    assert rows(ld.line_starts(files, ["id"]), "row", "start_byte", "end_byte") == starts
