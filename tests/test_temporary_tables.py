"""Tables and shuffles that are made on the way to a history, and go again."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from checks import fixtures as fx
from revtables.functions.ids import blob_id
from revtables.functions.text import byte_text, line_keys
from revtables.operators.regions import tokens
from revtables.plans import texts
from revtables.plans.history import build_changes, update_changes
from revtables.session import checkpoint_dir, cut_lineage, in_parts, passing_cuts
from revtables.sources.store import open_changes

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark):
    return Path(checkpoint_dir(spark).removeprefix("file:"))


@pytest.fixture
def repo(spark):
    """Three commits over files with shared, changed and removed contents."""
    versions = [
        [("a.en", "x one\ny two\nz three\n"), ("b.en", "x one\n"), ("c.fr", "p q\nr s")],
        [("a.en", "x one\ny 2\nz three\nw four"), ("b.en", "x one\n"), ("d.fr", "p q\nr s")],
        [("a.en", "x one\ny two\nz three\n"), ("c.fr", "p q\nr t"), ("d.fr", "")],
    ]
    rows = [(n, path, "100644", text) for n, tree in enumerate(versions, 1) for path, text in tree]
    entries = spark.createDataFrame(rows, "commit_id long, path string, mode string, text string").withColumn("oid", blob_id(F.col("text")))
    log = spark.createDataFrame(
        [(n, [n - 1] * (n > 1), 100 * n, 0, "") for n in (1, 2, 3)],
        "commit_id long, parent_ids array<long>, author_seconds long, author_offset int, message string",
    )
    blobs = entries.select("oid", F.col("text").cast("binary").alias("content")).distinct()
    return log, entries.drop("text"), blobs


def test_a_build_leaves_no_contents_behind(spark, repo):
    cut_lineage(spark.range(1))
    before = set(folder(spark).iterdir())
    rows = build_changes(*repo, [fx.PROSE], F.lit(3))
    left = [p for p in set(folder(spark).iterdir()) - before if p.name.startswith("cut-")]
    columns = [spark.read.parquet(str(p)).columns for p in left]
    assert columns and not [c for c in columns if {"content", "line_keys", "start_byte"} & set(c)]
    assert rows.count() == len(rows.collect()) > 0


def test_parts_give_the_same_history(spark, repo, monkeypatch):
    whole = sorted(build_changes(*repo, [fx.PROSE], F.lit(3)).collect())
    monkeypatch.setattr(texts, "PART_BYTES", 1)
    assert sorted(build_changes(*repo, [fx.PROSE], F.lit(3)).collect()) == whole


def test_cuts_go_when_the_step_is_left(spark):
    own = spark.conf.get(SETTING)
    with passing_cuts(spark) as keep:
        with passing_cuts(spark) as keep_on:
            one, two, three = cut_lineage(spark.range(3)), keep_on(spark.range(4)), keep(spark.range(5))
            assert (one.count(), spark.conf.get(SETTING)) == (3, "true")
        gone, kept = one.inputFiles()[0], two.inputFiles()[0]
        assert not Path(gone.removeprefix("file:")).exists() and two.count() == 4
    assert not Path(kept.removeprefix("file:")).exists() and three.count() == 5
    assert spark.conf.get(SETTING) == own


def test_parts_have_all_rows_once(spark):
    table = cut_lineage(spark.range(100).repartition(5))
    parts = in_parts(table, 1)
    assert len(parts) == 5 and sorted(r.id for p in parts for r in p.collect()) == list(range(100))
    assert len(in_parts(table, 1 << 30)) == 1
    assert in_parts(spark.createDataFrame([], "id long"), 1)[0].count() == 0


def test_keys_are_equal_where_lines_are(spark):
    lines = [b"", b"a", b"a" * 15, b"a" * 16, b"a" * 17, b"a" * 15 + b"b", b"\xff" * 15, b"\xff" * 16, b"\xc3\xbf", "ÿ".encode("latin-1")]
    content = b"\n".join([*lines, *lines, b"end"])
    found = spark.createDataFrame([(bytearray(content),)], "content binary").select(line_keys(byte_text(F.col("content"))).alias("k")).first().k
    keys = [bytes(k) for k in found]
    assert len(keys) == 2 * len(lines) + 1 and keys[: len(lines)] == keys[len(lines) : -1]
    assert len(set(keys)) == len(lines) + 1 and all(len(k) <= 16 for k in keys)


def test_a_text_is_split_behind_the_shuffle_only(spark, capsys):
    files = spark.createDataFrame([("a", "prose", bytearray(b"x one\n")), ("b", "prose", None), ("c", "prose", bytearray())], "oid string, list string, content binary")
    split = tokens(files.repartition("oid"), [fx.PROSE])
    assert sorted((r.oid, r.pos) for r in split.collect()) == [("a", 0), ("a", 1), ("c", 0)]
    split.explain()
    below = capsys.readouterr().out.rpartition("Exchange")[2]
    assert "split(" not in below


def test_an_update_leaves_its_table_only(spark, repo, tmp_path):
    log, trees, blobs = repo
    cut_lineage(spark.range(1))
    before = set(folder(spark).iterdir())
    for head in (2, 3):
        update_changes(str(tmp_path / "changes"), log, trees, blobs, [fx.PROSE], F.lit(head))
    assert set(folder(spark).iterdir()) == before
    stored = open_changes(spark, str(tmp_path / "changes"), LongType())
    assert sorted(stored.collect()) == sorted(build_changes(log, trees, blobs, [fx.PROSE], F.lit(3)).collect())


def test_changed_rules_leave_the_table_only(spark, repo, tmp_path):
    log, trees, blobs = repo
    cut_lineage(spark.range(1))
    before = set(folder(spark).iterdir())
    for head, lists in ((2, [fx.PROSE_NORTH, fx.OTHER_SOUTH]), (3, [fx.PROSE])):
        update_changes(str(tmp_path / "changes"), log, trees, blobs, lists, F.lit(head))
    assert set(folder(spark).iterdir()) == before
    stored = open_changes(spark, str(tmp_path / "changes"), LongType())
    assert sorted(stored.collect()) == sorted(build_changes(log, trees, blobs, [fx.PROSE], F.lit(3)).collect())
