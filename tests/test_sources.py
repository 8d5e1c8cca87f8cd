import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from checks import fixtures as fx
from revtables.functions import ids, paths, text
from revtables.sources import files as files_source
from revtables.sources import objects, versions
from revtables.sources.files import read_files
from revtables.sources.store import open_changes
from revtables.streaming.history_stream import revision_stream


def test_blob_id_is_the_known_one(spark):
    row = spark.range(1).select(ids.blob_id(F.lit("hello\n")).alias("oid")).first()
    assert row.oid == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_scalars(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("v")).first().v

    assert [value(text.strip_line_end(F.lit(t))) for t in ("a\n", "a\r\n", "a\r", "a\n\n", "a")] == ["a", "a", "a\r", "a\n", "a"]
    assert value(text.title(F.lit("t\nu\n\nb\n\nc"))) == "t\nu" and value(text.body(F.lit("t\nu\n\nb\n\nc"))) == "b\n\nc"
    assert value(text.body(F.lit("t"))) is None
    assert [value(text.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert [value(paths.extension(F.lit(p))) for p in ("a/b.c", "a.b/c", ".c", "x.tar.gz", "x.")] == ["c", "", "", "gz", ""]
    assert value(ids.author_date(F.lit(0), F.lit(-3600))) == "31.12.1969"
    assert value(ids.author_date(F.lit(12345156123), F.lit(7200))) == "15.03.2361"
    assert value(text.percent(F.lit(1 / 3))) == "33.33%" and value(text.percent(F.lit(0.15625))) == "15.62%"


def test_files_of_a_folder(spark, tmp_path):
    names = ["a.rs", "sub/b c.rs", "sub/.hidden", ".git/config", "sub/.git/x", "_x/y.rs", "target/out.rs", "sub/target/deep.rs", "plus+ü.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    everything = read_files(spark, str(tmp_path))
    assert {r.path for r in everything.select("path").collect()} == {
        "a.rs", "sub/b c.rs", "sub/.hidden", "_x/y.rs", "target/out.rs", "sub/target/deep.rs", "plus+ü.txt",
    }
    secret = everything.where("path = 'sub/.hidden'").first()
    assert bytes(secret.content) == b"sub/.hidden" and secret.oid == everything.where(
        "path = 'sub/.hidden'").select(ids.blob_id(F.lit("sub/.hidden")).alias("o")).first().o
    assert everything.count() == 7
    row = everything.where("path = 'a.rs'").first()
    assert bytes(row.content) == b"a.rs" and row.mode == "100644" and row.mtime > 0

    def left(*ignore):
        return {r.path for r in read_files(spark, str(tmp_path), list(ignore)).select("path").collect()}

    assert left("target/") == {"a.rs", "sub/b c.rs", "sub/.hidden", "_x/y.rs", "plus+ü.txt"}
    assert left("/target", "*.txt", "_x") == {"a.rs", "sub/b c.rs", "sub/.hidden", "sub/target/deep.rs"}
    assert left("*", "!sub/**/*.rs") == {"sub/b c.rs", "sub/target/deep.rs"}
    assert {r.path for r in read_files(spark, str(tmp_path / "a.rs")).collect()} == {"a.rs"}
    assert {r.path for r in read_files(spark, str(tmp_path), name_glob="*.txt").collect()} == {"plus+ü.txt"}


def test_objects_by_prefix(spark):
    table = spark.createDataFrame([(bytearray.fromhex(h),) for h in ("abcd01", "abcd02", "ffff00")], "commit_id binary")
    assert bytes(objects.find_object(table, "FFFF")) == bytes.fromhex("ffff00")
    for prefix in ("abcd", "0000"):
        with pytest.raises(objects.ObjectNotFound):
            objects.find_object(table, prefix)
    asked = spark.createDataFrame([("abcd",), ("abcd01",), ("abcd01",), ("FFFF",), ("0000",), ("abc",)], "prefix string")
    got = objects.find_objects(table.select(ids.hex_id(F.col("commit_id")).alias("id")), asked)
    assert {r.prefix: (r.status, r.id) for r in got.collect()} == {
        "abcd": ("ambiguous", None),
        "abcd01": ("ok", "abcd01"),
        "FFFF": ("ok", "ffff00"),
        "0000": ("none", None),
        "abc": ("too short", None),
    }


def test_stream_in_many_batches_and_again(spark, tmp_path, monkeypatch):
    """One file per revision step, then a late restart with nothing new."""
    monkeypatch.setattr(versions, "PARTS_OF_A_SIZE", 2)
    log = [(1, 10, "a.en", 1, "x one\ny"), (2, 20, "a.en", 2, "x two\ny"), (3, 30, "b.en", 1, "z"), (4, 40, "a.en", 3, None), (5, 50, "b.en", 2, "z!")]
    texts = {t for *_, t in log if t is not None}
    blobs = (
        spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "content binary")
        .withColumn("oid", ids.blob_id(F.col("content")))
        .cache()
    )
    columns = "commit_id long, seconds_since_epoch long, path string, revision long, text string"

    def land(rows, name):
        df = spark.createDataFrame(rows, columns)
        oid = F.when(F.col("text").isNotNull(), ids.blob_id(F.col("text")))
        df.withColumn("oid", oid).drop("text").write.parquet(str(tmp_path / "landed" / name))

    def run():
        schema = "commit_id long, seconds_since_epoch long, path string, revision long, oid string"
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "landed" / "*"))
        revision_stream(
            stream, lambda: blobs, [fx.PROSE], str(tmp_path / "changes"), str(tmp_path / "state"), str(tmp_path / "progress")
        ).awaitTermination()

    land(log[:1], "1")
    run()
    land(log[1:3], "2")
    run()
    land(log[3:4], "3")
    run()
    land(log[4:], "4")
    run()
    run()
    logged = versions.newest(spark, str(tmp_path / "state"))
    assert len(logged.parts) == 1 and logged.notes == {"batch": 3}
    rows = open_changes(spark, str(tmp_path / "changes"), LongType())
    got = {(r.commit_id, r.kind, r.qualifiers, r.file_path): (r.novel_lhs, r.novel_rhs, r.size_after) for r in rows.collect()}
    assert got == {
        (1, "line", "x", "a.en"): (0, 1, 1),
        (1, "line", "y", "a.en"): (0, 1, 1),
        (1, "file", "", "a.en"): (0, 1, 1),
        (2, "line", "x", "a.en"): (1, 1, 1),
        (2, "file", "", "a.en"): (1, 1, 1),
        (3, "line", "z", "b.en"): (0, 1, 1),
        (3, "file", "", "b.en"): (0, 0, 0),
        (4, "line", "x", "a.en"): (1, 0, 0),
        (4, "line", "y", "a.en"): (1, 0, 0),
        (4, "file", "", "a.en"): (1, 0, 0),
        (5, "line", "z", "b.en"): (1, 0, 0),
        (5, "line", "z!", "b.en"): (0, 1, 1),
        (5, "file", "", "b.en"): (1, 1, 0),
    }


def test_ids_without_contents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files_source, "PIECE_BYTES", 3)
    for name, data in {"a.rs": b"abc", "b c+%41.rs": b"abcd", "sub/_x/.hidden": b"\xff\x00\n" * 5, ".git/config": b"x", "out.log": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    root = str(tmp_path)
    ids = read_files(spark, root, ["*.log"], contents=False)
    assert ids.columns == ["path", "mode", "oid", "mtime"]
    want = read_files(spark, root, ["*.log"]).select(*ids.columns).collect()
    assert sorted(ids.collect()) == sorted(want) and len(want) == 3
    assert [r.oid for r in read_files(spark, f"{root}/a.rs", contents=False).collect()] == [r.oid for r in want if r.path == "a.rs"]
    assert read_files(spark, root, name_glob="*.none", contents=False).count() == 0


def test_the_id_of_a_file_that_no_row_can_hold(spark, tmp_path):
    size = 1 << 31
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(size)
    digest = hashlib.sha1(f"blob {size}\0".encode())
    for _ in range(size >> 24):
        digest.update(bytes(1 << 24))
    assert [(r.path, r.oid) for r in read_files(spark, str(tmp_path), contents=False).collect()] == [("large.bin", digest.hexdigest())]
