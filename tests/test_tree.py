"""Trees with ignore files, and repositories named by prefixes."""

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from revtables.functions import ids
from revtables.plans.revisions import Repository, diff_revisions, repository_status
from revtables.sources import contents, objects, versions
from revtables.sources.tree import ignore_rule, list_tree, read_tree, read_tree_since


@pytest.mark.parametrize(
    "line,fits,others",
    [
        ("*.o", ["a.o", "x/y/b.o", ".o"], ["a.oo", "a.o/b"]),
        ("/a", ["a"], ["x/a", "a/b"]),
        ("a/b", ["a/b"], ["x/a/b", "a/x/b"]),
        ("**/a", ["a", "x/a", "x/y/a"], ["ba", "a/b"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "x/a/b"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("a?c", ["abc", "x/a.c"], ["a/c", "ac"]),
        ("[a-c]x", ["ax", "x/cx"], ["dx", "/x"]),
        ("[!a-c]x", ["dx"], ["ax", "/x"]),
        (r"\#x\ ", ["#x "], ["#x"]),
        ("\\!x", ["!x"], ["x"]),
        ("a.b+(c)", ["a.b+(c)"], ["axb+(c)"]),
        ("x   ", ["x"], ["x   "]),
        ("[ab", ["[ab"], ["a"]),
        ("a***b", ["ab", "axb"], ["a/b"]),
    ],
)
def test_ignore_rules(line, fits, others):
    _, _, regex = ignore_rule(line)
    assert [p for p in fits if not re.search(regex, p)] == [] and [p for p in others if re.search(regex, p)] == []


def test_lines_without_a_rule():
    assert [ignore_rule(x) for x in ("", "  ", "# x", "/", "!")] == [None] * 5
    assert ignore_rule("!a/")[:2] == (True, True) and ignore_rule("a\r\n")[:2] == (False, False)


def write(root, **files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_nested_rules(spark, tmp_path):
    write(tmp_path, **{
        ".gitignore": "*.log\nbuild/\n!keep.log\n/top\n", "a.log": "1", "keep.log": "2", "top": "3", "sub/top": "4", ".hidden/x": "5", "_odd/y z#.txt": "6",
        "build/in/x.txt": "7", "build/.gitignore": "!*\n", "sub/build": "8", "sub/.gitignore": "!*.log\nb*.log\n", "sub/a.log": "9", "sub/b.log": "10",
        "sub/.ignore": "!b1.log\n", "sub/b1.log": "11", ".git/config": "12", ".git/info/exclude": "z*\n!a.log\n", "z.txt": "13", "sub/deep/er/keep.log": "14",
        "sub/.git/config": "15",
    })
    want = [".gitignore", ".hidden/x", "_odd/y z#.txt", "keep.log", "sub/.gitignore", "sub/.ignore", "sub/a.log", "sub/b1.log", "sub/build", "sub/deep/er/keep.log", "sub/top"]
    assert paths(list_tree(spark, str(tmp_path))) == want
    assert paths(list_tree(spark, str(tmp_path), ["sub/", "!a.log", "# no"])) == sorted(["a.log", *(p for p in want if not p.startswith("sub/"))])
    read = {r.path: bytes(r.content).decode() for r in read_tree(spark, f"file://{tmp_path}").collect()}
    assert read["_odd/y z#.txt"] == "6" and read["sub/deep/er/keep.log"] == "14" and sorted(read) == want
    assert paths(list_tree(spark, str(tmp_path / "none"))) == []


def test_files_of_the_staged_time_are_not_read(spark, tmp_path):
    write(tmp_path, a="one", b="two", c="three")
    now = {r.path: r.mtime for r in list_tree(spark, str(tmp_path)).collect()}
    staged = spark.createDataFrame([("a", "known", now["a"]), ("b", "old", now["b"] - 1), ("c", "other", None)], "path string, oid string, mtime long")
    rows = {r.path: (r.oid, r.content) for r in read_tree_since(spark, str(tmp_path), staged).collect()}
    assert rows["a"] == ("known", None) and bytes(rows["b"][1]) == b"two" and bytes(rows["c"][1]) == b"three"


def oid(text):
    import hashlib

    return hashlib.sha1(b"blob %d\0" % len(text) + text.encode()).hexdigest()


@pytest.fixture
def repository(spark, tmp_path):
    write(tmp_path / "tree", **{"a.en": "x one\ny", "new.fr": "z", ".gitignore": "*.de\n.gitignore\n", "b.de": "out"})
    schema = "commit_id binary, path string, mode string, oid string"
    first, second = bytes.fromhex("ab12cd00"), bytes.fromhex("ab12ce00")
    trees = [(first, "a.en", "100644", oid("x one")), (second, "a.en", "100644", oid("x two")), (first, "gone.es", "100644", oid("w"))]
    blobs = spark.createDataFrame([(oid(t), bytearray(t.encode())) for t in ("x one", "x two", "w")], "oid string, content binary")
    commits = spark.createDataFrame([(first,), (second,), (b"\xff\xff\xff",)], "commit_id binary")
    index = spark.createDataFrame([("a.en", "100644", oid("x two"), None), ("run.en", "100755", oid("w"), None)], "path string, mode string, oid string, mtime long")
    return Repository(commits, spark.createDataFrame(trees, schema), blobs, index, read_tree(spark, str(tmp_path / "tree")))


def rows(df):
    return sorted((r.change, r.kind, r.qualifiers, r.file_path, r.novel_lhs, r.novel_rhs) for r in df.collect())


def test_diff_of_revisions(repository):
    lists = [fx.PROSE]
    gone = [("deleted", "file", "", "gone.es", 0, None), ("deleted", "line", "w", "gone.es", 1, None)]
    new = [("added", "file", "", "new.fr", None, 0), ("added", "line", "z", "new.fr", None, 1)]
    assert rows(diff_revisions(repository, lists, "ab12cd", "AB12CE")) == sorted(
        [("modified", "file", "", "a.en", 1, 1), ("modified", "line", "x", "a.en", 1, 1), *gone]
    )
    # the last line of a file counts as another one when a line follows it only by its end, not by its text
    from_commit = rows(diff_revisions(repository, lists, "ab12cd0"))
    assert [r for r in from_commit if r[3] != "a.en"] == sorted([*gone, *new]) and ("added", "line", "y", "a.en", None, 1) in from_commit
    from_index = rows(diff_revisions(repository, lists))
    assert [r for r in from_index if r[3] != "a.en"] == new and ("modified", "line", "x", "a.en", 1, 1) in from_index
    both = repository_status(repository, lists, "ab12cd").collect()
    staged = sorted(tuple(r)[:6] for r in both if r.stage == "staged")
    assert staged == rows(diff_revisions(repository, lists, "ab12cd", "ab12ce"))
    assert sorted(tuple(r)[:6] for r in both if r.stage == "unstaged") == from_index
    nothing = repository_status(Repository(repository.commits, repository.trees, repository.blobs, None, repository.files), lists).collect()
    assert {r.stage for r in nothing} == {"unstaged"} and {r.change for r in nothing} == {"added"}


def test_prefixes(repository):
    assert objects.find_object(repository.commits, "FFFF") == b"\xff\xff\xff"
    assert objects.find_object(repository.commits, "ab12c" + "d") == bytes.fromhex("ab12cd00")
    for bad in ("ab12c", "ab1", "zzzz", "0000", "", "ab12cd001"):
        with pytest.raises(objects.ObjectNotFound):
            objects.find_object(repository.commits, bad)
    with pytest.raises(ValueError):
        diff_revisions(repository, [fx.PROSE], None, "ab12cd")


def test_contents_are_looked_up_in_few_folders(spark, tmp_path):
    store = contents.Contents(spark, str(tmp_path / "c"))
    blobs = spark.range(300).select(F.col("id").cast("string").cast("binary").alias("content")).withColumn("oid", ids.blob_id(F.col("content")))
    store.add(blobs.where("content < '2'").select("oid", "content"))
    store.add(blobs.unionByName(blobs).select("oid", "content"))
    wanted = blobs.where("CAST(content AS STRING) IN ('7', '250')").select("oid")
    found = store.of(wanted)
    assert sorted(bytes(r.content) for r in found.collect()) == [b"250", b"7"] and {r.lines for r in found.collect()} == {1}
    buckets = {re.search("bucket=(x..)", f)[1] for f in found.inputFiles()}
    assert buckets == {"x" + r.oid[:2] for r in wanted.collect()} and len(found.inputFiles()) <= 4
    assert store.of(blobs.select("oid")).count() == 300 and store.of(blobs.limit(0).select("oid")).count() == 0
    for _ in range(8):
        store.add(blobs.select("oid", "content"))
    assert len(versions.newest(spark, store.path).parts) <= 8 and store.of(blobs.select("oid")).count() == 300
