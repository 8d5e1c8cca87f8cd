import random

import pytest
from pyspark.sql import functions as F

from revtables.functions.ids import blob_id
from revtables.operators.builtin_rules import default_rule_lists
from revtables.operators.snapshots import file_changes, snapshot_diff
from revtables.plans.diff import diff_snapshots, status
from revtables.plans.history import build_changes
from revtables.plans.merge import selective_merge
from revtables.plans.reports import NO_CHANGES, change_json, report_lines, status_lines
from revtables.plans.log import symbol_log
from revtables.plans import reports

LISTS = [r for r in default_rule_lists() if r.name in ("rust", "toml")]


class Repo:
    """Commits of small trees: {path: text} or {path: (mode, text)}."""

    def __init__(self, spark, *trees, times=None):
        entries, texts = [], set()
        for n, tree in enumerate(trees, 1):
            for path, value in tree.items():
                mode, text = value if isinstance(value, tuple) else ("100644", value)
                texts.add(text)
                entries.append((n, path, mode, text))
        rows = [(t, bytearray(t.encode())) for t in sorted(texts)] or [("", bytearray())]
        named = spark.createDataFrame(rows, "text string, content binary").withColumn("oid", blob_id(F.col("content"))).cache()
        flat = spark.createDataFrame(entries, "commit_id long, path string, mode string, text string")
        self.trees = flat.join(named, "text").select("commit_id", "path", "mode", "oid").cache()
        self.blobs = named.select("oid", "content")
        log = [
            (n, [n - 1] if n > 1 else [], (times or {}).get(n, n * 100), 3600, f"title {n}\n\nbody {n}")
            for n in range(1, len(trees) + 1)
        ]
        self.commits = spark.createDataFrame(
            log, "commit_id long, parent_ids array<long>, author_seconds long, author_offset int, message string"
        )
        self.head = F.lit(len(trees))

    def snapshot(self, n):
        none = F.lit(None).cast("long")
        return self.trees.where(F.col("commit_id") == n).select("path", "mode", "oid", none.alias("mtime"))

    def build(self, **kwargs):
        return build_changes(self.commits, self.trees, self.blobs, LISTS, self.head, **kwargs)

    def diff(self, a, b, **kwargs):
        return diff_snapshots(self.snapshot(a), self.snapshot(b), self.blobs, LISTS, **kwargs)


def facts(df):
    return {
        (r.commit_id, r.kind, r.qualifiers, r.file_path): (r.novel_lhs, r.novel_rhs, r.size_after) for r in df.collect()
    }


def diffs(df):
    return {(r.change, r.kind, r.qualifiers, r.file_path, r.novel_lhs, r.novel_rhs) for r in df.collect()}


ONE = "fn a() {\n    1\n}\n\nfn b() {\n    2\n}\n"
TWO = "fn a() {\n    1\n}\n\nfn b() {\n    3\n    4\n}\n\nfn c() {}\n"


@pytest.fixture(scope="module")
def repo(spark):
    return Repo(
        spark,
        {"x.rs": ONE, "notes.txt": "one\ntwo"},
        {"x.rs": TWO, "notes.txt": "one\ntwo\nthree"},
        {"y.rs": TWO, "run.rs": ("100755", ONE)},
    )


def test_history(repo):
    assert facts(repo.build()) == {
        (1, "file", "", "x.rs"): (0, 7, 7),
        (1, "fn", "a", "x.rs"): (0, 3, 3),
        (1, "fn", "b", "x.rs"): (0, 3, 3),
        (2, "file", "", "x.rs"): (1, 4, 10),
        (2, "fn", "b", "x.rs"): (1, 2, 4),
        (2, "fn", "c", "x.rs"): (0, 1, 1),
        (3, "file", "", "x.rs"): (10, 0, 0),
        (3, "fn", "a", "x.rs"): (3, 0, 0),
        (3, "fn", "b", "x.rs"): (4, 0, 0),
        (3, "fn", "c", "x.rs"): (1, 0, 0),
        (3, "file", "", "y.rs"): (0, 10, 10),
        (3, "fn", "a", "y.rs"): (0, 3, 3),
        (3, "fn", "b", "y.rs"): (0, 4, 4),
        (3, "fn", "c", "y.rs"): (0, 1, 1),
    }


def test_file_changes_see_modes_and_renames(repo):
    got = {(r.commit_id, r.path, r.change) for r in file_changes(repo.commits, repo.trees).collect()}
    assert got == {
        (1, "x.rs", "added"),
        (1, "notes.txt", "added"),
        (2, "x.rs", "modified"),
        (2, "notes.txt", "modified"),
        (3, "x.rs", "deleted"),
        (3, "notes.txt", "deleted"),
        (3, "y.rs", "added"),
    }


def test_lines_count_for_every_region_around_them(spark):
    repo = Repo(spark, {"x.rs": "impl A {\n  fn f() {\n    1\n  }\n}\n"}, {"x.rs": "impl A {\n  fn f() {\n    2\n  }\n}\n"})
    got = facts(repo.build())
    assert got[2, "impl", "A", "x.rs"] == (1, 1, 5)
    assert got[2, "fn", "A::f", "x.rs"] == (1, 1, 3)
    assert diffs(repo.diff(1, 2)) == {
        ("modified", "file", "", "x.rs", 1, 1),
        ("modified", "fn", "A::f", "x.rs", 1, 1),
    }
    assert ("modified", "impl", "A", "x.rs", 1, 1) in diffs(repo.diff(1, 2, include_children=True))


def test_same_bytes_moved_are_no_change(spark):
    repo = Repo(spark, {"x.rs": "fn a() {}\nfn b() {}\n"}, {"x.rs": "fn b() {}\nfn a() {}\n"})
    got = facts(repo.build())
    assert (2, "fn", "a", "x.rs") not in got and (2, "file", "", "x.rs") in got


def test_diff_of_names_that_collide(spark):
    before = "struct Foo {\n  a: u8,\n}\nimpl Foo {\n  fn x() {}\n  fn y() {}\n}\n"
    after = before.replace("a: u8", "b: u8")
    repo = Repo(spark, {"x.rs": before}, {"x.rs": after})
    assert ("modified", "struct", "Foo", "x.rs", 1, 1) in diffs(repo.diff(1, 2))
    # By name alone the larger impl stands for both, and it holds no changed line.
    assert diffs(repo.diff(1, 2, compat_key="qualifiers")) == {("modified", "file", "", "x.rs", 1, 1)}


def test_diff_of_files_without_rules(repo):
    got = diffs(repo.diff(1, 2))
    assert ("modified", "file", "", "notes.txt", 0, 1) in got
    assert ("deleted", "file", "", "notes.txt", 3, None) in diffs(repo.diff(2, 3))
    assert ("added", "file", "", "notes.txt", None, 3) in diffs(repo.diff(3, 2))


def test_reports(repo):
    changes = repo.diff(1, 2)
    assert [r.line for r in report_lines(changes).collect()] == [
        "~ notes.txt",
        "~ x.rs",
        "  ~ fn b",
        "  + fn c",
    ]
    assert '{"change":"added","kind":"fn","qualifiers":"c","file_path":"x.rs","novel_rhs":1}' in {
        r.json for r in change_json(changes).collect()
    }
    same = repo.snapshot(1)
    assert [r.line for r in status_lines(status(same, same, same, repo.blobs, LISTS)).collect()] == [NO_CHANGES]
    both = status(repo.snapshot(1), repo.snapshot(2), repo.snapshot(2), repo.blobs, LISTS)
    assert [r.line for r in status_lines(both).collect()][:2] == ["Staged:", "~ notes.txt"]


def test_equal_times_hide_a_change(spark, repo):
    timed = [repo.snapshot(n).withColumn("mtime", F.lit(5).cast("long")) for n in (1, 2)]
    assert snapshot_diff(*timed).count() == 0


def test_log(repo):
    log = symbol_log(repo.build(), repo.commits, {"kind": "fn", "qualifiers": "b", "file_path": "x.rs"})
    rows = log.collect()
    assert [(r.commit_id, r.date, r.title, r.body, r.size_after) for r in rows] == [
        (3, "01.01.1970", "title 3", "body 3", 0),
        (2, "01.01.1970", "title 2", "body 2", 4),
        (1, "01.01.1970", "title 1", "body 1", 3),
    ]
    assert reports.log_lines(log).first().line == "3 01.01.1970 title 3"


def random_repo(spark, seed, size=8):
    rng = random.Random(seed)
    trees, files = [], {}
    for _ in range(size):
        for _ in range(rng.randrange(1, 4)):
            path = rng.choice(["a.rs", "b.rs", "c.toml", "d.txt"])
            if rng.random() < 0.2:
                files.pop(path, None)
            else:
                names = rng.sample("pqrstu", rng.randrange(1, 5))
                body = [f"fn {n}() {{\n  {rng.randrange(3)}\n}}\n" for n in names]
                files[path] = "".join(body) if path != "c.toml" else "".join(f"{n} = {rng.randrange(3)}\n" for n in names)
        trees.append(dict(files))
    return Repo(spark, *trees)


def test_incremental_build_equals_full_build(spark):
    repo = random_repo(spark, 11, size=6)
    full = repo.build().cache()
    want = facts(full)
    for low, high in ((3, 4), (1, 6)):
        stored = full.where(F.col("commit_id").between(low, high))
        rest = repo.build(existing=stored).cache()
        assert {**facts(stored), **facts(rest)} == want
        assert not set(facts(stored)) & set(facts(rest))
    assert facts(repo.build(existing=full, rebuild=True)) == want


def test_merge_takes_only_the_chosen_symbols(spark):
    before = "fn a() { 1 }\nfn b() { 2 }\nfn c() { 3 }\nstruct S { x: u8 }\n"
    after = "// new\nfn a() { 10 + 10 }\nfn b() { 20 }\nfn c() { 3 }\nstruct S { y: u16 }\nfn d() {}\n"
    repo = Repo(spark, {"x.rs": before, "y.rs": before}, {"x.rs": after, "y.rs": after})

    def merged(**chosen):
        got = selective_merge(repo.snapshot(1), repo.snapshot(2), repo.blobs, LISTS, **chosen)
        return {r.path: bytes(r.merged).decode() for r in got.collect()}

    functions = "fn a() { 10 + 10 }\nfn b() { 20 }\nfn c() { 3 }\nstruct S { x: u8 }\n"
    assert merged(kind="fn") == {"x.rs": functions, "y.rs": functions}
    assert merged(qualifiers="S", file_path="y.rs") == {"y.rs": before.replace("x: u8", "y: u16")}
    with pytest.raises(ValueError):
        merged(file_path="x.rs")
