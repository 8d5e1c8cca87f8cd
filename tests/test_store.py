import pytest

from revtables.operators.symbols import (
    SymbolNotResolved,
    all_commits,
    find_symbol,
    query_symbols,
    symbol_commits,
)
from revtables.plans.freshness import freshness
from revtables.schema import change_schema
from revtables.sources import store
from pyspark.sql import functions as F

MAIN = ("fn", "main", "main.rs")
OTHERS = [("struct", "Args", "main.rs"), ("fn", "log", "main.rs"), ("fn", "main", "other_main.rs"), ("test", "main", "other_test.rs")]


def changes(spark, rows):
    data = [(bytearray(c), s, *symbol, 10, 8, 22) for c, s, symbol in rows]
    return spark.createDataFrame(data, change_schema())


def test_round_trip_with_large_time(spark, tmp_path):
    path = str(tmp_path / "t")
    one = changes(spark, [(b"\x01\x02\x03\x04", 12345156123, MAIN)])
    assert store.append_changes(one, path) == 1
    assert store.open_changes(spark, path).collect() == one.collect()


def test_missing_table_is_empty(spark, tmp_path):
    empty = store.open_changes(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.schema == change_schema()
    assert store.latest_commit(empty).count() == 0


def test_create_table(spark):
    store.create_table(spark, "changes_for_test")
    store.create_table(spark, "changes_for_test")
    assert spark.table("changes_for_test").columns == change_schema().names
    spark.sql("DROP TABLE changes_for_test")


def test_append_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = changes(spark, [(b"a", 1, MAIN), (b"b", 2, MAIN)])
    store.append_changes(first, path)
    with pytest.raises(store.DuplicateChange):
        store.append_changes(changes(spark, [(b"c", 3, MAIN), (b"c", 3, MAIN)]), path)
    with pytest.raises(store.DuplicateChange):
        store.append_changes(changes(spark, [(b"c", 3, MAIN), (b"a", 1, MAIN)]), path, skip_stored=False)
    assert store.open_changes(spark, path).count() == 2
    assert store.append_changes(first.unionByName(changes(spark, [(b"c", 3, MAIN)])), path) == 1
    store.purge_changes(spark, path)
    assert store.open_changes(spark, path).count() == 0


def test_symbol_filters(spark):
    table = changes(spark, [(bytes([n]), n, s) for n, s in enumerate([MAIN, *OTHERS])]).cache()
    asked = [
        ({}, 5),
        ({"file_path": "main.rs"}, 3),
        ({"kind": "fn"}, 3),
        ({"file_path": "main.rs", "kind": "fn"}, 2),
        ({"qualifiers": "main"}, 3),
        ({"qualifiers": "main", "kind": "fn"}, 2),
        ({"qualifiers": "main", "kind": "fn", "file_path": "main.rs"}, 1),
    ]
    assert [query_symbols(table, **given).count() for given, _ in asked] == [n for _, n in asked]


def test_find_symbol_arguments(spark):
    table = changes(spark, [(bytes([n]), n, s) for n, s in enumerate([MAIN, *OTHERS])]).cache()
    assert tuple(find_symbol(table, kind="struct")) == OTHERS[0]
    bad = [
        {},
        {"row": 1, "column": 1},
        {"file_path": "main.rs", "row": 1},
        {"file_path": "main.rs", "row": 1, "column": 1, "kind": "fn"},
        {"kind": "fn"},
        {"kind": "none"},
    ]
    for given in bad:
        with pytest.raises(SymbolNotResolved):
            find_symbol(table, **given)


def test_ends_and_distinct_commits(spark):
    table = changes(spark, [(b"1", 10_000_000, MAIN), (b"2", 20_000_000, MAIN), (b"3", 8_000_000, MAIN), (b"3", 8_000_000, OTHERS[0])])
    assert store.latest_commit(table).first().seconds_since_epoch == 20_000_000
    assert store.earliest_commit(table).first().seconds_since_epoch == 8_000_000
    assert all_commits(table).count() == 3
    symbol = dict(zip(("kind", "qualifiers", "file_path"), OTHERS[0]))
    assert symbol_commits(table, symbol).count() == 1


def test_freshness(spark):
    table = changes(spark, [(b"1", 1, MAIN), (b"2", 2, MAIN)])
    head = F.lit(b"2").cast("binary")
    assert freshness(table, head).first().status == "up to date"
    assert freshness(table, F.lit(b"1").cast("binary")).first().status == "outdated"
    assert freshness(table, F.lit(None).cast("binary")).first().status == "detached head"
    assert freshness(table.limit(0), head).first().status == "no history"
