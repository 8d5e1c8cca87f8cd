"""Tasks of an append, a replacement and a compaction follow the rows, not the planner's constant number."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables import session
from revtables.schema import CHANGE_COLUMNS
from revtables.sources import store

SETTING = "spark.sql.shuffle.partitions"


@pytest.fixture
def small_tasks(spark, monkeypatch):
    """100 rows a task, and partitions as planned: small ones stay apart."""
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.conf.get(SETTING)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def changes(spark, first: int, last: int):
    numbers = spark.range(first, last, 1, 2).withColumnRenamed("id", "commit_id")
    columns = {"seconds_since_epoch": F.col("commit_id") * 10, "kind": F.lit("f"), "file_path": F.lit("p"), "novel_lhs": F.lit(0).cast("long")}
    columns |= {"qualifiers": F.concat(F.lit("name "), F.col("commit_id")), "novel_rhs": F.col("commit_id"), "size_after": F.lit(1).cast("long")}
    return numbers.withColumns(columns).select(*CHANGE_COLUMNS)


def largest(folder: str) -> int:
    """Rows of the largest file, each of which is one task's."""
    return max(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{folder}/part-*/*.parquet"))


def numbers(spark, folder: str) -> list[int]:
    return sorted(r.commit_id for r in store.open_changes(spark, folder, T.LongType()).select("commit_id").collect())


def test_tasks_of_appends_follow_the_rows(spark, tmp_path, small_tasks):
    folder = f"{tmp_path}/changes"
    assert store.append_changes(changes(spark, 0, 2000), folder) == 2000
    assert store.append_changes(changes(spark, 1000, 3000), folder) == 1000
    assert numbers(spark, folder) == list(range(3000))
    assert largest(folder) < 400
    assert spark.conf.get(SETTING) == small_tasks


def test_tasks_of_key_checks_follow_the_rows(spark, tmp_path, small_tasks, monkeypatch):
    tasks = []
    for name in ("duplicate_keys", "missing_changes"):
        check = getattr(store, name)
        monkeypatch.setattr(store, name, lambda *a, check=check: tasks.append(int(spark.conf.get(SETTING))) or check(*a))
    folder = f"{tmp_path}/changes"
    store.append_changes(changes(spark, 0, 2000), folder)
    store.append_changes(changes(spark, 1000, 3000), folder)
    assert tasks == [20, 20, 30, 30]
    with pytest.raises(store.DuplicateChange):
        store.append_changes(changes(spark, 0, 2000).unionByName(changes(spark, 5, 6)), folder)
    assert spark.conf.get(SETTING) == small_tasks


def test_tasks_of_replacements_and_compactions_follow_the_rows(spark, tmp_path, small_tasks):
    folder, merged = f"{tmp_path}/changes", f"{tmp_path}/merged"
    store.append_changes(changes(spark, 0, 2000), folder)
    new = changes(spark, 0, 2000).withColumn("novel_rhs", F.lit(7).cast("long"))
    store.replace_changes(new, new.select("commit_id", "file_path"), folder)
    assert store.open_changes(spark, folder, T.LongType()).groupBy("novel_rhs").count().first()[:] == (7, 2000)
    assert largest(folder) < 400
    for k in range(8):  # the last one puts all together
        store.append_changes(changes(spark, 250 * k, 250 * k + 250), merged)
    assert numbers(spark, merged) == list(range(2000))
    assert largest(merged) < 400
    assert spark.conf.get(SETTING) == small_tasks


def test_few_rows_stay_with_the_planner(spark):
    before = spark.conf.get(SETTING)
    with session.tasks_by_rows(spark, session.TASK_ROWS):
        assert spark.conf.get(SETTING) == before
