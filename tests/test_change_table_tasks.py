"""The change table of the orders is dealt out by its rows, not by the bytes of a shuffle."""

from datetime import datetime

from pyspark.sql import functions as F

from checks import fixtures as fx


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    orders = [(k, datetime(1995, 1, 1 + k % 28)) for k in range(400)]
    parts = [(p, f"TYPE {p % 5}", f"name {p}", f"Brand#{p % 7}", p % 50) for p in range(60)]
    lines = [(k, (k * 7 + n * 11) % 60, float(n + 1), 0.05) for k in range(400) for n in range(10)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fx, "TASK_ROWS", 100, raising=False)
    symbols = fx.changes_star(spark, str(tmp_path)).where("kind <> 'file'")
    assert symbols.agg(F.count("*"), F.sum("novel_rhs"), F.sum("novel_lhs")).first()[:] == (4000, 400 * 55, 4000 * 5)
    held = symbols.groupBy(F.spark_partition_id()).count().agg(F.count("*").alias("tasks"), F.max("count").alias("most")).first()
    assert held.tasks > 20 and held.most < 400
