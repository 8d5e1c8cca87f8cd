"""Point-in-interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a level are this many times as wide as those of the level below.
GROWTH = 4


def _bin(value: Column, level: Column, width: int) -> Column:
    return F.floor(value / (F.lit(width) * F.pow(F.lit(GROWTH), level)))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    point: str,
    start: str,
    end: str,
    width: int = 64,
) -> DataFrame:
    """Inner join of points with the intervals that hold them (both ends inclusive).

    An equi-join on ``on`` alone would compare every point of a file with every interval
    of it. Here bins are nested: an interval goes to the level whose bins are at least as
    wide as it is, where it touches one or two of them, however long it is; a point goes to
    its bin of every level that has intervals. So a giant file is spread over its bins, a
    point meets only intervals that begin near it on their own scale, and a pair shares
    exactly one bin. ``intervals`` are looked at twice, first for their levels.

    Both sides are shuffled: written matches take few bytes on disk, so the planner would
    take millions of rows for a small table and send them through the driver.
    """
    length = (F.col(end) - F.col(start) + 1).cast("double")
    # a level more or less through rounding is no fault, as the bins follow from it
    level = F.greatest(F.ceil(F.log(float(GROWTH), length / width)), F.lit(0)).cast("int")
    leveled = intervals.where(F.col(end) >= F.col(start)).withColumn("_level", level)
    levels = sorted(r["_level"] for r in leveled.select("_level").distinct().collect())
    binned_points = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    binned_points = binned_points.withColumn("_bin", _bin(F.col(point), F.col("_level"), width))
    bins = F.sequence(_bin(F.col(start), F.col("_level"), width), _bin(F.col(end), F.col("_level"), width))
    return (
        binned_points.hint("merge").join(leveled.withColumn("_bin", F.explode(bins)), [*on, "_level", "_bin"])
        .where(F.col(point).between(F.col(start), F.col(end)))
        .drop("_level", "_bin")
    )
