"""Global order without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtables.session import cut_lineage

# monotonically_increasing_id() keeps the partition number above this bit.
ROW_BITS = 33


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order of the whole table.

    A range sort spreads the rows, each row gets its place inside its partition,
    and the partition sizes (one row per partition) give the offsets. No key and
    no tie, however frequent, ends up whole in one task as long as ``order`` is
    unique.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per partition of the sort: bounded by the partition count.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND((1 << ROW_BITS) - 1))
        .drop("_place", "_part", "_offset")
    )


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "previous_"
) -> DataFrame:
    """``lag`` of ``columns`` over (partition by keys order by order), safe for hot keys.

    Rows are placed by (keys, order) once; the previous row is then the row at the
    position before, found by an equi-join on positions, which are spread evenly
    however many rows one key has.
    """
    placed = with_position(df, [F.col(c) for c in keys + order], "_position")
    earlier = placed.select(
        (F.col("_position") + 1).alias("_position"),
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.col(c).alias(prefix + c) for c in columns],
    )
    same_key = F.lit(True)
    for i, k in enumerate(keys):
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    joined = placed.join(earlier, "_position", "left")
    return joined.select(
        *df.columns, *[F.when(same_key, F.col(prefix + c)).alias(prefix + c) for c in columns]
    )
