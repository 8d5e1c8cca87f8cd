"""From changed lines to the regions that hold them, and from two sides to one change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.operators.interval_join import interval_join

REGION = ["kind", "full_qualifiers"]


def region_rows(regions: DataFrame, keys: list[str], region: list[str] = REGION) -> DataFrame:
    """One row per range: (keys, kind, full_qualifiers, byte_size, first_seq, start_row, end_row)."""
    columns = list(dict.fromkeys([*keys, *region, "byte_size", "first_seq"]))
    return regions.select(*columns, F.explode("ranges").alias("range")).select(*columns, "range.start_row", "range.end_row")


def lines_in_regions(lines: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """Novel lines with every range that holds them."""
    return interval_join(lines, ranges, on, "line", "start_row", "end_row")


def count_in_all(lines: DataFrame, ranges: DataFrame, on: list[str], region: list[str] = REGION) -> DataFrame:
    """Novel lines per region, a line counting for every region around it.

    Ranges of one region may overlap, so lines are counted distinct. ``region`` are the
    columns of ``ranges`` that tell the regions of a file apart.
    """
    held = lines_in_regions(lines, ranges, on)
    return held.groupBy(*on, *region).agg(F.count_distinct("line").alias("novel"))


def innermost(lines: DataFrame, ranges: DataFrame, on: list[str], region: list[str] = REGION) -> DataFrame:
    """The smallest region around each novel line, the earlier one on a tie."""
    held = lines_in_regions(lines, ranges, on)
    return (
        held.groupBy(*on, "line")
        .agg(F.min_by(F.struct(*region), F.struct("byte_size", "first_seq")).alias("region"))
        .select(*on, "line", "region.*")
    )


def count_in_innermost(lines: DataFrame, ranges: DataFrame, on: list[str], region: list[str] = REGION) -> DataFrame:
    return innermost(lines, ranges, on, region).groupBy(*on, *region).agg(F.count("*").alias("novel"))


def _sides(regions: DataFrame, keys: list[str], match: list[str], columns: list[str]) -> DataFrame:
    """Full outer match of the ``lhs`` and ``rhs`` rows of ``regions`` on (keys, match)."""

    def side(name: str) -> DataFrame:
        return regions.where(F.col("side") == name).select(
            *keys, *match, F.lit(True).alias(f"{name}_here"), *[F.col(c).alias(f"{name}_{c}") for c in columns]
        )

    return side("lhs").join(side("rhs"), [*keys, *match], "full_outer")


def match_for_history(regions: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Before and after regions of modified files by kind and full name, equal bytes dropped.

    ``regions`` has (keys, side, kind, full_qualifiers, qualifiers, checksum,
    line_size, first_seq), ``counts`` has (keys, side, first_seq, novel); only what is left
    of the regions meets it. Returns (keys, kind, qualifiers, novel_lhs, novel_rhs,
    size_after).
    """
    both = _sides(regions, keys, REGION, ["qualifiers", "checksum", "line_size", "first_seq"])
    is_both = F.col("lhs_here") & F.col("rhs_here")
    changed = both.where(~F.coalesce(is_both & (F.col("lhs_checksum") == F.col("rhs_checksum")), F.lit(False)))
    for side in ("lhs", "rhs"):
        novel = counts.where(F.col("side") == side).select(
            *keys, F.col("first_seq").alias(f"{side}_first_seq"), F.col("novel").alias(f"{side}_novel")
        )
        changed = changed.drop(f"{side}_checksum").join(novel, [*keys, f"{side}_first_seq"], "left")
    return changed.select(
        *keys,
        "kind",
        F.coalesce("rhs_qualifiers", "lhs_qualifiers").alias("qualifiers"),
        F.when(F.col("rhs_here").isNull(), F.col("lhs_line_size"))
        .when(F.col("lhs_here").isNull(), F.lit(0))
        .otherwise(F.coalesce("lhs_novel", F.lit(0)))
        .cast("long")
        .alias("novel_lhs"),
        F.when(F.col("lhs_here").isNull(), F.col("rhs_line_size"))
        .when(F.col("rhs_here").isNull(), F.lit(0))
        .otherwise(F.coalesce("rhs_novel", F.lit(0)))
        .cast("long")
        .alias("novel_rhs"),
        F.coalesce("rhs_line_size", F.lit(0)).cast("long").alias("size_after"),
    )


def match_for_diff(regions: DataFrame, keys: list[str], compat_key: str | None = None) -> DataFrame:
    """Before and after regions of modified files that hold at least one novel line.

    Regions are matched by kind and full name. With ``compat_key="qualifiers"`` they
    are matched by full name alone and the largest region of a name stands for it.
    Returns (keys, kind, qualifiers, change, novel_lhs, novel_rhs).
    """
    columns = ["kind", "qualifiers", "novel"]
    if compat_key == "qualifiers":
        largest = F.max_by(F.struct(*columns), F.struct("byte_size", "first_seq")).alias("r")
        one = regions.groupBy(*keys, "side", "full_qualifiers").agg(largest)
        both = _sides(one.select(*keys, "side", "full_qualifiers", "r.*"), keys, ["full_qualifiers"], columns)
    else:
        both = _sides(regions.withColumn("_kind", F.col("kind")), keys, ["_kind", "full_qualifiers"], columns)
    lhs, rhs = F.coalesce("lhs_novel", F.lit(0)), F.coalesce("rhs_novel", F.lit(0))
    return both.where((lhs > 0) | (rhs > 0)).select(
        *keys,
        F.coalesce("lhs_kind", "rhs_kind").alias("kind"),
        F.coalesce("lhs_qualifiers", "rhs_qualifiers").alias("qualifiers"),
        F.when(F.col("lhs_here").isNull(), "added")
        .when(F.col("rhs_here").isNull(), "deleted")
        .otherwise("modified")
        .alias("change"),
        F.when(F.col("lhs_here"), lhs).cast("long").alias("novel_lhs"),
        F.when(F.col("rhs_here"), rhs).cast("long").alias("novel_rhs"),
    )
