"""Functions over the list of ranges of a region, and over qualifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_size(ranges: Column) -> Column:
    """Lines of all ranges; overlapping ranges count twice."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end_row"] - r["start_row"] + 1)


def byte_size(ranges: Column) -> Column:
    """Bytes of all ranges plus one per range."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end_byte"] - r["start_byte"] + 1)


def first_byte(ranges: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(ranges, lambda r: r["start_byte"])), F.lit(0).cast("long"))


def contains_line(ranges: Column, line: Column) -> Column:
    return F.exists(ranges, lambda r: line.between(r["start_row"], r["end_row"]))


def contains_point(ranges: Column, row: Column, column: Column) -> Column:
    point = F.struct(row.cast("long").alias("r"), column.cast("long").alias("c"))
    return F.exists(
        ranges,
        lambda r: point.between(
            F.struct(r["start_row"].alias("r"), r["start_col"].alias("c")),
            F.struct(r["end_row"].alias("r"), r["end_col"].alias("c")),
        ),
    )


def contains_range(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """Non-strict containment: equal ranges contain each other."""
    return (outer_start <= start) & (outer_end >= end)


def join_names(names: Column, separator: Column) -> Column:
    """Names joined with the separator of their rule list, which may be empty."""
    return F.call_function("array_join", names, separator)


def contains_value(captures: Column, value: Column) -> Column:
    """Capture filter ``contains``: some captured text equals the value."""
    return F.exists(captures, lambda text: text == value)


def lacks_value(captures: Column, value: Column) -> Column:
    """Capture filter ``not-contains``."""
    return ~contains_value(captures, value)


def checksum(content: Column, ranges: Column) -> Column:
    """Hash of the bytes of all ranges in order; only equality is ever used."""
    data = content.cast("binary")
    pieces = F.transform(
        ranges, lambda r: F.substring(data, r["start_byte"].cast("int") + 1, (r["end_byte"] - r["start_byte"]).cast("int"))
    )
    return F.sha2(F.aggregate(pieces, F.lit(b"").cast("binary"), lambda all_, piece: F.concat(all_, piece)), 256)
