"""Symbols of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.operators.regions import extract_regions
from revtables.operators.rules import RuleList, rule_list_of


def extract_symbols(files: DataFrame, lists: list[RuleList]) -> DataFrame:
    """Symbols of ``files`` (path, oid, content): (file_path, kind, qualifiers, ranges, sizes).

    A content that occurs under several paths is read once per rule list.
    """
    routed = files.withColumn("list", rule_list_of(F.col("path"), lists)).where("list is not null")
    once = routed.dropDuplicates(["oid", "list"]).select("oid", "list", "content")
    return symbols_of_paths(routed.select(F.col("path").alias("file_path"), "oid", "list"), once, lists)


def symbols_of_paths(paths: DataFrame, contents: DataFrame, lists: list[RuleList]) -> DataFrame:
    """The same for (file_path, oid, list) and contents (oid, list, content) kept apart."""
    regions = extract_regions(contents, lists)
    return paths.join(regions, ["oid", "list"]).select(
        "file_path",
        "kind",
        "qualifiers",
        "full_qualifiers",
        "ranges",
        "line_size",
        "byte_size",
        "first_seq",
    )
