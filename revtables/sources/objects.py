"""Tables of commits, trees and blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtables.functions.paths import is_regular_file

# Shorter prefixes would not narrow anything down.
SHORTEST_PREFIX = 4


class ObjectNotFound(ValueError):
    """No object, or more than one, has the given id prefix."""


def commit_entries(trees: DataFrame, commit: Column) -> DataFrame:
    """Regular files of one commit's tree."""
    return trees.where((F.col("commit_id") == commit) & is_regular_file(F.col("mode"))).select("path", "mode", "oid")


def staged_entries(index: DataFrame) -> DataFrame:
    return index.where(is_regular_file(F.col("mode")))


def contents(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Add the content of each entry."""
    return entries.join(blobs, "oid")


def prefix_range(prefix: str) -> tuple[bytes, bytes | None]:
    """The ids that begin with these hexadecimal digits: from the first, to before the second (None: no end)."""
    if len(prefix) < SHORTEST_PREFIX or set(prefix.lower()) - set("0123456789abcdef"):
        raise ObjectNotFound(f"a prefix has at least {SHORTEST_PREFIX} hexadecimal digits")

    def padded(number: int) -> bytes:
        digits = f"{number:0{len(prefix)}x}"
        return bytes.fromhex(digits + "0" * (len(digits) % 2))

    number = int(prefix, 16)
    return padded(number), None if number + 1 == 16 ** len(prefix) else padded(number + 1)


def find_object(ids: DataFrame, prefix: str):
    """The one id (column ``commit_id`` BINARY) whose hex form starts with ``prefix``.

    A range of ids, so files sorted by id are skipped by their statistics.
    """
    low, high = prefix_range(prefix)
    inside = F.col("commit_id") >= F.lit(low)
    if high is not None:
        inside = inside & (F.col("commit_id") < F.lit(high))
    found = ids.where(inside).select("commit_id").distinct().limit(2).collect()
    if len(found) != 1:
        raise ObjectNotFound(f"no object has the prefix {prefix}" if not found else f"the prefix {prefix} is ambiguous")
    return found[0].commit_id


def find_objects(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Resolve many prefixes: (prefix, matches, status, id), the id only when exactly one fits.

    ``ids`` has a hex column ``id``. The first four digits are the join key, the
    rest of the prefix is checked inside its bucket.
    """
    head = F.substring(F.lower("prefix"), 1, SHORTEST_PREFIX)
    asked = prefixes.select("prefix", head.alias("_head")).distinct()
    keyed = ids.select("id", F.substring("id", 1, SHORTEST_PREFIX).alias("_head"))
    hits = (
        asked.join(keyed, "_head")
        .where(F.col("id").startswith(F.lower("prefix")))
        .groupBy("prefix")
        .agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    )
    matches = F.coalesce("matches", F.lit(0))
    return (
        prefixes.select("prefix")
        .join(hits, "prefix", "left")
        .select(
            "prefix",
            matches.alias("matches"),
            F.when(F.length("prefix") < SHORTEST_PREFIX, "too short")
            .when(matches == 0, "none")
            .when(matches == 1, "ok")
            .otherwise("ambiguous")
            .alias("status"),
            F.when((matches == 1) & (F.length("prefix") >= SHORTEST_PREFIX), F.col("id")).alias("id"),
        )
    )
