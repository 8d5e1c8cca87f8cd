"""How often symbols change, for one symbol or for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.functions.text import percent
from revtables.operators.cochange import co_changes, top_companions, top_companions_of_all
from revtables.operators.positions import with_position
from revtables.operators.symbols import all_commits, changes_for_symbol
from revtables.schema import SYMBOL


def commit_positions(changes: DataFrame) -> DataFrame:
    """0-based place of every commit in time order; the id decides ties."""
    return with_position(all_commits(changes), [F.col("seconds_since_epoch"), F.col("commit_id")])


def first_changes(changes: DataFrame) -> DataFrame:
    """Earliest commit of each symbol."""
    first = F.min(F.struct("seconds_since_epoch", "commit_id"))
    return changes.groupBy(*SYMBOL).agg(first.alias("f")).select(*SYMBOL, "f.commit_id", "f.seconds_since_epoch")


def inspect_all(changes: DataFrame) -> DataFrame:
    """Commits of every symbol, their share of all commits and of those since its first one."""
    return _shares(changes, changes)


def _shares(changes: DataFrame, of: DataFrame) -> DataFrame:
    positions = commit_positions(changes)
    # Written already by the positioning, so this is a count of stored rows.
    total = positions.count()
    first = F.min(F.struct("seconds_since_epoch", "commit_id"))
    symbols = of.groupBy(*SYMBOL).agg(F.count("*").alias("commits"), first.alias("f"))
    return (
        symbols.withColumn("commit_id", F.col("f.commit_id"))
        .join(positions.select("commit_id", "position"), "commit_id")
        .select(
            *SYMBOL,
            "commits",
            (F.col("commits") / F.lit(total)).alias("share"),
            (F.col("commits") / (F.lit(total) - F.col("position"))).alias("share_since_introduction"),
        )
    )


def inspect(changes: DataFrame, symbol: dict) -> DataFrame:
    """The same for one symbol; no row when it has no commits."""
    return _shares(changes, changes_for_symbol(changes, symbol))


def companions(changes: DataFrame, symbol: dict) -> DataFrame:
    """The symbols that changed most often together with one symbol."""
    one = changes_for_symbol(changes, symbol).select(*SYMBOL).distinct()
    return top_companions(co_changes(changes, one))


def companions_of_all(changes: DataFrame) -> DataFrame:
    return top_companions_of_all(changes)


def inspect_text(shares: DataFrame) -> DataFrame:
    """One sentence per symbol."""
    line = F.format_string(
        "%s %s (%s): %d commits, %s of all, %s since its first one",
        "kind",
        "qualifiers",
        "file_path",
        "commits",
        percent(F.col("share")),
        percent(F.col("share_since_introduction")),
    )
    return shares.select(*SYMBOL, line.alias("line"))


def companion_text(top: DataFrame) -> DataFrame:
    """One line per companion, with the share of the symbol's commits that it is in."""
    line = F.format_string("%s of its commits: %s %s (%s)", percent(F.col("ratio")), "other_kind", "other_qualifiers", "other_file_path")
    return top.select(*SYMBOL, "rank", line.alias("line"))
