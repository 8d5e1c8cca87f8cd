"""The commits of a symbol, with their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.functions.ids import author_date
from revtables.functions.text import body, title
from revtables.operators.symbols import changes_for_symbol
from revtables.schema import METRICS, SYMBOL


def with_commits(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Change rows with date, title and body of their commit."""
    about = commits.select(
        "commit_id",
        author_date(F.col("author_seconds"), F.col("author_offset")).alias("date"),
        title(F.col("message")).alias("title"),
        body(F.col("message")).alias("body"),
    )
    return changes.join(about, "commit_id").select(
        "commit_id", "seconds_since_epoch", *SYMBOL, "date", "title", "body", *METRICS
    )


def missing_commits(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits of change rows that are not in the commit table; a log over them is incomplete."""
    return changes.select("commit_id").distinct().join(commits, "commit_id", "left_anti")


def newest_first(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.desc("seconds_since_epoch"), "commit_id")


def oldest_first(changes: DataFrame) -> DataFrame:
    return changes.orderBy("seconds_since_epoch", "commit_id", *SYMBOL)


def symbol_log(changes: DataFrame, commits: DataFrame, symbol: dict) -> DataFrame:
    """Newest first."""
    return newest_first(with_commits(changes_for_symbol(changes, symbol), commits))
