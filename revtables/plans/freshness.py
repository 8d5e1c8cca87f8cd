"""Is the change table up to date with a head commit?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freshness(changes: DataFrame, head: Column) -> DataFrame:
    """One row (latest_commit, status): up to date, outdated, no history or detached head.

    A NULL head means that no branch is checked out.
    """
    latest = changes.agg(F.max(F.struct("seconds_since_epoch", "commit_id")).alias("c"))
    head = head.alias("head")
    return latest.select(F.col("c.commit_id").alias("latest_commit"), head).select(
        "latest_commit",
        F.when(F.col("head").isNull(), "detached head")
        .when(F.col("latest_commit").isNull(), "no history")
        .when(F.col("latest_commit") == F.col("head"), "up to date")
        .otherwise("outdated")
        .alias("status"),
    )
