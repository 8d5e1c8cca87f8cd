"""Differences of file tables: two snapshots, a commit and its parent, a revision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtables.functions.paths import is_regular_file
from revtables.operators.chain import first_parents
from revtables.operators.positions import with_previous

ADDED, DELETED, MODIFIED = "added", "deleted", "modified"


def _change(before: Column, after: Column, differs: Column) -> Column:
    return (
        F.when(before.isNull(), ADDED).when(after.isNull(), DELETED).when(differs, MODIFIED)
    )


def entries_differ() -> Column:
    """Compare two entries cheaply: equal times mean no change, then hashes decide.

    When neither decides, the entry counts as modified and the line diff has the
    last word.
    """
    same_time = F.coalesce(F.col("before_mtime") == F.col("after_mtime"), F.lit(False))
    same_hash = F.coalesce(F.col("before_oid") == F.col("after_oid"), F.lit(False))
    return ~(same_time | same_hash)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, before_oid, after_oid) of the regular files that differ.

    Contents stay out of the join; only hashes and times travel.
    """

    def side(snapshot: DataFrame, name: str) -> DataFrame:
        return snapshot.where(is_regular_file(F.col("mode"))).select(
            "path",
            F.lit(True).alias(f"_{name}"),
            F.col("oid").alias(f"{name}_oid"),
            F.col("mtime").alias(f"{name}_mtime"),
        )

    joined = side(before, "before").join(side(after, "after"), "path", "full_outer")
    change = _change(F.col("_before"), F.col("_after"), entries_differ())
    return (
        joined.withColumn("change", change)
        .where("change is not null")
        .select("path", "change", "before_oid", "after_oid")
    )


def file_changes(commits: DataFrame, trees: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(commit_id, path, change, before_oid, after_oid) of every commit against its first parent.

    ``only`` (commit_id) restricts the result before any tree is read; parents are
    still looked up in all of ``commits``.

    The parent's tree is re-keyed by child id and joined on (commit, path), so even
    one giant tree is spread by path. Renames are a deletion plus an addition; the
    mode test of a modification looks at the new side only.
    """
    wanted = commits.select("commit_id") if only is None else only.select("commit_id")
    after = trees.join(wanted, "commit_id", "left_semi").select(
        "commit_id", "path", F.col("mode").alias("after_mode"), F.col("oid").alias("after_oid")
    )
    children = first_parents(commits).where("parent_id is not null").join(wanted, "commit_id", "left_semi")
    before = trees.select(
        F.col("commit_id").alias("parent_id"), "path", F.col("mode").alias("before_mode"), F.col("oid").alias("before_oid")
    ).join(children, "parent_id").drop("parent_id")
    change = _change(
        F.col("before_mode"),
        F.col("after_mode"),
        (F.col("before_oid") != F.col("after_oid")) | (F.col("before_mode") != F.col("after_mode")),
    )
    return (
        after.join(before, ["commit_id", "path"], "full_outer")
        .withColumn("change", change)
        .where("change is not null")
        .where(is_regular_file(F.coalesce("after_mode", "before_mode")))
        .select("commit_id", "path", "change", "before_oid", "after_oid")
    )


def revision_changes(log: DataFrame) -> DataFrame:
    """The same rows from a per-path revision log (commit_id, path, revision, oid).

    A NULL oid in the log is a deletion. Only hashes are placed and looked back at,
    never contents.
    """
    return paired_changes(with_previous(log, ["path"], ["revision"], ["oid"]))


def paired_changes(paired: DataFrame) -> DataFrame:
    """Changes of revisions that have the content before them as previous_oid."""
    before, after = F.col("previous_oid"), F.col("oid")
    return (
        paired.withColumn("change", _change(before, after, before != after))
        .where("change is not null and (previous_oid is not null or oid is not null)")
        .select("commit_id", "path", "change", before.alias("before_oid"), after.alias("after_oid"))
    )


def disturbed_revisions(log: DataFrame, landed: DataFrame) -> DataFrame:
    """Revisions whose predecessor is not what it was: the ``landed`` ones and the successors of those.

    Both have the columns of ``log`` (path, revision, oid and others); the result has them
    and previous_oid. Revisions may land in any order, in front of stored ones too.
    """
    rows = log.withColumn("_landed", F.lit(False)).unionByName(landed.withColumn("_landed", F.lit(True)))
    paired = with_previous(rows, ["path"], ["revision"], ["oid", "_landed"])
    touched = F.col("_landed") | F.coalesce("previous__landed", F.lit(False))
    return paired.where(touched).drop("_landed", "previous__landed")
