"""Differences and status of what is named by id prefixes, staged, or read from a tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.operators.rules import RuleList
from revtables.plans.diff import diff_snapshots, status
from revtables.sources.contents import Contents
from revtables.sources.objects import commit_entries, find_object, staged_entries


@dataclass
class Side:
    """A snapshot (path, mode, oid, mtime), and its contents where they are not in the store."""

    snapshot: DataFrame
    contents: DataFrame | None = None


@dataclass
class Repository:
    """Tables of a repository: commits, trees, a store of contents, the staged entries and the files of a read tree.

    ``index`` has (path, mode, oid, mtime), ``files`` has content besides, as ``read_tree``
    gives it. Both may be missing.
    """

    commits: DataFrame
    trees: DataFrame
    blobs: DataFrame | Contents
    index: DataFrame | None = None
    files: DataFrame | None = None

    def commit(self, prefix: str) -> Side:
        """The tree of the one commit whose id begins with ``prefix``."""
        return self._commit(find_object(self.commits, prefix))

    def _commit(self, commit_id) -> Side:
        entries = commit_entries(self.trees, F.lit(commit_id))
        return Side(entries.withColumn("mtime", F.lit(None).cast("long")))

    def staged(self) -> Side:
        """What is staged; nothing, if there is no index."""
        return Side(self._empty() if self.index is None else staged_entries(self.index).select("path", "mode", "oid", "mtime"))

    def tree(self) -> Side:
        if self.files is None:
            raise ValueError("no files have been read")
        read = self.files.where("content IS NOT NULL").select("oid", "content")
        return Side(self.files.select("path", "mode", "oid", "mtime"), read)

    def _empty(self) -> DataFrame:
        none = F.lit(None).cast("long").alias("mtime")
        return self.trees.select("path", "mode", "oid", none).limit(0)

    def _blobs(self, *sides: Side) -> tuple[DataFrame | Contents, ...]:
        return (self.blobs, *(s.contents for s in sides if s.contents is not None))


def diff_revisions(
    repository: Repository,
    lists: list[RuleList],
    before: str | None = None,
    after: str | None = None,
    include_children: bool = False,
    compat_key: str | None = None,
) -> DataFrame:
    """Symbol changes between two commits, a commit and the read files, or what is staged and the read files.

    Commits are given by prefixes of their ids.
    """
    if before is None and after is not None:
        raise ValueError("a later commit needs an earlier one")
    old = repository.staged() if before is None else repository.commit(before)
    new = repository.tree() if after is None else repository.commit(after)
    return diff_snapshots(old.snapshot, new.snapshot, repository._blobs(old, new), lists, include_children, compat_key)


def repository_status(
    repository: Repository,
    lists: list[RuleList],
    head: str | None = None,
    include_children: bool = False,
    compat_key: str | None = None,
) -> DataFrame:
    """Staged changes against the commit ``head`` (none: nothing is committed), and changes of the read files against what is staged."""
    committed = Side(repository._empty()) if head is None else repository.commit(head)
    staged, tree = repository.staged(), repository.tree()
    return status(
        committed.snapshot, staged.snapshot, tree.snapshot, repository._blobs(committed, staged, tree), lists, include_children, compat_key
    )
