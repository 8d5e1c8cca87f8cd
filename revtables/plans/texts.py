"""What the diff and history jobs both need to know about changed file contents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtables.operators.attribution import count_in_all, count_in_innermost, region_rows
from revtables.functions.text import byte_text, line_keys
from revtables.operators.line_diff import diff_of_lines, novel_lines
from revtables.operators.regions import extract_regions, with_checksums
from revtables.operators.rules import RuleList
from revtables.session import cut_lineage, in_parts, passing_cuts
from revtables.sources.contents import Contents, sized

PAIR = ["before_oid", "after_oid"]
LISTED_PAIR = [*PAIR, "list"]
#: Bytes of written contents whose regions are found at a time.
PART_BYTES = 128 << 20


def contents_of(ids: DataFrame, blobs: DataFrame | Contents) -> DataFrame:
    """Contents with sizes of the given ids (oid, lists) only; they are looked up after unchanged files are gone."""
    if isinstance(blobs, Contents):
        return blobs.of(ids).join(ids, "oid")
    return sized(blobs.select("oid", "content").join(ids, "oid"), "lists")


def changed_contents(changes: DataFrame, *blobs: DataFrame | Contents) -> DataFrame:
    """(oid, newlines, lines, line_keys, lists, content) of both sides of all changes.

    Each store is read once, here, and what it gives is written; sizes, diffs, regions and
    checksums all come from that. Sizes and the keys of the lines are columns of their own, so
    they cost no contents; ``lists`` are the rule lists of the changed files with the content.
    An id has one row, also where several stores have it.
    """
    ids = changes.select("list", F.explode(F.array(*PAIR)).alias("oid")).where("oid is not null")
    ids = ids.groupBy("oid").agg(F.collect_set("list").alias("lists"))
    found = reduce(DataFrame.unionByName, [contents_of(ids, b) for b in blobs]).dropDuplicates(["oid"])
    keys = line_keys(byte_text(F.col("content"))).alias("line_keys")
    return cut_lineage(found.select("oid", "newlines", "lines", keys, "lists", "content"), "zstd")


def diff_contents(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Line diff of distinct (before_oid, after_oid) pairs, once per pair of contents; only keys of lines are moved."""
    before = contents.select(F.col("oid").alias("before_oid"), F.col("line_keys").alias("before"))
    after = contents.select(F.col("oid").alias("after_oid"), F.col("line_keys").alias("after"))
    return diff_of_lines(pairs.join(before, "before_oid").join(after, "after_oid").select(*PAIR, "before", "after"))


@dataclass
class ChangedTexts:
    """Frames over the changed files of a job; ``changes`` has path, change, oids and list.

    ``contents`` has the contents of both sides, see ``changed_contents``.
    """

    changes: DataFrame
    contents: DataFrame
    lists: list[RuleList]

    def modified_pairs(self) -> DataFrame:
        """(pair, before_oid, after_oid, list) of the modified files that a list covers; to be written, as that fixes the numbers."""
        pairs = self.changes.where("change = 'modified' and list is not null").select(*LISTED_PAIR).distinct()
        return pairs.withColumn("pair", F.monotonically_increasing_id())

    def diffs(self) -> DataFrame:
        """Novel lines of every modified pair, whatever its list."""
        pairs = self.changes.where("change = 'modified'").select(*PAIR).distinct()
        return diff_contents(pairs, self.contents)

    def sizes(self) -> DataFrame:
        """(oid, newlines, lines); no contents are read for it."""
        return self.contents.select("oid", "newlines", "lines")

    def regions(self, checksums: bool = False, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Regions of every changed content that a list covers, once per list; written, by ``cut`` if given.

        All contents are worked off, some files of their table at a time, so that what is
        moved for it does not grow with the contents.
        """
        found = []
        for part in in_parts(self.contents, PART_BYTES):
            files = part.select("oid", F.explode("lists").alias("list"), "content")
            with passing_cuts(part.sparkSession) as keep:
                regions = extract_regions(files.repartition("oid"), self.lists).drop("own_qualifiers")
                if checksums:
                    regions = with_checksums(regions, files).withColumn("checksum", F.unhex("checksum"))
                found.append((cut or keep)(regions))
        return reduce(DataFrame.unionByName, found)

    def sided(self, pairs: DataFrame, regions: DataFrame) -> DataFrame:
        """Regions of both sides of numbered ``pairs``: (pair, side, region..)."""
        sided = pairs.select(
            "pair",
            "list",
            F.explode(
                F.array(
                    F.struct(F.lit("lhs").alias("side"), F.col("before_oid").alias("oid")),
                    F.struct(F.lit("rhs").alias("side"), F.col("after_oid").alias("oid")),
                )
            ).alias("s"),
        ).select("pair", "list", "s.*")
        return sided.join(regions, ["oid", "list"]).drop("oid", "list")

    def novel_counts(self, pairs: DataFrame, regions: DataFrame, diffs: DataFrame, all_regions: bool) -> DataFrame:
        """Novel lines of the regions of both sides that hold any: (pair, side, first_seq, novel), written.

        The first match of a region tells it from the others of its file in fewer bytes than its name.
        """
        on, region = ["pair", "side"], ["first_seq"]
        count = count_in_all if all_regions else count_in_innermost
        lines = novel_lines(diffs.join(pairs, PAIR), ["pair"])
        ranges = cut_lineage(region_rows(self.sided(pairs, regions), on, region))
        return cut_lineage(count(lines, ranges, on, region))


def file_row(*columns: Column) -> list[Column]:
    """Kind and qualifiers of the row that stands for a whole file."""
    return [F.lit("file").alias("kind"), F.lit("").alias("qualifiers"), *columns]
