"""Contents of files by id, laid out so that a look-up of some ids opens few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.functions.text import byte_text, line_count, newline_count
from revtables.sources import versions

#: Ids are hexadecimal digests; contents lie in folders by so many first digits.
DIGITS = 2
CONTENT_SCHEMA = T.StructType(
    [
        T.StructField("oid", T.StringType()),
        T.StructField("newlines", T.LongType()),
        T.StructField("lines", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
_STORED = T.StructType([*CONTENT_SCHEMA.fields, T.StructField("bucket", T.StringType())])


def _bucket(oid: Column) -> Column:
    # a letter in front, or "00" would be read as a number
    return F.concat(F.lit("x"), F.substring(oid, 1, DIGITS))


def _laid_out(rows: DataFrame) -> DataFrame:
    # within a bucket by ranges of ids, so that a large one is several files
    return rows.select(*_STORED.names).repartitionByRange("bucket", "oid").sortWithinPartitions("bucket", "oid")


def sized(blobs: DataFrame, *more: str) -> DataFrame:
    """(oid, newlines, lines, content) of a table of contents (oid, content), and ``more`` of its columns."""
    text = byte_text(F.col("content"))
    return blobs.select("oid", newline_count(text).alias("newlines"), line_count(text).alias("lines"), "content", *more)


class Contents:
    """The contents stored at a path; each id once, with the sizes of its text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, blobs: DataFrame) -> None:
        """Store the contents of ``blobs`` (oid, content) whose ids are not stored yet."""
        rows = sized(blobs.dropDuplicates(["oid"])).withColumn("bucket", _bucket(F.col("oid")))
        new = rows.join(self._all("oid"), "oid", "left_anti")
        versions.append(new, self.path, _laid_out, partition_by="bucket")

    def _all(self, *columns: str) -> DataFrame:
        return versions.read(self.spark, self.path, _STORED, "bucket").select(*columns)

    def of(self, ids: DataFrame) -> DataFrame:
        """(oid, newlines, lines, content) of the stored ones of ``ids`` (oid).

        Only folders that can hold one of them are listed and read. The driver gets the
        first digits of the ids, at most 256 different ones.
        """
        wanted = [r[0] for r in ids.select(_bucket(F.col("oid"))).distinct().collect()]
        now = versions.newest(self.spark, self.path)
        paths = versions.subfolders(self.spark, self.path, now, {f"bucket={w}" for w in wanted})
        if not paths:
            return self.spark.createDataFrame([], CONTENT_SCHEMA)
        return self.spark.read.schema(CONTENT_SCHEMA).parquet(*paths).join(ids.select("oid").distinct(), "oid", "left_semi").select(*CONTENT_SCHEMA.names)
