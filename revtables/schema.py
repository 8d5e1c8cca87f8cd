"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.session import cut_lineage

SYMBOL = ["kind", "qualifiers", "file_path"]
CHANGE_KEY = ["commit_id", *SYMBOL]
METRICS = ["novel_lhs", "novel_rhs", "size_after"]
CHANGE_COLUMNS = ["commit_id", "seconds_since_epoch", *SYMBOL, *METRICS]

RANGE = T.StructType(
    [
        T.StructField(name, T.LongType(), False)
        for name in ("start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col")
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("commit_id", T.BinaryType(), False),
        T.StructField("parent_ids", T.ArrayType(T.BinaryType(), False), False),
        T.StructField("author_seconds", T.LongType(), False),
        T.StructField("author_offset", T.IntegerType(), False),
        T.StructField("message", T.StringType(), False),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("mode", T.StringType(), False),
        T.StructField("oid", T.StringType(), True),
        T.StructField("mtime", T.LongType(), True),
    ]
)

BLOBS = T.StructType(
    [
        T.StructField("oid", T.StringType(), False),
        T.StructField("content", T.BinaryType(), False),
    ]
)


def change_schema(commit_id: T.DataType | None = None) -> T.StructType:
    """The change fact table; the id type follows the commits it is built from."""
    return T.StructType(
        [
            T.StructField("commit_id", commit_id or T.BinaryType(), False),
            T.StructField("seconds_since_epoch", T.LongType(), False),
            T.StructField("kind", T.StringType(), False),
            T.StructField("qualifiers", T.StringType(), False),
            T.StructField("file_path", T.StringType(), False),
            T.StructField("novel_lhs", T.LongType(), False),
            T.StructField("novel_rhs", T.LongType(), False),
            T.StructField("size_after", T.LongType(), False),
        ]
    )


def key_hash() -> Column:
    """A hash of the key: 8 bytes to shuffle instead of names. Equal keys have equal ones, not the other way round."""
    return F.xxhash64(*CHANGE_KEY).alias("_hash")


def duplicate_keys(changes: DataFrame) -> DataFrame:
    """Keys that occur more than once; empty when the primary key holds.

    Only rows whose hash occurs more than once are compared by name.
    """
    twice = changes.select(key_hash()).groupBy("_hash").agg(F.count("*").alias("rows")).where("rows > 1")
    suspects = changes.withColumn("_hash", key_hash()).join(cut_lineage(twice.select("_hash")), "_hash", "left_semi")
    return suspects.groupBy(*CHANGE_KEY).agg(F.count("*").alias("rows")).where("rows > 1")
