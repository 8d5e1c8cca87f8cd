"""Keep the change table up to date with a stream of landed revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from revtables.operators.rules import RuleList
from revtables.operators.snapshots import disturbed_revisions, paired_changes
from revtables.plans.history import changes_of
from revtables.session import cut_lineage
from revtables.sources import versions
from revtables.sources.store import append_changes, replace_changes


def append_stream(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    to_changes: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Turn every batch into change rows and append those that are not stored.

    Runs over what is there and stops. A batch that is run again after a failure
    finds its rows stored, so nothing is written twice. Nothing is dropped for being
    late: a back-dated commit is a row like any other, and positions in time are
    computed when the table is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_changes(to_changes(batch), table)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: The log is laid out by so many ranges of paths, so that a batch reads the files of its paths only.
BUCKETS = 64


class ConflictingRevision(ValueError):
    """One revision of a path came with two contents or from two commits."""


def log_schema(commit_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("path", T.StringType()),
            T.StructField("revision", T.LongType()),
            T.StructField("oid", T.StringType()),
            T.StructField("commit_id", commit_id),
            T.StructField("seconds_since_epoch", T.LongType()),
            T.StructField("batch", T.LongType()),
        ]
    )


def _laid_out(log: DataFrame) -> DataFrame:
    order = ["bucket", "path", "revision"]
    return log.repartitionByRange(*order).sortWithinPartitions(*order)


def _log_of(spark: SparkSession, state: str, rows: DataFrame, before_batch: int) -> DataFrame:
    """What earlier batches logged of the paths in ``rows``."""
    buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    log = versions.read(spark, state, log_schema(rows.schema["commit_id"].dataType))
    log = log.where(F.col("bucket").isin(buckets) & (F.col("batch") < before_batch))
    return log.join(rows.select("path").distinct(), "path", "left_semi")


def _check(rows: DataFrame, log: DataFrame) -> None:
    told = rows.unionByName(log.select(*rows.columns)).groupBy("path", "revision").agg(
        F.count_distinct(F.struct("commit_id", "oid")).alias("n")
    )
    twice = told.where("n > 1").first()
    if twice is not None:
        raise ConflictingRevision(f"revision {twice['revision']} of {twice['path']} came with different contents or commits")


def revision_stream(
    stream: DataFrame,
    blobs: Callable[[], DataFrame],
    lists: list[RuleList],
    table: str,
    state: str,
    checkpoint: str,
) -> StreamingQuery:
    """History build over a stream of (commit_id, seconds_since_epoch, path, revision, oid).

    Revisions may land in any order, also long after later ones of their path. Hashes of
    all revisions are kept as a log under ``state``, by path. A batch looks up the
    neighbours of its revisions there: each is compared with its predecessor, and each
    successor anew with the revision that now stands before it. The rows that are stored
    of both are replaced in one version of the table, so readers never see a successor
    counted against the wrong predecessor beside a late revision.

    A batch that is run again replaces its rows by the same ones, and its revisions are
    logged once. A revision that lands again unchanged is ignored; one that lands with
    another content or commit ends the stream with :class:`ConflictingRevision`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")
        columns = ["path", F.col("revision").cast("long").alias("revision"), "oid", "commit_id", "seconds_since_epoch"]
        rows = cut_lineage(batch.select(bucket, *columns).distinct())
        if rows.isEmpty():
            return
        log = cut_lineage(_log_of(spark, state, rows, batch_id).drop("batch"))
        _check(rows, log)
        fresh = rows.join(log, ["path", "revision"], "left_anti")
        disturbed = cut_lineage(disturbed_revisions(log, fresh.select(*log.columns)))
        times = disturbed.select("commit_id", "seconds_since_epoch").distinct()
        changes = changes_of(paired_changes(disturbed), times, blobs(), lists)
        replace_changes(changes, disturbed.select("commit_id", F.col("path").alias("file_path")), table)
        if versions.newest(spark, state).notes.get("batch", -1) < batch_id:
            logged = fresh.withColumn("batch", F.lit(batch_id).cast("long")).select(*log_schema(rows.schema["commit_id"].dataType).names)
            versions.append(logged, state, _laid_out, {"batch": batch_id})

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
