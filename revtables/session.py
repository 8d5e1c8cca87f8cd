"""Session helpers: a tuned local session and lineage cuts in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of a change table that one task sorts, groups or joins.
TASK_ROWS = 1_000_000

# What a cluster session should have too. Skewed joins are split at run time, and an
# Arrow batch is bounded by bytes, as one row may hold the lines of a large file.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "8", app: str = "revtables") -> SparkSession:
    """A session for one machine; a cluster brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold as many rows as in ``SETTINGS`` at most; a smaller bound stays.

    What a worker and its executor hold for a batch they keep for later ones, so batches of
    long texts add up over the workers of an executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(SETTINGS[name]):
        spark.conf.set(name, SETTINGS[name])


@contextmanager
def tasks_by_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let the planner shuffle into as many tasks as ``rows`` need, where its own number is smaller.

    Its number is a constant, so what a task holds grows with the table. Holds for what is run
    inside, and for the whole session meanwhile; small partitions are still put together at run time.
    """
    name = "spark.sql.shuffle.partitions"
    own, needed = spark.conf.get(name), -(-rows // TASK_ROWS)
    if needed <= int(own):
        yield
        return
    spark.conf.set(name, str(needed))
    try:
        yield
    finally:
        spark.conf.set(name, own)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let the files of a shuffle go as soon as what it was made for is written, not when the driver's memory is next tidied."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and work tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, because executors of a cluster do not see
    the driver's disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="revtables-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


#: Folders of the tables cut inside each ``passing_cuts`` that is open, the innermost last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are cut inside when it is left, so that a long job holds those of one step at a time.

    What is to be read later is cut by the function that this gives, or is written elsewhere.
    Files of shuffles inside go with the query they were made for.
    """
    around, mine = _PASSING.get(), []
    token = _PASSING.set((*around, mine))
    try:
        with _shuffles_dropped(spark):
            yield lambda df: _cut(df, around)
    finally:
        _PASSING.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in mine:
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def in_parts(table: DataFrame, size: int) -> list[DataFrame]:
    """A table that was cut, by groups of its files of about ``size`` bytes; a larger file is a group of its own."""
    spark = table.sparkSession
    parts: list[list[str]] = []
    held = 0
    for name in sorted(table.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        length = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if not parts or held + length > size:
            parts.append([])
            held = 0
        parts[-1].append(path.toString())
        held += length
    return [spark.read.schema(table.schema).parquet(*names) for names in parts] or [table]


def _cut(df: DataFrame, passing: tuple[list[str], ...], codec: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    if passing:
        passing[-1].append(path)
    with _shuffles_dropped(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    A lost executor then costs a re-read, not a re-run of everything before. Parquet
    rather than a row checkpoint, so that later steps read only the columns they need
    and the planner knows the real size when it decides whether to broadcast. ``codec`` is
    for tables of texts, which are large. Inside ``passing_cuts`` the table goes at its end.
    """
    return _cut(df, _PASSING.get(), codec)
