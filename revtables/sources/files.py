"""Files of a directory tree as a snapshot."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatch
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtables.functions.ids import BLOB_HEADER, blob_id
from revtables.functions.paths import REGULAR_FILE_MODE

# Fixed value: the folder that holds the repository itself.
REPOSITORY_FOLDER = ".git"
#: Bytes of a file that are held at a time where only its id is asked for.
PIECE_BYTES = 4 << 20


def glob_regex(pattern: str) -> str:
    """Regex of one ignore pattern: ``*``, ``?`` and ``**``; a slash inside anchors it to the root."""
    directory = pattern.endswith("/")
    body = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            char = body[i]
            out, i = out + ("\\" + char if char in r"\.^$+{}[]()|" else char), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if directory else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that fits decides; a leading ``!`` takes a file back in."""
    out = F.lit(False)
    for pattern in patterns:
        back = pattern.startswith("!")
        out = F.when(path.rlike(glob_regex(pattern.lstrip("!"))), not back).otherwise(out)
    return out


def _skipped_by_spark(name: str) -> bool:
    """File and folder names that Spark's file sources leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _uri(root: str) -> str:
    return root if "://" in root else f"file://{root.removeprefix('file:')}"


def _hidden_names(spark: SparkSession, root: str, name_glob: str | None) -> DataFrame | None:
    """(path, mtime) of the files Spark skips; they are listed here."""
    system, base = fs.FileSystem.from_uri(_uri(root))
    if system.get_file_info(base).type != fs.FileType.Directory:
        return None
    rows = []
    for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
        path = info.path.removeprefix(base).lstrip("/")
        parts = path.split("/")
        if info.type != fs.FileType.File or REPOSITORY_FOLDER in parts[:-1]:
            continue
        if any(map(_skipped_by_spark, parts)) and (name_glob is None or fnmatch(parts[-1], name_glob)):
            rows.append((path, int(info.mtime_ns // 10**9)))
    return spark.createDataFrame(rows, "path string, mtime long").repartition("path") if rows else None


def _with_contents(names: DataFrame, root: str) -> DataFrame:
    """(path, mtime, content) of listed files, read in tasks."""
    uri = _uri(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, mtime in zip(batch["path"], batch["mtime"]):
                with here.open_input_stream(f"{folder.rstrip('/')}/{path}") as source:
                    yield pd.DataFrame({"path": [path], "mtime": [mtime], "content": [source.read()]})

    return names.mapInPandas(read, "path string, mtime long, content binary")


def _with_ids(names: DataFrame, root: str) -> DataFrame:
    """(path, mtime, oid) of listed files, each read piece by piece in the task that has its name.

    ``names`` may have a full path ``at`` besides.
    """
    uri, header, piece_bytes = _uri(root), BLOB_HEADER, PIECE_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(uri)
        one_file = system.get_file_info(base).type == fs.FileType.File

        def oid(path: str, at: str | None) -> str:
            # a local path as Spark gives it may have characters that are decoded in ``path``
            if at is None or not at.startswith("/") or system.get_file_info(at).type != fs.FileType.File:
                at = base if one_file else f"{base.rstrip('/')}/{path}"
            size, done = system.get_file_info(at).size, 0
            digest = hashlib.sha1(f"{header}{size}\0".encode())
            with system.open_input_stream(at) as source:
                while piece := source.read(piece_bytes):
                    digest.update(piece)
                    done += len(piece)
            if done != size:
                raise OSError(f"{at} had {size} bytes and gave {done}")
            return digest.hexdigest()

        for batch in batches:
            yield batch.assign(oid=[oid(path, at) for path, at in zip(batch["path"], batch["at"])])[["path", "mtime", "oid"]]

    named = names if "at" in names.columns else names.withColumn("at", F.lit(None).cast("string"))
    return named.mapInPandas(run, "path string, mtime long, oid string")


def read_files(
    spark: SparkSession,
    root: str,
    ignore: list[str] | None = None,
    name_glob: str | None = None,
    hidden: bool = True,
    contents: bool = True,
) -> DataFrame:
    """(path, mode, oid, mtime, content) of all files under ``root``, or of one file.

    Paths are relative to ``root``; the repository's own folder is left out. Hidden
    names, which Spark's file sources skip, are read by a second scan. Without ``contents``
    there is no such column and no file is held whole, so files may have any size; with
    them a file is one value, of less than 2 GB.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    files = reader.load(root)
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    relative = F.when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2))).otherwise(
        F.substring_index(plain, "/", -1)
    )
    inside = F.concat(F.lit("/"), F.col("path"))

    def wanted(found: DataFrame) -> DataFrame:
        return found.where(~inside.contains(f"/{REPOSITORY_FOLDER}/")).where(~ignored(F.col("path"), ignore or []))

    at = F.regexp_replace("path", r"^file:/*", "/").alias("at")
    found = files.select(relative.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), "content", at)
    more = _hidden_names(spark, root, name_glob) if hidden else None
    if not contents:
        # The scan deals files out by their sizes, and reads none of them itself.
        ids = [_with_ids(wanted(names.drop("content")), root) for names in (found, more) if names is not None]
        return reduce(DataFrame.unionByName, ids).select("path", F.lit(REGULAR_FILE_MODE).alias("mode"), "oid", "mtime")
    if more is not None:
        found = found.drop("at").unionByName(_with_contents(more, root))
    return (
        wanted(found)
        .select(
            "path",
            F.lit(REGULAR_FILE_MODE).alias("mode"),
            blob_id(F.col("content")).alias("oid"),
            "mtime",
            "content",
        )
    )
