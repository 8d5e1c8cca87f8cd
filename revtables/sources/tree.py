"""Files of a directory tree, listed and read in tasks, without those that its ignore files name.

The tree is listed level by level: tasks list the folders of a level and read the ignore
files in them; every entry is joined with the rules of all folders around it, and only
folders that stay are gone into. No list of names comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtables.functions.ids import blob_id
from revtables.functions.paths import REGULAR_FILE_MODE
from revtables.session import cut_lineage
from revtables.sources.files import REPOSITORY_FOLDER

# Files with ignore rules, the stronger kind first, and the repository's own list.
IGNORE_FILES = (".ignore", ".gitignore")
OWN_IGNORE_FILE = f"{REPOSITORY_FOLDER}/info/exclude"
#: Contents are sent on in batches of about so many bytes.
BATCH_BYTES = 16 << 20

_ENTRIES = "folder string, path string, is_folder boolean, mtime long, size long, rank int, line_no int, line string"
_RULES = "folder string, rank int, line_no int, back boolean, folders_only boolean, regex string"


def ignore_rule(line: str) -> tuple[bool, bool, str] | None:
    """Of one line: whether it takes files back in, whether it is for folders only, and a regex of whole relative paths."""
    line = line.rstrip("\r\n")
    while line.endswith((" ", "\t")) and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    folders_only = line.endswith("/")
    line = line.rstrip("/") if folders_only else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "/**":
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            while line.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            inside = line[i + 1 : end]
            inverse = inside[0] in "!^"
            body = "".join("\\" + c if c in r"\[]^&~" else c for c in inside[inverse:])
            out, i = out + f"(?!/)[{'^' if inverse else ''}{body}]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + ("\\" + line[i] if line[i] in r"\.^$+*?{}[]()|" else line[i]), i + 1
    return back, folders_only, ("(?s)^" if anchored else "(?s)^(?:.*/)?") + out + "$"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    uri = root if "://" in root else f"file://{root.removeprefix('file:')}"
    system, base = fs.FileSystem.from_uri(uri)
    return system, base.rstrip("/")


def _lines(system: fs.FileSystem, path: str) -> list[str]:
    with system.open_input_stream(path) as source:
        return source.read().decode("utf-8", "replace").split("\n")


def _listed(folders: DataFrame, root: str) -> DataFrame:
    """The entries of each folder, and the lines of its ignore files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(root)
        names = [f.split()[0] for f in _ENTRIES.split(", ")]
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                prefix = f"{folder}/" if folder else ""
                for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                    if info.base_name == REPOSITORY_FOLDER and info.type == fs.FileType.Directory:
                        continue
                    is_folder = info.type == fs.FileType.Directory
                    rows.append((folder, prefix + info.base_name, is_folder, None if is_folder else int(info.mtime_ns // 10**9), info.size, None, None, None))
                    if info.base_name in IGNORE_FILES and not is_folder:
                        rank = len(IGNORE_FILES) - IGNORE_FILES.index(info.base_name)
                        rows += [(folder, None, False, None, None, rank, n, line) for n, line in enumerate(_lines(system, info.path))]
                if not folder and system.get_file_info(f"{base}/{OWN_IGNORE_FILE}").type == fs.FileType.File:
                    rows += [(folder, None, False, None, None, 0, n, line) for n, line in enumerate(_lines(system, f"{base}/{OWN_IGNORE_FILE}"))]
                if rows:
                    yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)}).astype(
                        {"is_folder": bool, "mtime": "Int64", "size": "Int64", "rank": "Int32", "line_no": "Int32"}
                    )

    return folders.repartition("path").mapInPandas(run, _ENTRIES)


def _rules(entries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(r.folder, r.rank, r.line_no, *rule) for r in batch.itertuples() if (rule := ignore_rule(r.line)) is not None]
            yield pd.DataFrame(found, columns=[f.split()[0] for f in _RULES.split(", ")])

    return entries.where("line IS NOT NULL").select("folder", "rank", "line_no", "line").mapInPandas(run, _RULES)


def kept_entries(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries (path, is_folder, ..) that the rules of the folders around them do not leave out.

    Of the rules that fit, the strongest kind decides, of its rules the deepest folder, and of
    its file the last line.
    """
    parts = F.split("path", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts) - 1))
    inside = entries.select("path", "is_folder", parts.alias("_parts"), depth.alias("_depth")).select(
        "path", "is_folder", "_depth",
        F.array_join(F.slice("_parts", 1, F.col("_depth")), "/").alias("folder"),
        F.array_join(F.slice("_parts", F.col("_depth") + 1, F.size("_parts")), "/").alias("_relative"),
    )
    fits = F.rlike("_relative", F.col("regex")) & (F.col("is_folder") | ~F.col("folders_only"))
    verdict = F.max_by("back", F.struct("rank", "_depth", "line_no"))
    out = inside.join(rules, "folder").where(fits).groupBy("path").agg(verdict.alias("_back")).where("NOT _back").select("path")
    return entries.join(out, "path", "left_anti")


def list_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, mode, mtime, size) of the files under ``root`` that no ignore file leaves out.

    Hidden names count like others; the repository's own folder is left out. ``ignore`` has
    rules for the root that are stronger than all files'. What lies in a folder that is left
    out stays out, whatever the rules below it say. A missing or empty folder has no files.
    """
    given = [("", len(IGNORE_FILES) + 1, n, *rule) for n, line in enumerate(ignore or []) if (rule := ignore_rule(line)) is not None]
    rules = spark.createDataFrame(given, _RULES)
    folders = spark.createDataFrame([("",)], "path string")
    found = spark.createDataFrame([], "path string, mtime long, size long")
    while True:
        entries = cut_lineage(_listed(folders, root))
        rules = cut_lineage(rules.unionByName(_rules(entries)))
        kept = cut_lineage(kept_entries(entries.where("path IS NOT NULL").select("path", "is_folder", "mtime", "size"), rules))
        found = found.unionByName(kept.where("NOT is_folder").select("path", "mtime", "size"))
        folders = kept.where("is_folder").select("path")
        if folders.isEmpty():
            return found.select("path", F.lit(REGULAR_FILE_MODE).alias("mode"), "mtime", "size")


def with_contents(entries: DataFrame, root: str) -> DataFrame:
    """Add oid and content of listed files; each is read in a task, and only these files are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(root)
        for batch in batches:
            held, size = [], 0
            for k, path in enumerate(batch["path"]):
                with system.open_input_stream(f"{base}/{path}") as source:
                    held.append((k, source.read()))
                size += len(held[-1][1])
                if size >= BATCH_BYTES or k + 1 == len(batch):
                    rows = batch.iloc[[n for n, _ in held]].assign(content=[c for _, c in held])
                    yield rows[["path", "mode", "mtime", "content"]]
                    held, size = [], 0

    read = entries.select("path", "mode", "mtime").repartition("path").mapInPandas(run, "path string, mode string, mtime long, content binary")
    return read.select("path", "mode", blob_id(F.col("content")).alias("oid"), "mtime", "content")


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, mode, oid, mtime, content) of the files under ``root`` that no ignore file leaves out."""
    return with_contents(list_tree(spark, root, ignore), root)


def read_tree_since(spark: SparkSession, root: str, staged: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """As ``read_tree``, but files with the time they are staged with are not read and have no content.

    ``staged`` has (path, oid, mtime). Their ids are the staged ones, as an equal time means an equal file.
    """
    listed = cut_lineage(list_tree(spark, root, ignore))
    same = listed.join(staged.where("mtime IS NOT NULL").select("path", "mtime", "oid"), ["path", "mtime"])
    other = listed.join(same.select("path"), "path", "left_anti")
    unread = same.select("path", "mode", "oid", "mtime", F.lit(None).cast("binary").alias("content"))
    return with_contents(other, root).unionByName(unread)
