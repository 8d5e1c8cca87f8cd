"""Views of the driver's tables in the shape of the engine's own tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtables.functions.ids import blob_id
from revtables.functions.paths import REGULAR_FILE_MODE
from revtables.functions.text import split_lines
from revtables.operators.positions import with_previous
from revtables.operators.rules import Rule, RuleList
from revtables.session import checkpoint_dir, cut_lineage

# Languages of the documents; a document's path ends in its language.
LANGUAGES = ("en", "fr", "de", "es")
#: Order lines of a task of the change table; its symbols, files and sorts are held together.
TASK_ROWS = 250_000
PROSE = RuleList(
    name="prose",
    separator="::",
    file_types=LANGUAGES,
    rules=(Rule("line", "match", r"(?m:^(\S+)[^\n]*)"),),
)

# The same rules in two lists, and other rules for the second of them.
PROSE_NORTH = RuleList(name="north", separator="::", file_types=LANGUAGES[:2], rules=PROSE.rules)
PROSE_SOUTH = RuleList(name="south", separator="::", file_types=LANGUAGES[2:], rules=PROSE.rules)
OTHER_SOUTH = RuleList(
    name="south", separator="::", file_types=LANGUAGES[2:], rules=(Rule("second", "match", r"(?m:^\S+ (\S+)[^\n]*)"),)
)

TAGS = ("nav", "article", "div", "ul", "li", "h1", "p")
ALL_TAGS = "|".join([*TAGS, "a"])
HTML = RuleList(
    name="html",
    separator=" > ",
    file_types=("html",),
    mask=r"<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>",
    opener=rf"<(?:{ALL_TAGS})\b[^>]*>",
    closer=rf"</(?:{ALL_TAGS})\s*>",
    group=r"^</?([a-zA-Z0-9]+)",
    start="<",
    rules=(
        *[Rule(tag, "nested", rf"<({tag})\b[^>]*>") for tag in TAGS],
        Rule("link", "nested", r'<a\b[^>]*?href="([^"]*)"[^>]*>'),
    ),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Whole seconds of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def work_folder(spark: SparkSession) -> str:
    """A new folder for a table a query writes, in the shared checkpoint folder."""
    base = checkpoint_dir(spark).removeprefix("file:")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="table-", dir=base)
    import uuid

    return f"{base}/table-{uuid.uuid4()}"


def changes_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change table from orders: commit = order, symbol = part, file = brand."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", seconds("o_orderdate").alias("seconds_since_epoch"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_type").alias("kind"),
        F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("qualifiers"),
        F.col("p_brand").alias("file_path"),
        F.col("p_size").cast("long").alias("p_size"),
    )
    # As many tasks as the rows need: the planner's own number follows the bytes of the shuffle, which are far fewer
    # than what sorts and groups of names take. The parts come first, so that all groups of an order stay in its task.
    tasks = max(spark.sparkContext.defaultParallelism, -(-lineitem.count() // TASK_ROWS))
    named = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).repartition(tasks, "l_orderkey")
    base = (
        named.join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_orderkey").alias("commit_id"), "seconds_since_epoch", "kind", "qualifiers", "file_path")
        .agg(
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("novel_lhs"),
            F.sum(F.col("l_quantity").cast("long")).alias("novel_rhs"),
            F.max("p_size").alias("size_after"),
        )
    )
    files = base.groupBy("commit_id", "seconds_since_epoch", "file_path").agg(
        *[F.sum(c).alias(c) for c in ("novel_lhs", "novel_rhs", "size_after")]
    )
    files = files.withColumn("kind", F.lit("file")).withColumn("qualifiers", F.lit(""))
    return base.unionByName(files.select(*base.columns))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits without parents."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit_id"),
        seconds("o_orderdate").alias("author_seconds"),
        ((F.col("o_custkey") % 25 - 12) * 3600).cast("int").alias("author_offset"),
        F.concat_ws("\n\n", "o_orderpriority", "o_orderstatus").alias("message"),
    )


def commit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a chain by (date, key), each with the previous one as its parent."""
    linked = with_previous(commits(spark, sf_dir), [], ["author_seconds", "commit_id"], ["commit_id"])
    parents = F.array_compact(F.array("previous_commit_id"))
    return linked.withColumn("parent_ids", parents).drop("previous_commit_id")


def star_symbol(spark: SparkSession, sf_dir: str) -> dict:
    """The symbol of the part with the lowest key that was ever ordered."""
    parts = table(spark, sf_dir, "part")
    ordered = table(spark, sf_dir, "lineitem").agg(F.min("l_partkey").alias("p_partkey"))
    row = parts.join(ordered, "p_partkey").first()
    return {"kind": row.p_type, "qualifiers": f"{row.p_name}#{row.p_partkey}", "file_path": row.p_brand}


def document_versions(spark: SparkSession, sf_dir: str, keep: str, change: str) -> DataFrame:
    """(doc_id, path, mode, oid, content) of one version of the documents.

    Documents that meet ``change`` lose every fifth line from the fourth on and get
    a mark on every eleventh line from the seventh on.
    """
    lines = F.split("text", "\n", -1)
    marked = F.transform(lines, lambda x, i: F.when(i % 11 == 6, F.concat(x, F.lit(" *"))).otherwise(x))
    edited = F.array_join(F.filter(marked, lambda x, i: i % 5 != 3), "\n")
    text = F.when(F.expr(change), edited).otherwise(F.col("text"))
    content = text.cast("binary")
    return (
        table(spark, sf_dir, "documents")
        .where(keep)
        .select(
            "doc_id",
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
            F.lit(REGULAR_FILE_MODE).alias("mode"),
            content.alias("content"),
        )
        .withColumn("oid", blob_id(F.col("content")))
    )


BEFORE = ("doc_id % 10 <> 0", "false")
AFTER = ("doc_id % 10 <> 1", "doc_id % 7 = 0")
INDEX = ("doc_id % 13 <> 0", "doc_id % 13 = 5")


def snapshot(spark: SparkSession, sf_dir: str, version: tuple[str, str]) -> DataFrame:
    versions = document_versions(spark, sf_dir, *version)
    return versions.select("path", "mode", "oid", F.lit(None).cast("long").alias("mtime"))


def document_blobs(spark: SparkSession, sf_dir: str, *versions: tuple[str, str]) -> DataFrame:
    """Contents of all given versions, one row per id, written out as a table would be."""
    all_ = None
    for version in versions:
        one = document_versions(spark, sf_dir, *version).select("oid", "content")
        all_ = one if all_ is None else all_.unionByName(one)
    return cut_lineage(all_.groupBy("oid").agg(F.min("content").alias("content")), "zstd")


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, before, after) of the documents that differ between the two versions."""
    before = document_versions(spark, sf_dir, *BEFORE).select("doc_id", F.col("content").alias("before"), "oid")
    after = document_versions(spark, sf_dir, *AFTER).select(
        "doc_id", F.col("content").alias("after"), F.col("oid").alias("after_oid")
    )
    return before.join(after, "doc_id").where("oid <> after_oid").select("doc_id", "before", "after")


def document_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two commits: the first has the before version, the second the after version."""
    log = spark.createDataFrame(
        [(1, [], 1000, 0, "first"), (2, [1], 2000, 0, "second")],
        "commit_id long, parent_ids array<long>, author_seconds long, author_offset int, message string",
    )
    first = snapshot(spark, sf_dir, BEFORE).select(F.lit(1).cast("long").alias("commit_id"), "path", "mode", "oid")
    second = snapshot(spark, sf_dir, AFTER).select(F.lit(2).cast("long").alias("commit_id"), "path", "mode", "oid")
    return log, first.unionByName(second)


def with_binary_ids(log: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits whose ids are the SHA-1 of their numbers."""

    def digest(number):
        return F.unhex(F.sha1(number.cast("string").cast("binary")))

    log = log.withColumns({"commit_id": digest(F.col("commit_id")), "parent_ids": F.transform("parent_ids", digest)})
    return log, trees.withColumn("commit_id", digest(F.col("commit_id")))


# Rules of the written tree by folder and file, and which documents they leave in it.
IGNORE_RULES = {
    ".gitignore": "# left out\n*.es\n!src1/*.es\n.gitignore\n.ignore\n/src9/\n",
    "src2/.gitignore": "*\n!*.en\n",
    "src3/.ignore": "!*.es\n*7.de\n",
    "src4/.gitignore": "!*.es\n[0-4]*.es\n",
    "src9/.gitignore": "!*\n",
}
NOT_IGNORED = """CASE source WHEN 'src9' THEN false WHEN 'src1' THEN true WHEN 'src2' THEN lang = 'en'
  WHEN 'src3' THEN NOT (lang = 'de' AND doc_id % 10 = 7)
  WHEN 'src4' THEN NOT (lang = 'es' AND substr(CAST(doc_id AS VARCHAR(20)), 1, 1) IN ('0', '1', '2', '3', '4'))
  ELSE lang <> 'es' END"""


def written_tree(spark: SparkSession, sf_dir: str, version: tuple[str, str]) -> str:
    """A folder with the files of one version of the documents, and nested ignore files."""
    from pyarrow import fs

    folder = work_folder(spark)
    uri = folder if "://" in folder else f"file://{folder}"

    def write(batches):
        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                system.create_dir(f"{base}/{path}".rpartition("/")[0])
                with system.open_output_stream(f"{base}/{path}") as sink:
                    sink.write(content)
            yield batch[["path"]]

    rules = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in IGNORE_RULES.items()], "path string, content binary")
    files = document_versions(spark, sf_dir, *version).select("path", "content").unionByName(rules)
    cut_lineage(files.mapInPandas(write, "path string"))
    return folder


CHAIN_LENGTH = 24
ORIGINAL, EDITED = ("true", "false"), ("true", "true")


def document_chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Commits 1 to ``CHAIN_LENGTH`` over the documents, some of them merges, some dated before their parents.

    A commit lacks every eleventh document and has every seventh one edited, others each
    time. The second parents of the merges are commits of their own, outside the chain.
    """
    n = CHAIN_LENGTH
    rows = [
        (k, [k - 1] * (k > 1) + [100 + k] * (k % 6 == 0), 1000 * k - 2500 * (k % 5 == 0), 0, f"commit {k}") for k in range(1, n + 1)
    ] + [(100 + k, [], 1000 * k - 10, 0, "aside") for k in range(6, n + 1, 6)]
    log = spark.createDataFrame(rows, "commit_id long, parent_ids array<long>, author_seconds long, author_offset int, message string")
    edited = document_versions(spark, sf_dir, *EDITED).select("doc_id", F.col("oid").alias("edited"))
    files = document_versions(spark, sf_dir, *ORIGINAL).select("doc_id", "path", "mode", "oid").join(edited, "doc_id")
    steps = files.withColumn("commit_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    oid = F.when((F.col("doc_id") * 3 + F.col("commit_id")) % 7 == 0, F.col("edited")).otherwise(F.col("oid"))
    main = steps.where((F.col("doc_id") + F.col("commit_id")) % 11 != 0).select("commit_id", "path", "mode", oid.alias("oid"))
    aside = files.where("doc_id % 3 = 0").select(
        F.explode(F.array(*[F.lit(100 + k).cast("long") for k in range(6, n + 1, 6)])).alias("commit_id"), "path", "mode", "oid"
    )
    return log, cut_lineage(main.unionByName(aside))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as revisions of one file."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("commit_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit(".en")).alias("path"),
        F.col("turn").alias("revision"),
        blob_id(F.col("text")).alias("oid"),
        F.col("text").cast("binary").alias("content"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as (oid, list, content), the page id standing for the content's id."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("oid"), F.lit(HTML.name).alias("list"), F.col("html").cast("binary").alias("content")
    ).repartition("oid")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (oid, list, content), the document id standing for the content's id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("oid"), F.lit(PROSE.name).alias("list"), F.col("text").cast("binary").alias("content")
    ).repartition("oid")


def event_changes(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("commit_id"),
        seconds("ts").alias("seconds_since_epoch"),
        F.col("event_type").alias("kind"),
        F.lit("").alias("qualifiers"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file_path"),
        F.lit(0).cast("long").alias("novel_lhs"),
        F.floor("value").cast("long").alias("novel_rhs"),
        F.length("props").cast("long").alias("size_after"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(split_lines(F.col("text"))).alias("row", "line")
    )
