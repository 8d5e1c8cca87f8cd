"""Queries over a change table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.sql import CHAIN, COMMITS, LOG, ONE, STAR, with_
from revtables.functions.ids import short_id
from revtables.functions.text import body, percent, strip_line_end, title
from revtables.operators import chain as chains
from revtables.operators import cochange, symbols
from revtables.plans import inspect as inspection
from revtables.plans import log as logs
from revtables.plans import reports
from revtables.plans.freshness import freshness
from revtables.schema import METRICS, SYMBOL
from revtables.sources import store
from revtables.streaming.history_stream import append_stream

OTHER = [f"other_{c}" for c in SYMBOL]


def change_list(spark: SparkSession, sf: str) -> DataFrame:
    return store.all_changes(fx.changes_star(spark, sf))


def change_list_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.change_lines(fx.changes_star(spark, sf))


def symbols_by_file(spark: SparkSession, sf: str) -> DataFrame:
    changes, symbol = fx.changes_star(spark, sf), fx.star_symbol(spark, sf)
    return symbols.query_symbols(changes, file_path=symbol["file_path"])


def symbols_by_file_and_kind(spark: SparkSession, sf: str) -> DataFrame:
    changes, symbol = fx.changes_star(spark, sf), fx.star_symbol(spark, sf)
    return symbols.query_symbols(changes, file_path=symbol["file_path"], kind=symbol["kind"])


def distinct_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.query_symbols(fx.changes_star(spark, sf))


def changes_of_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.changes_for_symbol(fx.changes_star(spark, sf), fx.star_symbol(spark, sf))


def symbols_without_files(spark: SparkSession, sf: str) -> DataFrame:
    return fx.changes_star(spark, sf).where(F.col("kind") != cochange.FILE_KIND).select(*SYMBOL).distinct()


def resolved_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Each part as a filter; which columns it gives depends on its key."""
    given = F.col("p_partkey") % 8
    filters = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("filter_id"),
        F.when(given.isin(1, 3, 5, 7), F.col("p_brand")).alias("file_path"),
        F.when(given.isin(2, 3, 6, 7), F.col("p_type")).alias("kind"),
        F.when(given.isin(4, 5, 6, 7), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))).alias(
            "qualifiers"
        ),
    )
    return symbols.resolve_symbols(fx.changes_star(spark, sf), filters)


def all_commits(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.all_commits(fx.changes_star(spark, sf))


def commits_of_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.symbol_commits(fx.changes_star(spark, sf), fx.star_symbol(spark, sf))


def commits_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return cochange.commit_counts(fx.changes_star(spark, sf))


def commit_positions(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.commit_positions(fx.changes_star(spark, sf))


def first_change_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.first_changes(fx.changes_star(spark, sf))


def latest_and_earliest_commit(spark: SparkSession, sf: str) -> DataFrame:
    changes = fx.changes_star(spark, sf)
    latest = store.latest_commit(changes).withColumn("which", F.lit("latest"))
    return latest.unionByName(store.earliest_commit(changes).withColumn("which", F.lit("earliest")))


def inspect_every_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.inspect_all(fx.changes_star(spark, sf))


def inspect_one_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.inspect(fx.changes_star(spark, sf), fx.star_symbol(spark, sf))


def inspect_report(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.inspect_text(inspection.inspect_all(fx.changes_star(spark, sf)))


def co_changes_of_symbol(spark: SparkSession, sf: str) -> DataFrame:
    changes = fx.changes_star(spark, sf)
    return cochange.co_changes(changes, symbols.query_symbols(changes, **fx.star_symbol(spark, sf)))


def companions_of_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.companions(fx.changes_star(spark, sf), fx.star_symbol(spark, sf))


def companion_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a report for one symbol."""
    return inspection.companion_text(companions_of_symbol(spark, sf))


def companions_of_every_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return inspection.companions_of_all(fx.changes_star(spark, sf))


def share_percentages(spark: SparkSession, sf: str) -> DataFrame:
    changes = fx.changes_star(spark, sf)
    lines = changes.groupBy(*SYMBOL).agg(F.sum("novel_lhs").alias("l"), F.sum("novel_rhs").alias("r"))
    return lines.select(*SYMBOL, percent(F.col("l") / (F.col("l") + F.col("r"))).alias("removed"))


def symbol_log(spark: SparkSession, sf: str) -> DataFrame:
    log = logs.symbol_log(fx.changes_star(spark, sf), fx.commits(spark, sf), fx.star_symbol(spark, sf))
    return log.select("commit_id", "seconds_since_epoch", "date", "title", "body", *METRICS)


def symbol_log_json(spark: SparkSession, sf: str) -> DataFrame:
    log = logs.symbol_log(fx.changes_star(spark, sf), fx.commits(spark, sf), fx.star_symbol(spark, sf))
    return reports.log_json(log)


def symbol_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    log = logs.symbol_log(fx.changes_star(spark, sf), fx.commits(spark, sf), fx.star_symbol(spark, sf))
    return reports.log_lines(log)


def log_of_every_symbol(spark: SparkSession, sf: str) -> DataFrame:
    log = logs.with_commits(fx.changes_star(spark, sf), fx.commits(spark, sf))
    return logs.newest_first(log).select("commit_id", *SYMBOL, "date", "title")


def commits_missing_from_log(spark: SparkSession, sf: str) -> DataFrame:
    known = fx.commits(spark, sf).where(F.col("message").startswith("1-URGENT") | F.col("message").startswith("2-HIGH"))
    return logs.missing_commits(fx.changes_star(spark, sf), known)


def changes_oldest_first(spark: SparkSession, sf: str) -> DataFrame:
    return logs.oldest_first(fx.changes_star(spark, sf)).select("seconds_since_epoch", "commit_id", *SYMBOL)


def commit_messages(spark: SparkSession, sf: str) -> DataFrame:
    message = F.col("text")
    return fx.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        title(F.regexp_replace(message, r"\.\n", ".\n\n")).alias("title"),
        body(F.regexp_replace(message, r"\.\n", ".\n\n")).alias("body"),
    )


def stripped_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Names with different line ends put behind them."""
    end = F.when(F.col("p_partkey") % 4 == 0, "\r\n").when(F.col("p_partkey") % 4 == 1, "\n\n").when(
        F.col("p_partkey") % 4 == 2, "\r").otherwise("")
    return fx.table(spark, sf, "part").select("p_partkey", strip_line_end(F.concat("p_name", end)).alias("name"))


def short_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.unhex(F.sha1(F.col("o_orderkey").cast("string").cast("binary")))
    return fx.table(spark, sf, "orders").select("o_orderkey", short_id(key).alias("id"))


def first_parents(spark: SparkSession, sf: str) -> DataFrame:
    return chains.first_parents(fx.commit_chain(spark, sf))


def _head(spark: SparkSession, sf: str):
    latest = fx.commits(spark, sf).agg(F.max(F.struct("author_seconds", "commit_id")).alias("c")).first()
    return F.lit(latest.c.commit_id)


def commit_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chains.chain(fx.commit_chain(spark, sf), _head(spark, sf))


def commits_to_build(spark: SparkSession, sf: str) -> DataFrame:
    """What is left to build when the commits of the middle years are stored."""
    log = fx.commit_chain(spark, sf)
    stored = log.where("author_seconds between 850000000 and 880000000").select(
        "commit_id", F.col("author_seconds").alias("seconds_since_epoch")
    )
    return chains.frontier(chains.chain(log, _head(spark, sf)), stored)


def history_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """The change table against the last commit, an older one and no branch."""
    changes = fx.changes_star(spark, sf)
    first = fx.commits(spark, sf).agg(F.min("commit_id")).first()[0]
    last = store.latest_commit(changes).first().commit_id
    rows = [("last", F.lit(last)), ("first", F.lit(first)), ("none", F.lit(None).cast("long"))]
    parts = [freshness(changes, head).withColumn("head", F.lit(name)) for name, head in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def appended_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The change table written in two appends that overlap."""
    folder = fx.work_folder(spark) + "/changes"
    changes = fx.changes_star(spark, sf)
    store.append_changes(changes.where("seconds_since_epoch < 880000000"), folder)
    store.append_changes(changes.where("seconds_since_epoch > 850000000"), folder)
    return store.open_changes(spark, folder, changes.schema["commit_id"].dataType)


def rebuilt_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The change table after a purge and a new build."""
    folder = fx.work_folder(spark) + "/changes"
    changes = fx.changes_star(spark, sf)
    store.append_changes(changes.where("seconds_since_epoch > 850000000"), folder)
    store.purge_changes(spark, folder)
    store.append_changes(changes.where("seconds_since_epoch < 880000000"), folder)
    return store.open_changes(spark, folder, changes.schema["commit_id"].dataType)


def streamed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of change rows, appended batch by batch."""
    schema = fx.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = fx.work_folder(spark)
    append_stream(stream, f"{folder}/changes", f"{folder}/progress", fx.event_changes).awaitTermination()
    return store.open_changes(spark, f"{folder}/changes", schema["event_id"].dataType)


def positions_of_streamed_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Late commits take their place in time when the table is read."""
    return inspection.commit_positions(streamed_changes(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        change_list,
        change_list_lines,
        symbols_by_file,
        symbols_by_file_and_kind,
        distinct_symbols,
        changes_of_symbol,
        symbols_without_files,
        resolved_symbols,
        all_commits,
        commits_of_symbol,
        commits_per_symbol,
        commit_positions,
        first_change_per_symbol,
        latest_and_earliest_commit,
        inspect_every_symbol,
        inspect_one_symbol,
        inspect_report,
        co_changes_of_symbol,
        companions_of_symbol,
        companion_report,
        companions_of_every_symbol,
        share_percentages,
        symbol_log,
        symbol_log_json,
        symbol_log_lines,
        log_of_every_symbol,
        commits_missing_from_log,
        changes_oldest_first,
        commit_messages,
        stripped_line_ends,
        short_ids,
        first_parents,
        commit_chain,
        commits_to_build,
        history_freshness,
        appended_changes,
        rebuilt_changes,
        streamed_changes,
        positions_of_streamed_commits,
    )
}

S = "kind, qualifiers, file_path"
POSITIONS = """
commits_in_time AS (
  SELECT commit_id, seconds_since_epoch, row_number() OVER (ORDER BY seconds_since_epoch, commit_id) - 1 AS position
  FROM (SELECT DISTINCT commit_id, seconds_since_epoch FROM changes))
"""
SHARES = f"""
shares AS (
  SELECT {S}, count(*) AS commits, count(*) / (SELECT count(*) FROM commits_in_time) AS share,
         count(*) / ((SELECT count(*) FROM commits_in_time) - min(position)) AS share_since_introduction
  FROM changes JOIN commits_in_time USING (commit_id, seconds_since_epoch) GROUP BY ALL)
"""
TOGETHER = """
pairs AS (
  SELECT a.kind, a.qualifiers, a.file_path, b.kind AS other_kind, b.qualifiers AS other_qualifiers,
         b.file_path AS other_file_path, count(*) AS together
  FROM changes a JOIN changes b ON a.commit_id = b.commit_id
  WHERE (a.kind, a.qualifiers, a.file_path) <> (b.kind, b.qualifiers, b.file_path) GROUP BY ALL),
own AS (SELECT kind, qualifiers, file_path, count(*) AS commits FROM changes GROUP BY ALL),
together AS (SELECT p.*, together / commits AS ratio FROM pairs p JOIN own USING (kind, qualifiers, file_path)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY kind, qualifiers, file_path
    ORDER BY together DESC, other_kind, other_qualifiers, other_file_path) AS rank
  FROM together WHERE other_kind <> 'file')
"""
LINE = "printf('%s %s %s %s %d (+%d -%d) -> %d', kind, qualifiers, file_path, CAST(commit_id AS VARCHAR), seconds_since_epoch, novel_rhs, novel_lhs, size_after)"
EVENTS = """
changes AS (
  SELECT event_id AS commit_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds_since_epoch, event_type AS kind,
         '' AS qualifiers, 'user/' || CAST(user_id AS VARCHAR) AS file_path, CAST(0 AS BIGINT) AS novel_lhs,
         CAST(floor(value) AS BIGINT) AS novel_rhs, length(props) AS size_after
  FROM events)
"""

ORACLES = {
    "change_list": with_(STAR, body="SELECT * FROM changes"),
    "change_list_lines": with_(STAR, body=f"SELECT {LINE} AS line FROM changes"),
    "symbols_by_file": with_(STAR, ONE, body=f"SELECT DISTINCT {S} FROM changes SEMI JOIN one USING (file_path)"),
    "symbols_by_file_and_kind": with_(
        STAR, ONE, body=f"SELECT DISTINCT {S} FROM changes SEMI JOIN one USING (file_path, kind)"
    ),
    "distinct_symbols": with_(STAR, body=f"SELECT DISTINCT {S} FROM changes"),
    "changes_of_symbol": with_(STAR, ONE, body=f"SELECT * FROM changes SEMI JOIN one USING ({S})"),
    "symbols_without_files": with_(STAR, body=f"SELECT DISTINCT {S} FROM changes WHERE kind <> 'file'"),
    "resolved_symbols": with_(
        STAR,
        """
symbols AS (SELECT DISTINCT kind, qualifiers, file_path FROM changes),
filters AS (
  SELECT p_partkey AS filter_id, CASE WHEN p_partkey % 8 IN (1, 3, 5, 7) THEN p_brand END AS f,
         CASE WHEN p_partkey % 8 IN (2, 3, 6, 7) THEN p_type END AS k,
         CASE WHEN p_partkey % 8 IN (4, 5, 6, 7) THEN p_name || '#' || CAST(p_partkey AS VARCHAR) END AS q
  FROM part),
hits AS (
  SELECT filter_id, count(kind) AS n, min(kind) AS kind, min(qualifiers) AS qualifiers, min(file_path) AS file_path
  FROM filters LEFT JOIN symbols ON (f IS NULL OR file_path = f) AND (k IS NULL OR kind = k)
    AND (q IS NULL OR qualifiers = q) GROUP BY 1)""",
        body="""
SELECT filter_id, CASE WHEN filter_id % 8 <> 0 THEN n END AS matches,
       CASE WHEN filter_id % 8 = 0 THEN 'no argument' WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status,
       CASE WHEN n = 1 AND filter_id % 8 <> 0 THEN kind END AS kind,
       CASE WHEN n = 1 AND filter_id % 8 <> 0 THEN qualifiers END AS qualifiers,
       CASE WHEN n = 1 AND filter_id % 8 <> 0 THEN file_path END AS file_path
FROM hits""",
    ),
    "all_commits": with_(STAR, body="SELECT DISTINCT commit_id, seconds_since_epoch FROM changes"),
    "commits_of_symbol": with_(
        STAR, ONE, body=f"SELECT DISTINCT commit_id, seconds_since_epoch FROM changes SEMI JOIN one USING ({S})"
    ),
    "commits_per_symbol": with_(STAR, body=f"SELECT {S}, count(*) AS commits FROM changes GROUP BY ALL"),
    "commit_positions": with_(STAR, POSITIONS, body="SELECT * FROM commits_in_time"),
    "first_change_per_symbol": with_(
        STAR,
        body=f"""SELECT {S}, commit_id, seconds_since_epoch FROM changes
QUALIFY row_number() OVER (PARTITION BY {S} ORDER BY seconds_since_epoch, commit_id) = 1""",
    ),
    "latest_and_earliest_commit": with_(
        STAR,
        body="""
(SELECT commit_id, seconds_since_epoch, 'latest' AS which FROM changes ORDER BY 2 DESC, 1 DESC LIMIT 1)
UNION ALL
(SELECT commit_id, seconds_since_epoch, 'earliest' FROM changes ORDER BY 2, 1 LIMIT 1)""",
    ),
    "inspect_every_symbol": with_(STAR, POSITIONS, SHARES, body="SELECT * FROM shares"),
    "inspect_one_symbol": with_(STAR, POSITIONS, SHARES, ONE, body=f"SELECT * FROM shares SEMI JOIN one USING ({S})"),
    "inspect_report": with_(
        STAR,
        POSITIONS,
        SHARES,
        body=f"""SELECT {S}, printf('%s %s (%s): %d commits, %.2f%% of all, %.2f%% since its first one',
kind, qualifiers, file_path, commits, CAST(CAST(share AS FLOAT) * CAST(100 AS FLOAT) AS DOUBLE), CAST(CAST(share_since_introduction AS FLOAT) * CAST(100 AS FLOAT) AS DOUBLE)) AS line FROM shares""",
    ),
    "co_changes_of_symbol": with_(STAR, TOGETHER, ONE, body=f"SELECT * FROM together SEMI JOIN one USING ({S})"),
    "companion_report": with_(
        STAR, TOGETHER, ONE,
        body=f"""SELECT {S}, rank, printf('%.2f%% of its commits: %s %s (%s)', CAST(CAST(ratio AS FLOAT) * CAST(100 AS FLOAT) AS DOUBLE),
other_kind, other_qualifiers, other_file_path) AS line FROM ranked SEMI JOIN one USING ({S}) WHERE rank <= 10""",
    ),
    "companions_of_symbol": with_(
        STAR, TOGETHER, ONE, body=f"SELECT * FROM ranked SEMI JOIN one USING ({S}) WHERE rank <= 10"
    ),
    "companions_of_every_symbol": with_(STAR, TOGETHER, body="SELECT * FROM ranked WHERE rank <= 10"),
    "share_percentages": with_(
        STAR,
        body=f"""SELECT {S}, printf('%.2f%%', CAST(CAST(sum(novel_lhs) / (sum(novel_lhs) + sum(novel_rhs)) AS FLOAT) * CAST(100 AS FLOAT) AS DOUBLE)) AS removed
FROM changes GROUP BY ALL""",
    ),
    "symbol_log": with_(
        STAR,
        ONE,
        COMMITS,
        LOG,
        body="SELECT commit_id, seconds_since_epoch, date, title, body, novel_lhs, novel_rhs, size_after FROM log",
    ),
    "symbol_log_json": with_(
        STAR,
        ONE,
        COMMITS,
        LOG,
        body="""SELECT commit_id, CAST(json_object('seconds_since_epoch', seconds_since_epoch, 'time_formatted', date,
'title', title, 'body', body, 'id', CAST(commit_id AS VARCHAR), 'novel_lhs', novel_lhs, 'novel_rhs', novel_rhs,
'size_after', size_after) AS VARCHAR) AS json FROM log""",
    ),
    "symbol_log_lines": with_(
        STAR, ONE, COMMITS, LOG, body="SELECT commit_id, commit_id || ' ' || date || ' ' || title AS line FROM log"
    ),
    "log_of_every_symbol": with_(
        STAR,
        "one AS (SELECT DISTINCT kind, qualifiers, file_path FROM changes)",
        COMMITS,
        LOG,
        body=f"SELECT commit_id, {S}, date, title FROM log",
    ),
    "commits_missing_from_log": with_(
        STAR,
        body="""SELECT DISTINCT commit_id FROM changes ANTI JOIN
(SELECT o_orderkey AS commit_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) USING (commit_id)""",
    ),
    "changes_oldest_first": with_(STAR, body=f"SELECT seconds_since_epoch, commit_id, {S} FROM changes"),
    "commit_messages": """
WITH m AS (SELECT conv_id, turn, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS message FROM conversations)
SELECT conv_id, turn, split_part(message, chr(10) || chr(10), 1) AS title,
       CASE WHEN contains(message, chr(10) || chr(10)) THEN substr(message, instr(message, chr(10) || chr(10)) + 2) END AS body
FROM m""",
    "stripped_line_ends": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) WHEN 2 THEN p_name || chr(13)
       ELSE p_name END AS name FROM part""",
    "short_ids": "SELECT o_orderkey, substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 8) AS id FROM orders",
    "first_parents": with_(CHAIN, body="SELECT commit_id, parent_id FROM chain"),
    "commit_chain": with_(CHAIN, body="SELECT commit_id, position FROM chain"),
    "commits_to_build": with_(
        CHAIN,
        body="""SELECT commit_id, position FROM chain
WHERE seconds_since_epoch NOT BETWEEN 850000000 AND 880000000""",
    ),
    "history_freshness": with_(
        STAR,
        """latest AS (SELECT commit_id FROM changes ORDER BY seconds_since_epoch DESC, commit_id DESC LIMIT 1),
heads AS (SELECT 'last' AS head, commit_id AS h FROM latest UNION ALL SELECT 'first', min(o_orderkey) FROM orders
  UNION ALL SELECT 'none', NULL)""",
        body="""SELECT head, commit_id AS latest_commit, CASE WHEN h IS NULL THEN 'detached head'
WHEN h = commit_id THEN 'up to date' ELSE 'outdated' END AS status FROM heads, latest""",
    ),
    "appended_changes": with_(STAR, body="SELECT * FROM changes"),
    "rebuilt_changes": with_(STAR, body="SELECT * FROM changes WHERE seconds_since_epoch < 880000000"),
    "streamed_changes": with_(EVENTS, body="SELECT * FROM changes"),
    "positions_of_streamed_commits": with_(EVENTS, POSITIONS, body="SELECT * FROM commits_in_time"),
}
