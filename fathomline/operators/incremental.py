"""Only what is new or changed since the last successful run.

The reread point is the start of the oldest run that was open when the last successful run began, so nothing that such a
run may have written late is skipped.  Rows stamped before that point are not trusted to be old, because records
arrive late: they take the same anti-join against the ledger of processed (key, version) pairs, which also removes what
the reread repeats.  A run that fails has added nothing to the ledger of successful runs, so its records come again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.tables import newest_row


def successful_runs(runs: DataFrame) -> DataFrame:
    """Run ids with status 'ok', each once."""
    return runs.where("status = 'ok' and run_id is not null").select("run_id").distinct()


def reread_from(runs: DataFrame) -> DataFrame:
    """One row: ``last_ok_run, reread_from``.

    The last successful run is the one that started last (of equal starts the larger id).  ``reread_from`` is the earliest
    start among it and the runs that were open when it started: begun by then and not finished before, whatever became of
    them.  Without a successful run both are null: everything is read.
    """
    last = runs.where("status = 'ok'").agg(F.max(F.struct("started_at", "run_id")).alias("last")).select("last.run_id", "last.started_at")
    last = last.select(F.col("run_id").alias("last_ok_run"), F.col("started_at").alias("_start"))
    open_ = runs.select("started_at", "finished_at", "status")
    joined = last.join(open_, (F.col("started_at") <= F.col("_start")) & (F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("_start"))), "left")
    return joined.groupBy("last_ok_run", "_start").agg(F.least(F.min("started_at"), F.col("_start")).alias("reread_from")).select("last_ok_run", "reread_from")


def ledger(log: DataFrame, runs: DataFrame, table_name: str) -> DataFrame:
    """What successful runs recorded of a table: ``record_key, content_hash (lower case), run_id, logged_at``.

    The list of runs is tiny (one row per run); rows of the ledger that repeat stay, the anti-joins do not mind them.
    """
    mine = log.where(F.col("table_name") == table_name).select("record_key", F.lower("content_hash").alias("content_hash"), "run_id", "logged_at")
    return mine.join(successful_runs(runs), "run_id", "left_semi")


def unprocessed_versions(records: DataFrame, done: DataFrame, key: str, version: str, record_id: str, stamp: str) -> DataFrame:
    """``record_id, stamp`` of records whose (key, version) is in no ledger row; null keys or versions are never in it.

    Each id once, with its largest stamp."""
    pairs = done.select(F.col("record_key").alias("_k"), F.col("content_hash").alias("_v"))
    rows = records.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), F.col(key).alias("_k"), F.lower(version).alias("_v"), F.col(stamp).alias("stamp"))
    return rows.join(pairs, ["_k", "_v"], "left_anti").groupBy("record_id").agg(F.max("stamp").alias("stamp"))


def changed_records(records: DataFrame, done: DataFrame, record_id: str, stamp: str, version: str) -> DataFrame:
    """``record_id, stamp`` of ids whose newest row's version differs from the one logged by the latest successful run that logged them, or that
    none logged.  Letter case does not matter; a null version equals a null logged version.  Each id once."""
    now = newest_row(records.where(F.col(record_id).isNotNull()), record_id, stamp, version).select(F.col(record_id).alias("record_id"), F.col(stamp).alias("stamp"), F.lower(version).alias("_now"))
    logged = done.groupBy(F.col("record_key").alias("record_id")).agg(F.max(F.struct("run_id", "logged_at", "content_hash")).alias("r")).select("record_id", F.col("r.content_hash").alias("_was"), F.lit(True).alias("_logged"))
    return now.join(logged, "record_id", "left").where("_logged is null or not (_now <=> _was)").select("record_id", "stamp")


def _utc_nanos(column: str) -> str:
    """Nanoseconds since the epoch of a timestamp without zone that is meant as UTC, whatever the session's zone."""
    days = f"cast(datediff(cast({column} as date), date'1970-01-01') as bigint)"
    return f"({days} * 86400 + hour({column}) * 3600 + minute({column}) * 60) * 1000000000 + cast(extract(second from {column}) * 1000000000 as bigint)"


def changes_since_last_run(chunks: DataFrame, nodes: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """``table_name, record_id, lane`` of all chunks and nodes to process in the next run, each once.

    ``lane`` is 'reread' for records stamped at or after the reread point (all, without a successful run), else 'late':
    records that arrived or changed without a newer stamp, and those without any.  A run takes the first lane first;
    dropping the second would skip records.
    """
    point = reread_from(runs).select(F.expr(_utc_nanos("reread_from")).alias("_point"))
    a = unprocessed_versions(chunks, ledger(log, runs, "chunks"), "path", "content_sha1", "id", "last_seen_at").withColumn("table_name", F.lit("chunks"))
    b = changed_records(nodes, ledger(log, runs, "graph_nodes"), "id", "last_seen_at", "content_hash").withColumn("table_name", F.lit("graph_nodes"))
    lane = F.when(F.coalesce(F.col("stamp") >= F.col("_point"), F.col("_point").isNull()), "reread").otherwise("late")
    return a.unionByName(b).crossJoin(F.broadcast(point)).select("table_name", "record_id", lane.alias("lane"))
