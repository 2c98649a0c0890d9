"""Keeping the chunk table fresh: upsert, touch, prune, and the queue of summaries.

Tables are immutable versions: each operator returns the rows of the next version, which ``sources.tables`` swaps in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.functions.text import line_count

#: kinds that survive pruning by age
KEPT_KINDS = ("package_summary", "repo_summary")
BEHIND_ROWS, BEHIND_NS = 100, 3_600_000_000_000
SUMMARY_MIN_LINES = 30


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The next version: incoming rows, and the current ones whose key does not come in.

    Of incoming rows that repeat a key the one with the largest ``last_seen_at`` is taken.  Applying it twice changes
    nothing.  Null keys equal each other.
    """
    newest = Window.partitionBy(*key).orderBy(F.desc("last_seen_at"))
    rows = incoming.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    same = F.lit(True)
    for k in key:
        same = same & current[k].eqNullSafe(rows[k])
    return current.join(rows, same, "left_anti").unionByName(rows.select(*current.columns))


def plan_upsert(incoming: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """``incoming`` with ``action``: 'touch' where its key is known (content unchanged), else 'insert'."""
    marked = known.select(*key).distinct().withColumn("_known", F.lit(True))
    return incoming.join(marked, key, "left").withColumn("action", F.when(F.col("_known"), "touch").otherwise("insert")).drop("_known")


def touch(current: DataFrame, seen: DataFrame, key: list[str], at: Column) -> DataFrame:
    """``current`` with ``last_seen_at`` set to ``at`` and name and lines refreshed for the keys in ``seen``."""
    fresh = seen.select(*key, F.col("name").alias("_name"), F.col("start_line").alias("_first"), F.col("end_line").alias("_last"), F.lit(True).alias("_seen")).dropDuplicates(key)
    joined = current.join(fresh, key, "left")
    changed = {"name": "_name", "start_line": "_first", "end_line": "_last"}
    out = joined.withColumns({c: F.when(F.col("_seen"), F.coalesce(n, c)).otherwise(F.col(c)) for c, n in changed.items()} | {"last_seen_at": F.when(F.col("_seen"), at).otherwise(F.col("last_seen_at"))})
    return out.select(*current.columns)


def touch_paths(current: DataFrame, unchanged: DataFrame, at: Column) -> DataFrame:
    """``current`` with ``last_seen_at`` set to ``at`` for all rows of the paths in ``unchanged(path)``."""
    seen = unchanged.select("path").distinct().withColumn("_same", F.lit(True))
    joined = current.join(seen, "path", "left")
    return joined.withColumn("last_seen_at", F.when(F.col("_same"), at).otherwise(F.col("last_seen_at"))).select(*current.columns)


def prune(chunks: DataFrame, cutoff: int) -> DataFrame:
    """Without rows last seen before ``cutoff``, except summaries of packages and the repository; then without package
    summaries below whose path no other row is left.

    The paths that have something below them are the ancestors of the remaining rows: an equi-join on exploded
    ancestors, where a range condition would compare every summary with every row.
    """
    is_kept = F.col("kind").isin(*KEPT_KINDS)
    alive = chunks.where((F.col("last_seen_at") >= cutoff) | is_kept)
    occupied = alive.where(~is_kept).select("path").distinct().select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    roots = F.col("path").isin(".", "")
    summaries = alive.where((F.col("kind") == "package_summary") & ~roots)
    return alive.where((F.col("kind") != "package_summary") | roots).unionByName(summaries.join(occupied, "path", "left_semi"))


def covered_gaps(chunks: DataFrame) -> DataFrame:
    """``path, gap_start, gap_end``: lines of a file before its last chunk that no chunk covers.

    Intervals are merged by a running maximum of their ends; summaries and rows without lines do not count.
    """
    spans = chunks.where("start_line > 0 and end_line >= start_line and not endswith(kind, '_summary')").select("path", "start_line", "end_line").distinct()
    order = Window.partitionBy("path").orderBy("start_line", "end_line")
    reach = F.coalesce(F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("_reach", reach).where("start_line > _reach + 1").select("path", (F.col("_reach") + 1).cast("int").alias("gap_start"), (F.col("start_line") - 1).cast("int").alias("gap_end"))


def queue_state(queue: DataFrame, at: Column) -> DataFrame:
    """One row: ``pending, oldest, behind``; behind with more than 100 rows or one older than an hour at ``at``."""
    sums = queue.agg(F.count(F.lit(1)).alias("pending"), F.min("queued_at").alias("oldest"), F.max("queued_at").alias("_last"))
    return sums.select("pending", "oldest", F.coalesce((F.col("pending") > BEHIND_ROWS) | (at - F.col("oldest") > BEHIND_NS), F.lit(False)).alias("behind"))


def jobs_to_enqueue(chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """Summary jobs (``id, path, kind, content_sha1``) for structural chunks of enough lines that are not queued yet."""
    structural = ~F.col("kind").isin("window", "orphan") & ~F.col("kind").endswith("_summary") & ~F.col("kind").endswith(":window")
    due = chunks.where(structural & F.col("content").isNotNull() & (line_count(F.col("content")) >= SUMMARY_MIN_LINES))
    jobs = due.select("id", "path", F.lit("chunk_summary").alias("kind"), F.sha1(F.concat(F.lit("chunk_summary:"), "content")).alias("content_sha1"))
    return jobs.join(queue.select("path", "kind", "content_sha1"), ["path", "kind", "content_sha1"], "left_anti").select("id", "path", "kind", "content_sha1")


def stale_jobs(queue: DataFrame, chunks: DataFrame) -> DataFrame:
    """Queue rows whose source no longer exists with that hash."""
    return queue.join(chunks.select("path", F.col("content_sha1").alias("source_sha1")), ["path", "source_sha1"], "left_anti")


def drop_other_summaries(chunks: DataFrame, path: str, kind: str, keep_sha: str) -> DataFrame:
    """Without the rows of (path, kind) that have another hash than the one to keep; a null hash is another one."""
    other = (F.col("path") == path) & (F.col("kind") == kind) & ~F.col("content_sha1").eqNullSafe(F.lit(keep_sha))
    return chunks.where(~F.coalesce(other, F.lit(False)))


def drop_paths(chunks: DataFrame, paths_: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Without the rows of some paths and of those below a prefix, taken literally; an empty prefix removes nothing.  Null paths stay."""
    gone = F.lit(False)
    if paths_:
        gone = gone | F.col("path").isin(*paths_)
    if prefix:
        gone = gone | F.col("path").startswith(prefix)
    return chunks.where(~F.coalesce(gone, F.lit(False)))


def take_jobs(queue: DataFrame, most: int) -> DataFrame:
    """The ``most`` jobs that wait longest; ties go to the smaller id."""
    return queue.orderBy("queued_at", "id").limit(most)


def bump_attempts(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """``queue`` with one more attempt and the last error of the jobs in ``failed(id, error)``; they stay queued.

    Of several errors of a job the largest text counts, and it is one attempt.
    """
    errors = failed.where("id is not null").groupBy("id").agg(F.max(F.coalesce("error", F.lit(""))).alias("_error"))
    joined = queue.join(errors, "id", "left")
    hit = F.col("_error").isNotNull()
    return joined.withColumns({"attempts": F.when(hit, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")), "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error"))}).select(*queue.columns)


def remove_jobs(queue: DataFrame, done: DataFrame) -> DataFrame:
    """``queue`` without the ids in ``done``; unknown ids are no error."""
    return queue.join(done.select("id").distinct(), "id", "left_anti").select(*queue.columns)
