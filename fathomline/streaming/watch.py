"""Change events as a stream: filter, debounce, and one refresh per quiet project.

The watcher's timers become session windows over event time.  A watermark bounds the state: events later than it are
dropped, and a session is emitted once the watermark has passed its end.  Micro-batches never overlap, which gives the
single flight of a refresh; a batch that fails is repeated from its offsets.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.functions import paths

CHANGES = ("create", "write", "remove", "rename")
GONE = ("remove", "rename")


def relevant_events(events: DataFrame, path: str = "path", kind: str = "event_type") -> DataFrame:
    """Events of indexable, not ignored files; removals and renames need no known extension."""
    p, k = F.col(path), F.lower(F.col(kind))
    return events.where(k.isin(*CHANGES) & ~paths.is_ignored(p) & (k.isin(*GONE) | paths.is_indexable(p)))


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """Runs of events of a key with no pause longer than ``gap``: ``key, started, ended, events``.

    Works on tables and on streams; a stream needs ``watermark``.  Timestamps without zone are read as UTC.
    """
    rows = events.withColumn("_at", F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("_at", watermark)
    runs = rows.groupBy(F.col(key), F.session_window("_at", gap).alias("w")).agg(F.min("_at").alias("started"), F.max("_at").alias("ended"), F.count(F.lit(1)).alias("events"))
    return runs.select(key, "started", "ended", "events")


def on_flush(sessions: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, after: Callable[[], None] | None = None) -> StreamingQuery:
    """Start a stream that calls ``refresh`` with the debounced sessions of each micro-batch, then ``after`` (the graph)."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            refresh(batch, number)
            if after:
                after()

    return sessions.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint).start()


class Backoff:
    """Pauses of the queue drain: after three rounds without progress 30 s, doubling up to 30 min; progress resets it."""

    def __init__(self, patience: int = 3, first: float = 30.0, most: float = 1800.0) -> None:
        self.patience, self.first, self.most = patience, first, most
        self.idle, self.pause = 0, 0.0

    def after(self, progress: bool) -> float:
        if progress:
            self.idle, self.pause = 0, 0.0
        else:
            self.idle += 1
            if self.idle >= self.patience:
                self.pause = min(self.most, self.pause * 2 if self.pause else self.first)
        return self.pause


def drain(take: Callable[[int], int], batch: int = 10, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep, backoff: Backoff | None = None) -> int:
    """Call ``take(batch)``, which returns the number of jobs done, until the queue is empty or ``rounds`` have passed."""
    backoff, done, n = backoff or Backoff(), 0, 0
    while rounds is None or n < rounds:
        n += 1
        got = take(batch)
        if got < 0:  # nothing queued
            break
        done += got
        pause = backoff.after(got > 0)
        if pause:
            sleep(pause)
    return done


class IdleHook:
    """Work for quiet times: due ``delay`` seconds after a clean flush, cancelled by an event.

    ``poll`` runs it when it is due; a hook that returns False has more to do and is due again after the same delay.
    """

    def __init__(self, hook: Callable[[], bool], delay: float = 5.0, clock: Callable[[], float] = time.monotonic) -> None:
        self._hook, self._delay, self._clock = hook, delay, clock
        self._due: float | None = None

    def event(self) -> None:
        self._due = None

    def flushed(self) -> None:
        self._due = self._clock() + self._delay

    def poll(self) -> bool:
        if self._due is None or self._clock() < self._due:
            return False
        self._due = None if self._hook() else self._clock() + self._delay
        return True
