"""The ledger behind incremental runs: what each run processed, and which runs are committed.

A run is opened, appends the (key, version) pairs it has processed, and is committed.  Appended rows lie in a folder of
their run and bucket; a commit is one small file written beside its target and renamed.  Rows of a run that was never
committed are in no ledger, so a run that dies anywhere between opening and commit is as if it had not been: the next one
processes its records again, and none is skipped or repeated.

The ledger is partitioned by a hash of the key.  A run reads its buckets side by side with those of the records, and
``since`` gives the records stamped at or after the reread point, a filter that reaches the scan and its statistics.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "record_key string, version string, run_id bigint, bucket int"


class RunLedger:
    """A ledger of one table below a directory that all executors share.  One run is committed at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, record: dict) -> None:
        fresh, target = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/runs/{name}")
        self._fs.mkdirs(self._path(f"{self.root}/runs"))
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        if not self._fs.rename(fresh, target):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"{name} exists already")

    def runs(self) -> list[dict]:
        """Opened runs with ``run_id, started_at`` and, where committed, ``finished_at``, in order of their ids."""
        found: dict[int, dict] = {}
        at = self._path(f"{self.root}/runs")
        if not self._fs.exists(at):
            return []
        for status in self._fs.listStatus(at):
            stream = self._fs.open(status.getPath())
            try:
                record = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            found.setdefault(record["run_id"], {}).update(record)
        return [found[i] for i in sorted(found)]

    def open(self, now: int | None = None) -> int:
        """Open a run and give its id; ``now`` is in nanoseconds."""
        run_id = max([r["run_id"] for r in self.runs()], default=0) + 1
        self._write(f"{run_id}.opened", {"run_id": run_id, "started_at": now or time.time_ns()})
        return run_id

    def append(self, run_id: int, processed: DataFrame, key: str, version: str) -> None:
        """Record what a run has processed; may be called again, also with the same rows.  Null keys and versions are left out."""
        pairs = processed.select(F.col(key).cast("string").alias("record_key"), F.lower(F.col(version)).alias("version")).na.drop().distinct()
        rows = pairs.select("*", F.lit(run_id).cast("bigint").alias("run_id"), self._bucket(F.col("record_key")).alias("bucket"))
        rows.repartition("bucket").write.mode("append").partitionBy("run_id", "bucket").option("compression", "zstd").parquet(f"{self.root}/rows")

    def commit(self, run_id: int, now: int | None = None) -> None:
        """From here on the rows of the run are processed.  A second commit of a run is an error."""
        self._write(f"{run_id}.committed", {"run_id": run_id, "finished_at": now or time.time_ns()})

    def abandon(self, run_id: int, now: int | None = None) -> None:
        """Close a run that died, so that it no longer holds back the reread point; its rows stay unprocessed."""
        self._write(f"{run_id}.abandoned", {"run_id": run_id, "abandoned_at": now or time.time_ns()})

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """``record_key, version, run_id, bucket`` of committed runs; other folders are not listed as input."""
        done = [r["run_id"] for r in self.runs() if "finished_at" in r]
        if not done or not self._fs.exists(self._path(f"{self.root}/rows")):
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(f"{self.root}/rows").where(F.col("run_id").isin(done))

    def reread_from(self) -> int | None:
        """The start of the oldest run that was open when the last committed run started; None before the first commit."""
        runs = self.runs()
        done = [r for r in runs if "finished_at" in r]
        if not done:
            return None
        last = max(r["started_at"] for r in done)
        return min(r["started_at"] for r in runs if r["started_at"] <= last and r.get("finished_at", r.get("abandoned_at", last)) >= last)

    def since(self, records: DataFrame, stamp: str) -> DataFrame:
        """Records stamped at or after the reread point, and those without a stamp."""
        point = self.reread_from()
        return records if point is None else records.where((F.col(stamp) >= point) | F.col(stamp).isNull())

    def pending(self, records: DataFrame, key: str, version: str, stamp: str, late: bool = True) -> DataFrame:
        """The records whose (key, version) no committed run has processed.

        With ``late`` all records are looked at, because records may arrive with old stamps; without it only those that
        ``since`` gives.  Null keys or versions are never processed, so they always come out.
        """
        rows = records if late else self.since(records, stamp)
        done = self.rows().select(F.col("record_key").alias("_k"), F.col("version").alias("_v"), F.col("bucket").alias("_b"))
        keyed = rows.withColumns({"_k": F.col(key).cast("string"), "_v": F.lower(F.col(version))}).withColumn("_b", self._bucket(F.col("_k")))
        return keyed.join(done, ["_b", "_k", "_v"], "left_anti").drop("_b", "_k", "_v").select(*records.columns)
