"""Versioned tables: every write makes a new directory, and a pointer file names the one to read.

Parquet has no MERGE; a mutation computes the rows of the next version and swaps the pointer after they are written.
Readers that began earlier keep their version.  One writer at a time, as in the rest of the index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class VersionedStore:
    """Tables and a small dictionary of properties below one directory of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Write beside the target, then rename, so that a reader never sees half a pointer."""
        target, fresh = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not self._fs.rename(fresh, target):
            self._fs.delete(target, False)
            self._fs.rename(fresh, target)

    def exists(self, table: str) -> bool:
        return self._read(f"{table}.current") is not None

    def read(self, table: str) -> DataFrame:
        version = self._read(f"{table}.current")
        if version is None:
            raise LookupError(f"no table {table} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{table}/{version}")

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Make ``df`` the current version.  ``df`` may be computed from the present one."""
        version = uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{table}/{version}")
        old = self._read(f"{table}.previous"), self._read(f"{table}.current")
        self._write(f"{table}.current", version)
        if old[1]:
            self._write(f"{table}.previous", old[1])
        if old[0]:  # the version before the previous one has no readers left
            self._fs.delete(self._path(f"{self.root}/{table}/{old[0]}"), True)

    def change(self, table: str, make: Callable[[DataFrame], DataFrame]) -> None:
        self.write(table, make(self.read(table)))

    def properties(self) -> dict[str, str]:
        return json.loads(self._read("properties.json") or "{}")

    def set_properties(self, **values: str) -> None:
        self._write("properties.json", json.dumps(self.properties() | values, sort_keys=True))

    def clone(self, root: str) -> "VersionedStore":
        """A copy that shares nothing with this one."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target = self._path(root)
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(self.root), target.getFileSystem(conf), target, False, conf)
        return VersionedStore(self.spark, root)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)
