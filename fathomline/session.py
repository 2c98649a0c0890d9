"""Session construction and the scratch area that cuts long lineages.

``materialise`` writes a compressed table into the folder that the cluster names in ``spark.checkpoint.dir`` and reads it
back, so that a lost executor costs nothing but a re-read.  A folder of our own is used only where the setting is absent,
as in unit tests.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}


def build_session(app: str = "fathomline", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling; an existing session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in {**settings, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_ROOT[app] = f"file://{own}"
    return _OWN_ROOT[app]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once; they need not have it installed.

    The archive lies beside the driver, whose file server hands it to the executors.
    """
    sc = spark.sparkContext
    name = f"fathomline-{sc.applicationId}.zip"
    if any(str(f).endswith(name) for f in sc.listFiles):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="fathomline-code-"), name)
    Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table into the scratch folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/fathomline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(discard, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(table: DataFrame) -> None:
    """Remove the scratch table behind a result of ``materialise`` that nothing reads any more."""
    path = getattr(table, "_scratch_path", None)
    if path:
        discard(table.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        pass
