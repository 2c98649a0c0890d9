"""What an index stores beside its tables, built once per session and state of the tables: terms and centrality."""

from __future__ import annotations

import atexit
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.operators import graph
from fathomline.operators.postings import PostingIndex, read_postings, write_postings
from fathomline.plans.views import now
from fathomline.session import discard, scratch_root

_BUILT: dict[tuple[str, str], str] = {}


def _state(spark: SparkSession, path: str) -> str:
    """A digest of the files of a table with their sizes and times: another state is another index."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _built(spark: SparkSession, label: str, tables: list[str], build: Callable[[str], None]) -> str:
    """Where something made of tables lies; it is made where the session has none of their present state."""
    key = (spark.sparkContext.applicationId, "-".join([label, *[_state(spark, t) for t in tables]]))
    if key not in _BUILT or not _exists(spark, _BUILT[key]):
        path = f"{scratch_root(spark)}/fathomline/{key[0]}-{hashlib.sha1(key[1].encode()).hexdigest()}"
        build(path)
        atexit.register(discard, spark, path)
        _BUILT[key] = path
    return _BUILT[key]


def term_index(spark: SparkSession, sf: str) -> PostingIndex:
    return read_postings(spark, _built(spark, "terms", [f"{sf}/chunks.parquet"], lambda path: write_postings(now(spark, sf, "chunks"), path)))


def centrality(spark: SparkSession, sf: str) -> DataFrame:
    """``id, in_degree, out_degree, cross_pkg_callers, pagerank`` of every node."""
    measure = lambda path: graph.centrality(now(spark, sf, "graph_nodes"), now(spark, sf, "graph_edges")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(_built(spark, "centrality", [f"{sf}/graph_nodes.parquet", f"{sf}/graph_edges.parquet"], measure))


