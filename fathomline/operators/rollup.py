"""Roll-ups: the newest row per key, hashes and texts of packages, and the order of a guide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import paths


def newest_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; each task passes on only its own first row."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def package_keys(chunks: DataFrame, version: str = "v1") -> DataFrame:
    """``dir, files, package_sha``: the hash of the sorted file hashes of a directory, tests left out unless all are.

    A file is hashed over its sorted chunk hashes first (a file of bounded size has few).  The files of a directory are
    sorted by the shuffle, which spills, and hashed as a stream: a directory of any size takes the memory of one batch.
    """
    rows = chunks.where("not endswith(kind, '_summary') and content_sha1 is not null and path is not null").select("path", "content_sha1").distinct()
    files = rows.groupBy("path").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("content_sha1")), ":")).alias("file_sha"))
    marked = files.select(paths.dirname(F.col("path")).alias("dir"), paths.is_test(F.col("path")).alias("test"), "file_sha")
    seed = f"{version}\0".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = [None, 0, None, False]  # directory, files, running hash, whether they are tests
        done: list[tuple] = []

        def close() -> None:
            if state[0] is not None:
                done.append((state[0], state[1], state[2].hexdigest()))

        for batch in batches:
            for name, test, sha in zip(*(c.to_pylist() for c in batch.columns)):
                if name != state[0]:
                    close()
                    state[:] = [name, 0, hashlib.sha1(seed), test]
                elif test != state[3]:
                    continue  # tests of a directory that has other files
                state[2].update((b":" if state[1] else b"") + sha.encode())
                state[1] += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.string()))], names=["dir", "files", "package_sha"])
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.string()))], names=["dir", "files", "package_sha"])

    return marked.repartition("dir").sortWithinPartitions("dir", "test", "file_sha").mapInArrow(run, "dir string, files bigint, package_sha string")


def joined_summaries(summaries: DataFrame, group: Column, separator: str = "\n\n") -> DataFrame:
    """``grp, summaries, text``: the summaries of a group joined in order of path and id.

    The text of a group is one value, so groups are meant to be parts of a project."""
    rows = summaries.where("content is not null").select(group.alias("grp"), F.struct("path", "id", "content").alias("s"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("summaries"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["content"]), separator).alias("text"))


def contents_groups(weights: DataFrame) -> DataFrame:
    """``family, dir, place, family_weight, family_first``: directories by leading segment, heaviest first.

    Families are ordered by their best entry (its weight, then its name), which is the order of first appearance.
    """
    rows = weights.select(F.substring_index("dir", "/", 1).alias("family"), "dir", "weight")
    order = Window.partitionBy("family").orderBy(F.desc("weight"), "dir")
    best = F.first(F.struct("weight", "dir")).over(order)
    return rows.select("family", "dir", F.row_number().over(order).cast("bigint").alias("place"), best["weight"].alias("family_weight"), best["dir"].alias("family_first"))


def averages(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, rows, mean, median`` of each group; null values count as rows only.  Medians merge counts of distinct values."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def looks_truncated(text: Column) -> Column:
    """Whether a summary was cut off: a bullet begun and left, an odd number of backticks or of bold marks.  Empty texts are whole."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    odd = lambda mark: ((F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit("")))) / len(mark)).cast("int") % 2 == 1
    return bare.endswith("- **") | bare.endswith("- *") | odd("`") | odd("**")


def summarised_packages(summaries: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, dir, weight`` of package summaries by the summed rank of their directory, 0 where the graph has none.

    ``summaries(id, path)`` name their directory, the root as '' or '.'; ``weights(dir, weight)``.  Directories of test
    data are left out.
    """
    rows = summaries.select("id", F.when(F.coalesce("path", F.lit("")) == "", ".").otherwise(F.col("path")).alias("dir"))
    return rows.where(~F.col("dir").rlike(r"(?:^|/)testdata(?:/|$)")).join(weights, "dir", "left").select("id", "dir", F.coalesce("weight", F.lit(0.0)).alias("weight"))
