"""Reading a project tree, and writing what is computed from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.functions.text import without_comments

FILES = "path string, content string, size bigint, modified timestamp"


IGNORE_FILES = (".gitignore", ".indexignore")


def project_rules(spark: SparkSession, root: str, names: Sequence[str] = IGNORE_FILES) -> list[str]:
    """The lines of the ignore files in the root of a tree, in that order; files that are not there have none."""
    jvm = spark.sparkContext._jvm
    rules: list[str] = []
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            stream = fs.open(at)
            try:
                rules += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return rules


def list_tree(spark: SparkSession, root: str, rules: Sequence[str] = ()) -> DataFrame:
    """``path, size, modified`` of the files that names, rules and sizes let through; no content is read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    below = F.element_at(F.split("path", F.lit(_literal(base)), 2), -1)
    listed = files.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.col("size") <= paths.LARGEST_FILE)
    return listed.where(~paths.is_ignored(F.col("path"), [*paths.IGNORE_PATTERNS, *rules]) & paths.is_indexable(F.col("path")))


def read_tree(spark: SparkSession, root: str, rules: Sequence[str] = (), include_secrets: bool = False, since: Column | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """The files of a tree that are to be indexed: ``path`` below the root, ``content``, ``size``, ``modified``.

    With ``since`` only files modified later are read, with ``only`` just these paths.

    Default ignore rules come first, then ``rules`` (those of the project, later ones win).  Files are listed and read in
    parallel; names, sizes and times filter before any content is read.  Left out: ignored, unknown and large files,
    binary ones, and files with secrets unless they are tests.  Bytes that are no UTF-8 become replacement characters.
    """
    base = root.rstrip("/") + "/"
    reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", "true").load(base) if only is None else reader.load([base + p for p in only])
    if since is not None:
        files = files.where(F.col("modificationTime") > since)  # reaches the scan: other files are not opened
    below = F.element_at(F.split("path", F.lit(_literal(base)), 2), -1)
    listed = files.select(below.alias("path"), "length", "modificationTime", "content").where(F.col("length") <= paths.LARGEST_FILE)
    kept = listed.where(~paths.is_ignored(F.col("path"), [*paths.IGNORE_PATTERNS, *rules]) & paths.is_indexable(F.col("path")))
    text = kept.select("path", F.expr("decode(content, 'UTF-8')").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~paths.looks_binary(F.col("content")))
    return text if include_secrets else text.where(~paths.looks_secret(F.col("path"), F.col("content")))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in text)


def unchanged_files(files: DataFrame, indexed: DataFrame, since: Column) -> DataFrame:
    """Files not modified after the last run that are indexed already: only their ``last_seen_at`` needs to change."""
    return files.where(F.col("modified") <= since).join(indexed.select("path").distinct(), "path", "left_semi")


def export_jsonl(df: DataFrame, path: str, order: str = "id") -> None:
    """One JSON object per row in order of ``order``; null and empty fields are left out."""
    blank = {n for n, t in df.dtypes if t == "string"}
    tidy = df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if c in blank else F.col(c) for c in df.columns])
    tidy.orderBy(order).select(F.to_json(F.struct(*tidy.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def bundle_text(files: DataFrame, strip: bool = False) -> DataFrame:
    """``path, block``: each file under a line with its path; ``strip`` drops blank and comment lines."""
    body = without_comments(F.col("path"), F.col("content")) if strip else F.col("content")
    return files.select("path", F.concat(F.lit("===== "), "path", F.lit(" =====\n"), body, F.lit("" if strip else "\n")).alias("block"))
