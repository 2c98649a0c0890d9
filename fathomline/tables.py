"""Access to the stored tables: one Parquet table per relation below a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def newest_row(df: DataFrame, key: str, stamp: str, *columns: str) -> DataFrame:
    """The columns of the row with the largest ``stamp`` of each key.

    Ties go to the larger remaining columns, so the result does not depend on row order.  Null stamps lose against any
    other; null keys form one group.  The aggregate combines map-side, so repeated ids of a hot key are merged before
    the shuffle.
    """
    best = F.max(F.struct(F.col(stamp), *[F.col(c) for c in columns])).alias("_best")
    return df.groupBy(key).agg(best).select(key, f"_best.{stamp}", *[f"_best.{c}" for c in columns])
