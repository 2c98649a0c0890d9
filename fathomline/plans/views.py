"""The relations that queries share: the newest row of each id, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.tables import table


def now(spark: SparkSession, sf: str, name: str, key: str = "id") -> DataFrame:
    """The newest row of each id of a table; null ids are left out."""
    newest = Window.partitionBy(key).orderBy(F.desc("last_seen_at"))
    return table(spark, sf, name).where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def sql_now(name: str, alias: str) -> str:
    return f"{alias} as (select * from {name} where id is not null qualify row_number() over (partition by id order by last_seen_at desc) = 1)"


CHUNKS, NODES, EDGES = sql_now("chunks", "ch"), sql_now("graph_nodes", "nd"), sql_now("graph_edges", "ed")
