"""Per-key results when a few keys hold most of the rows.

Counts and distinct partners are two-stage mergeable aggregates.  Quantiles are selected exactly without sorting or
gathering a key: every round bins the values still in question, merges the bin counts of all tasks, finds the bin in
which each wanted rank lies and descends into that bin only.  What one key contributes to a round is at most ``bins``
rows per wanted rank, whatever its share of the table.  After the first round only the values of open bins are kept, as
counts, so a value that fills a hot key is one row of each task from then on and the table is not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import materialise

_SMALL_CELLS = 100_000  # open cells (a key and a number each) up to which they are broadcast


def key_profile(df: DataFrame, key: str, partner: str) -> DataFrame:
    """Rows and distinct partners of each key: ``key_value, rows, distinct_partners``.

    Null and empty keys are left out; null partners count as rows but not as partners.  The first aggregate groups by
    (key, partner), which spreads a hot key over all tasks; the second merges partial sums, one row per key and task.
    An empty table gives no rows.
    """
    pairs = (
        df.select(F.col(key).alias("key_value"), F.col(partner).alias("_partner"))
        .where("key_value is not null and key_value <> ''")
        .groupBy("key_value", "_partner")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return pairs.groupBy("key_value").agg(F.sum("_n").alias("rows"), F.count("_partner").alias("distinct_partners"))


def select_ranks(df: DataFrame, key: str, value: str, targets: DataFrame | None = None, probs: Sequence[float] = (), step: int | None = None, bins: int = 4096) -> DataFrame:
    """The values at wanted ranks of each key: ``key, rank, total, value, same`` plus ``prob`` when ``probs`` are given.

    ``value`` is an integer column.  Wanted ranks are ``max(1, ceil(p * rows))`` for each of ``probs``, or the multiples
    of ``step``; ``same`` is the number of rows with that value.  Rows with a null key or value are left out; an empty table gives no rows; repeated values take as many
    ranks as they have rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("long").alias("_v"), F.lit(1).cast("long").alias("_w")).where("_k is not null and _v is not null")
    low, high = rows.agg(F.min("_v"), F.max("_v")).first()
    schema = f"{key} {dict(df.dtypes)[key]}, rank bigint, total bigint, value bigint, same bigint" + (", prob double" if probs else "")
    if low is None:
        return spark.createDataFrame([], schema)
    width = 1
    while (high - low) // width >= bins:
        width *= bins
    cell = lambda w: F.expr(f"cast(floor((cast(_v as decimal(20,0)) - {low}) / {w}) as decimal(20,0))") if high - low >= 2**63 else F.expr(f"(_v - {low}L) div {w}L")
    bound = Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    summary = lambda d, *g: d.groupBy(*g).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hist = materialise(summary(rows.withColumn("_cell", cell(width)), "_k", "_cell"), "histogram")
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(bound), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy("_k")))
    if probs:
        wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_total"))).cast("long").alias("rank")) for p in probs])
        keep = hist.withColumn("_w", F.explode(wanted)).select("*", "_w.prob", "_w.rank").drop("_w").where("rank > _before and rank <= _before + _n")
    else:
        first = f"((_before div {step}) + 1) * {step}"
        keep = hist.where(f"{first} <= _before + _n").withColumn("rank", F.explode(F.expr(f"sequence({first}, _before + _n, {step})"))).withColumn("prob", F.lit(0.0))
    done: list[DataFrame] = []
    narrowed = False
    keep = materialise(keep.select("_k", "_cell", "prob", "rank", "_total", "_lo", "_hi", "_n", (F.col("rank") - F.col("_before")).alias("_rest")), "ranks")
    while True:
        done.append(keep.where("_lo = _hi"))
        open_ = keep.where("_lo <> _hi")
        if width == 1 or open_.isEmpty():
            break
        finer = width // bins if width > bins else 1
        cells = open_.select("_k", "_cell").distinct()
        small = cells.count() <= _SMALL_CELLS
        if not narrowed:
            # no row is shuffled by its key alone: cells that are few come to the rows, else rows are counted by value first
            within = rows.withColumn("_cell", cell(width))
            within = within.join(F.broadcast(cells), ["_k", "_cell"], "left_semi") if small else within.groupBy("_k", "_cell", "_v").agg(F.sum("_w").alias("_w")).join(cells, ["_k", "_cell"], "left_semi")
            rows, narrowed = materialise(within.groupBy("_k", "_v").agg(F.sum("_w").alias("_w")), "open-values"), True
        inside = rows.withColumn("_cell", cell(width)).join(F.broadcast(cells) if small else cells, ["_k", "_cell"], "left_semi").withColumn("_fine", cell(finer))
        fine = summary(inside, "_k", "_cell", "_fine")
        upto = Window.partitionBy("_k", "_cell").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
        fine = fine.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        ranks = open_.select("_k", "_cell", "prob", "rank", "_total", "_rest")
        keep = ranks.join(fine, ["_k", "_cell"]).where("_rest > _before and _rest <= _before + _n")
        keep = materialise(keep.select("_k", F.col("_fine").alias("_cell"), "prob", "rank", "_total", "_lo", "_hi", "_n", (F.col("_rest") - F.col("_before")).alias("_rest")), "ranks")
        width = finer
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(F.col("_k").alias(key), "rank", F.col("_total").alias("total"), F.col("_lo").alias("value"), F.col("_n").alias("same"), "prob")
    return out if probs else out.drop("prob")


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Non-empty keys that hold more than ``share`` of all rows of ``df``: ``key_value, rows``.

    In the order of a hash of the key, such a key covers more than ``share * n`` neighbouring ranks, hence one of the
    ranks that are multiples of that length.  So at most ``1 / share`` ranks are selected from histograms of the hash, and
    those whose value fills more than ``share * n`` rows are the hashes of heavy keys: the distinct keys are never shuffled.
    An exact count of the rows of these hashes names their keys and tells keys of equal hashes apart.
    """
    total = df.count()
    step = int(share * total) + 1
    named = df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("key_value"))
    hashed = named.select(F.lit(0).alias("all"), F.shiftright(F.xxhash64("key_value"), 1).alias("h"))
    ranks = select_ranks(hashed, "all", "h", step=step, bins=1 << 16).where(F.col("same") > F.lit(share) * F.lit(total))
    picks = [r.value for r in ranks.select("value").distinct().collect()]  # at most 1 / share rows
    near = named.where(F.shiftright(F.xxhash64("key_value"), 1).isin(picks)) if picks else named.where("false")
    return near.groupBy("key_value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > F.lit(share) * F.lit(total))
