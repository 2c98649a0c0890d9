"""Mixing sources to target weights by entropy balancing.

The wanted mixture is the one closest to using every document once (in relative entropy) that meets the token target of
each source and uses no document more often than allowed.  Its dual is convex, and its solution tilts the rate of a
document exponentially in its tokens: ``rate = min(max_repeats, exp(lambda * tokens / mean))``.  Newton steps on the
lambdas either meet the targets or arrive at the end of the domain, where every document is used as often as allowed; a
source whose gradient is still negative there has no solution and falls short.  What those cannot give can be spread over
the open sources in proportion to their weights, which are then solved for their larger shares.  The steps are Spark
aggregates over the histogram (source, tokens) -> documents, which tasks merge before anything is shuffled; only one row
per wanted source reaches the driver.  Rates become whole copies by a hash of the document id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import materialise

_TOLERANCE = 1e-9
_NARROW = 1e-13  # a bracket that floating point does not halve any more
_MARGIN = 1 + 1e-9  # puts the ends of the domain past the rounding of log() and exp()


def source_name(column: str) -> Column:
    """Sources without letter case and padding; null stays null."""
    return F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def token_histogram(tokens: DataFrame) -> DataFrame:
    """``source, tokens, docs`` of rows (source, tokens); sources are normalised, null is a source of its own."""
    return tokens.select(source_name("source").alias("source"), "tokens").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("docs"))


def _gradient(histogram: DataFrame, plan: list[dict]) -> dict[str, tuple[float, float]]:
    """Tokens that the tilts of some sources give, and their slope, from one aggregate over the histogram."""
    spark = histogram.sparkSession
    now = spark.createDataFrame([(r["source"], r["tilt"], r["mean"], float(r["max_repeats"])) for r in plan], "source string, tilt double, mean double, cap double")
    bound = F.broadcast(now)  # one row per source of the target table
    rate = F.exp(F.least(F.col("tilt") * F.col("tokens") / F.col("mean"), F.lit(700.0)))
    mass = F.col("docs") * F.col("tokens")
    sums = histogram.join(bound, "source").groupBy("source").agg(
        F.sum(mass * F.least(rate, F.col("cap"))).alias("got"), F.sum(F.when(rate < F.col("cap"), mass * F.col("tokens") / F.col("mean") * rate).otherwise(0.0)).alias("slope")
    )
    return {s.source: (s.got, s.slope) for s in sums.collect()}


def bounds(histogram: DataFrame, targets: DataFrame) -> list[dict]:
    """The ends of the dual of each wanted source, one dictionary per row of ``targets`` (a table of fixed size).

    ``own_tokens``: tokens of the source, each document once; ``target_tokens``: weight times all tokens of the corpus;
    ``most_tokens``: what the source gives where every document is used ``max_repeats`` times; ``least_tokens``: those of its
    shortest document that has any, which is the last to reach its cap; ``falls_short``: the
    gradient there, ``most_tokens - target_tokens``, is negative, so the dual has no solution.  Sources without documents
    fall short if their weight is positive; null weights or repeats count as 0; a source named twice has its weights added
    and its larger cap.
    """
    wanted = targets.select(source_name("source").alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    least = F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least_tokens")
    sums = histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("own_tokens"), F.sum("docs").alias("docs"), least)
    # every source of the corpus counts for the total, wanted or not; one row comes back per wanted source
    total = sums.agg(F.coalesce(F.sum("own_tokens"), F.lit(0)).alias("total_tokens"))
    own = wanted.join(sums, "source", "left").crossJoin(F.broadcast(total))
    rows = [r.asDict() for r in own.select("source", "weight", "max_repeats", "total_tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own_tokens", "docs", "least_tokens")]).collect()]
    for r in rows:
        r["target_tokens"] = r["weight"] * r["total_tokens"]
        r["most_tokens"] = r["max_repeats"] * r["own_tokens"]
        r["falls_short"] = r["most_tokens"] - r["target_tokens"] < 0
        r["mean"] = max(1.0, r["own_tokens"] / max(1, r["docs"]))
    return rows


def _spread(rows: list[dict]) -> None:
    """Changes ``planned_tokens`` to all that a source has where it falls short, and a share of the rest by weight where it does not.

    A source that cannot give its new share falls short of that one as well, so this goes on until none is left.
    """
    total = rows[0]["total_tokens"] if rows else 0
    wanted = sum(r["target_tokens"] for r in rows)
    short = [r for r in rows if r["falls_short"]]
    while True:
        rest = wanted - sum(r["most_tokens"] for r in short)
        open_ = [r for r in rows if r not in short and r["weight"] > 0]
        weight = sum(r["weight"] for r in open_)
        for r in rows:
            r["planned_tokens"] = float(r["most_tokens"]) if r in short else rest * r["weight"] / weight if weight > 0 and r["weight"] > 0 else 0.0
        more = [r for r in open_ if r["planned_tokens"] > r["most_tokens"]]
        if not more or total == 0:
            return
        short += more


def _search(histogram: DataFrame, rows: list[dict]) -> None:
    """Newton steps from ``tilt`` to the tilts that give ``planned_tokens``, for all rows in the same aggregates.

    Sets ``tilt``, ``steps``, ``converged`` and ``solved``; the latter is false where the gradient is negative at the end of
    the domain.  A source that is below its planned tokens is taken to that end as soon as a step leads there or does not
    halve the gap, and before a tilt just below the planned tokens is accepted.  Once a solution is known to exist, a step
    that leaves the bracket or does not halve the gap is replaced by halving the bracket, so the search ends.
    """
    for r in rows:
        unit, planned, own = r["mean"] / max(1, r["least_tokens"]), r["planned_tokens"], r["own_tokens"]
        # at the one end every document is at its cap, at the other not even the shortest ones give more than is planned
        r["end"] = r["high"] = unit * math.log(max(1, r["max_repeats"])) * _MARGIN
        r["low"] = unit * min(0.0, math.log(planned) - math.log(own)) * _MARGIN if planned > 0 and own > 0 else 0.0
        r["tilt"] = min(max(r["tilt"], r["low"]), r["end"]) if planned > 0 else r["end"]
        r["solved"], r["near"], r["gap"], r["open"], r["converged"] = None, None, math.inf, True, True
    while active := [r for r in rows if r["open"]]:
        found = _gradient(histogram, active)
        for r in active:
            got, slope = found.get(r["source"], (0.0, 0.0))  # a source without documents gives nothing
            gap, within = got - r["planned_tokens"], _TOLERANCE * r["planned_tokens"]
            r["steps"] += 1
            if r["tilt"] >= r["end"]:
                r["solved"] = not gap < 0
            elif gap > within:
                r["solved"] = True
            if abs(gap) <= within:
                r["near"] = r["tilt"]
            if r["solved"] is False or (r["solved"] and (r["near"] is not None or r["planned_tokens"] <= 0)):
                r["tilt"] = r["tilt"] if r["near"] is None else r["near"]
                r["open"] = False
                continue
            stalled = abs(gap) > r["gap"] / 2
            r["gap"] = abs(gap)
            r["low" if gap < 0 else "high"] = r["tilt"]
            step = r["tilt"] - gap / slope if slope > 0 else math.nan
            if r["solved"] is None:
                r["tilt"] = step if r["near"] is None and not stalled and r["tilt"] < step < r["end"] else r["end"]
                continue
            # Newton where it stays inside the bracket, else halving; both ends of the bracket close in on the solution
            r["tilt"] = step if r["low"] < step < r["high"] and not stalled else (r["low"] + r["high"]) / 2
            if r["high"] - r["low"] < _NARROW * max(1.0, abs(r["tilt"])):
                r["open"], r["converged"] = False, abs(gap) <= 1e-6 * r["planned_tokens"]


def balance(histogram: DataFrame, targets: DataFrame, spread: bool = False) -> list[dict]:
    """``bounds`` with the solution of each source: ``planned_tokens``, ``tilt``, ``steps`` and ``converged``.

    Every source is solved for its target tokens; ``falls_short`` are those whose search ends without a solution.
    Planned are the target tokens, or all that a source has where it falls short; with ``spread`` the open sources share
    what is missing by their weights, so that the whole keeps its size and they keep their proportions, and are solved
    again from the tilts found.  The tilt meets the planned tokens to a relative 1e-9, and ``converged`` is false should
    it not have met them.  It is infinite where a source gives all or nothing.
    """
    rows = bounds(histogram, targets)
    for r in rows:
        # with a tilt of 0 every document is used once (or as often as the cap allows)
        r["planned_tokens"], r["tilt"], r["steps"] = float(r["target_tokens"]), 0.0, 0
    _search(histogram, rows)
    for r in rows:
        r["falls_short"] = r["solved"] is False
        if r["falls_short"]:
            r["planned_tokens"] = float(r["most_tokens"])
    if spread:
        _spread(rows)
        _search(histogram, [r for r in rows if 0 < r["planned_tokens"] < r["most_tokens"] and abs(r["planned_tokens"] - r["target_tokens"]) > _TOLERANCE * r["target_tokens"]])
    for r in rows:
        if r["planned_tokens"] <= 0:
            r["tilt"] = -math.inf
        elif r["planned_tokens"] >= r["most_tokens"] or r["tilt"] >= r["end"]:
            r["tilt"] = math.inf
    return rows


def copies(documents: DataFrame, key: str, plan: list[dict]) -> DataFrame:
    """``documents`` (with source and tokens) plus ``copies``: how often each document of a wanted source is used.

    Copies are the floor of the rate, and one more if a hash of ``key`` falls below the fraction: the same document gets
    the same number in every run.  Documents of other sources are left out.
    """
    spark = documents.sparkSession
    rows = [(r["source"], float(r["tilt"]), float(r["mean"]), int(r["max_repeats"])) for r in plan]
    bound = F.broadcast(spark.createDataFrame(rows, "_source string, _tilt double, _mean double, _cap int"))
    tilted = documents.withColumn("_source", source_name("source")).join(bound, "_source")
    rate = F.when(F.col("_tilt") == -math.inf, 0.0).when(F.col("_tilt") == math.inf, F.col("_cap").cast("double")).otherwise(F.least(F.exp(F.least(F.col("_tilt") * F.col("tokens") / F.col("_mean"), F.lit(700.0))), F.col("_cap").cast("double")))
    coin = (F.xxhash64(key) / F.lit(2.0**64)) + 0.5
    return tilted.withColumn("_rate", rate).withColumn("copies", (F.floor("_rate") + (coin < F.col("_rate") - F.floor("_rate")).cast("int")).cast("int")).drop("source", "_tilt", "_mean", "_cap", "_rate").withColumnRenamed("_source", "source")


def mixture_report(documents: DataFrame, key: str, plan: list[dict]) -> DataFrame:
    """Per wanted source: weight, own, target and planned tokens, tokens and share reached by whole copies, documents used, and
    whether its tilt converged."""
    spark = documents.sparkSession
    chosen = materialise(copies(documents, key, plan).groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("reached_tokens"), F.sum((F.col("copies") > 0).cast("long")).alias("docs_used"), F.max("copies").alias("most_copies")), "mixture")
    rows = [(r["source"], r["weight"], r["max_repeats"], int(r["own_tokens"]), r["target_tokens"], r["planned_tokens"], r["falls_short"], r["converged"]) for r in plan]
    base = spark.createDataFrame(rows, "source string, weight double, max_repeats int, own_tokens bigint, target_tokens double, planned_tokens double, falls_short boolean, converged boolean")
    joined = base.join(chosen, "source", "left").na.fill(0, ["reached_tokens", "docs_used", "most_copies"])
    everything = chosen.agg(F.sum("reached_tokens").alias("_all"))
    return joined.crossJoin(F.broadcast(everything)).withColumn("share", F.col("reached_tokens") / F.col("_all")).drop("_all")
