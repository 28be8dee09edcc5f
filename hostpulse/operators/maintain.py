"""Retention and load reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prune_history(
    history: DataFrame, *, time_col: str, now: datetime | Column, days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """The rows to keep (at most ``days`` old, the boundary included) and the count of the others.

    Zero or fewer days keep everything.  On a table partitioned by ``event_date`` the predicate on
    the date prunes whole partitions, and only the boundary date is read to be filtered.
    """
    if days <= 0:
        return history, history.limit(0).agg(F.count(F.lit(1)).alias("removed"))
    at = now if isinstance(now, Column) else F.lit(now)
    cutoff = at - F.expr(f"INTERVAL '{days}' DAY")
    old = F.col(time_col) < cutoff
    kept = F.col(time_col) >= cutoff
    if "event_date" in history.columns:
        kept = kept & (F.col("event_date") >= F.to_date(cutoff))
        old = old & (F.col("event_date") <= F.to_date(cutoff))
    removed = history.where(old).agg(F.count(F.lit(1)).alias("removed"))
    return history.where(kept), removed


# Ranges that distinct values are cut into: this many, and each of them again.
_RANGES = 32


def _range_of(value: Column, bounds: Column) -> Column:
    """Number of the range of a value: how many of the ascending ``bounds`` are less, found in two steps."""
    below = lambda part: F.size(F.filter(part, lambda b: b < value))
    every = F.transform(F.sequence(F.lit(1), F.lit(_RANGES - 1)), lambda i: F.get(bounds, i * _RANGES - 1))
    coarse = below(every)
    return coarse * _RANGES + below(F.slice(bounds, coarse * _RANGES + 1, _RANGES - 1))


def nearest_rank(values: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles as rows (metric, value).

    Equal values collapse to one counted row before the shuffle.  The distinct values are cut at their own approximate
    percentiles into ranges of about equally many, however dense they lie; counts are cumulated over the ranges (1,024 rows,
    so that level may be one task), and only the ranges that hold a wanted rank are ranked inside.
    """
    counted = (
        values.where(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shares = [i / _RANGES**2 for i in range(1, _RANGES**2)]
    bounds = counted.agg(F.percentile_approx("value", shares, 10_000)).scalar()
    counted = counted.withColumn("bounds", bounds).withColumn("class", _range_of(F.col("value"), F.col("bounds"))).drop("bounds")
    classes = counted.groupBy("class").agg(F.sum("n").alias("n"))
    below = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bases = classes.select(
        "class",
        "n",
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"),
        F.sum("n").over(everything).alias("total"),
    )
    needed = [F.greatest(F.ceil(F.lit(f) * F.col("total")).cast("long"), F.lit(1).cast("long")) for f in fractions.values()]
    asked = F.lit(False)
    for rank in needed:
        asked = asked | ((rank > F.col("base")) & (rank <= F.col("base") + F.col("n")))
    # at most one range per fraction
    bases = F.broadcast(bases.where(asked).drop("n"))
    inside = (
        Window.partitionBy("class")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.join(bases, "class").withColumn(
        "rank", F.col("base") + F.sum("n").over(inside)
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), rank.alias("needed"))
            for name, rank in zip(fractions, needed)
        ]
    )
    hits = F.filter(
        wanted,
        lambda w: (w["needed"] <= F.col("rank")) & (w["needed"] > F.col("rank") - F.col("n")),
    )
    return ranked.select(F.inline(hits), "value").select("metric", "value")


def latency_report(results: DataFrame, *, elapsed_s: Column | float) -> DataFrame:
    """Load-run report as rows (metric, value).

    ``results`` has ``seconds`` and ``status`` (null: transport failure).  Failures count towards
    throughput but have no status and no latency.  ``elapsed_s`` is the wall time of the run, a
    number or an aggregate over ``results``.
    """
    answered = F.col("status").isNotNull()
    elapsed = elapsed_s if isinstance(elapsed_s, Column) else F.lit(float(elapsed_s))
    totals = results.agg(
        F.count(F.lit(1)).alias("all"),
        F.count(F.when(F.col("status").between(200, 299), True)).alias("accepted"),
        F.count(F.when(~answered, True)).alias("failures"),
        F.max(F.when(answered, F.col("seconds"))).alias("max"),
        elapsed.cast("double").alias("elapsed"),
    ).select(
        F.inline(
            F.array(
                _metric("elapsed_seconds", F.col("elapsed")),
                _metric("events_per_second", F.col("all") / F.col("elapsed")),
                _metric("accepted", F.col("accepted")),
                _metric("transport_failures", F.col("failures")),
                _metric("latency_max", F.col("max")),
            )
        )
    )
    statuses = (
        results.where(answered)
        .groupBy("status")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.concat(F.lit("status_"), F.col("status").cast("string")).alias("metric"), "value")
    )
    percentiles = nearest_rank(
        results.where(answered),
        "seconds",
        {"latency_p50": 0.50, "latency_p95": 0.95, "latency_p99": 0.99},
    )
    return totals.unionByName(statuses).unionByName(percentiles)


def _metric(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))


def http_outcomes(requests: DataFrame) -> DataFrame:
    """Responses by route and status."""
    return requests.groupBy("path", "status").agg(F.count(F.lit(1)).alias("n"))
