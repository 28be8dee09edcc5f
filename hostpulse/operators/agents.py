"""What agents report about themselves: disks, forwarding, the local queue, delivery health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.functions import micros
from hostpulse.operators.hot_keys import TARGET_ROWS, earlier_chunks, split_hot

MICROS_PER_MINUTE = 60_000_000


def fullest_mount(mounts: DataFrame, *, paths: list[str] | None = None) -> DataFrame:
    """Per (host, sample) the fullest readable mount; null when none is readable.

    Mounts without a size or with an unusable percentage are skipped, percentages are clamped to
    0-100, and the first listed mount wins a tie.
    """
    used = F.col("used")
    readable = (
        (F.col("total") != 0)
        & used.isNotNull()
        & ~F.isnan(used)
        & (F.abs(used) != F.lit(float("inf")))
    )
    if paths:
        readable = readable & F.col("path").isin(*paths)
    percent = F.greatest(F.least(used, F.lit(100.0)), F.lit(0.0))
    place = F.when(readable, F.struct(percent.alias("percent"), (-F.col("ord")).alias("place")))
    best = F.max_by(F.struct(percent.alias("percent"), "path"), place)
    return (
        mounts.groupBy("host_id", "sample")
        .agg(best.alias("best"))
        .select(
            "host_id",
            "sample",
            F.col("best.percent").alias("disk_usage"),
            F.col("best.path").alias("disk_path"),
        )
    )


def forward_outcome(status: Column, queue_full: Column) -> Column:
    """delivered, queued, failed or rejected; no response counts as retryable."""
    retryable = status.isNull() | (status >= 500) | (status == 429)
    return (
        F.when(status.between(200, 299), "delivered")
        .when(retryable & queue_full, "failed")
        .when(retryable, "queued")
        .otherwise("rejected")
    )


def forward_outcomes(attempts: DataFrame) -> DataFrame:
    """Add ``outcome``; ``queue_full`` (optional) says the local queue could not take the event."""
    full = F.lit(False)
    if "queue_full" in attempts.columns:
        full = F.coalesce("queue_full", F.lit(False))
    return attempts.withColumn("outcome", forward_outcome(F.col("status"), full))


def retry_outcome(attempts: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Per event the first answer below 500 within the tries, else the last failure.

    ``attempts`` has ``event_id``, ``attempt`` and ``status`` (null: no response).
    """
    answered = F.col("status") < 500
    tries = F.col("attempt")
    return (
        attempts.where(tries <= max_attempts)
        .groupBy("event_id")
        .agg(
            F.min_by("status", F.when(answered, tries)).alias("answer"),
            F.min(F.when(answered, tries)).alias("answered_at"),
            F.max_by("status", "attempt").alias("last_status"),
            F.max("attempt").alias("last_attempt"),
        )
        .select(
            "event_id",
            F.coalesce("answer", "last_status").alias("status"),
            F.coalesce("answered_at", "last_attempt").alias("attempts"),
            F.col("answered_at").isNotNull().alias("answered"),
        )
    )


def queue_depth_timeline(
    queue_events: DataFrame, *, capacity: int = 1000, target: int | None = TARGET_ROWS
) -> DataFrame:
    """Queue depth after every event and whether an enqueue was dropped for lack of room.

    ``queue_events`` has ``host_id``, ``at``, the unique order ``seq`` and ``change``: +1 for an
    event to queue, -1 for a queued event that left.  With ``total`` the running sum of all changes,
    the queue has dropped ``max(0, highest total so far - capacity)`` events, because a drop happens
    exactly when the total passes its earlier excess; the depth is the total less the drops.
    """
    every, only_hot = split_hot(queue_events, "host_id", "seq", target=target)
    chunk = ["host_id", "chunk"]

    order = Window.partitionBy(*chunk).orderBy(F.asc_nulls_first("seq"))
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    carried = {"base": F.lit(None).cast("long"), "peak": F.lit(None).cast("long")}
    seeded = every.withColumns(carried)
    if only_hot is not None:
        per_chunk = (
            only_hot.withColumn("total", F.sum("change").over(through))
            .groupBy(*chunk)
            .agg(F.sum("change").alias("sum"), F.max("total").alias("top"))
        )
        before = earlier_chunks("host_id")
        seeds = (
            per_chunk.withColumn("base", F.sum("sum").over(before))
            .withColumn("peak", F.max(F.coalesce("base", F.lit(0)) + F.col("top")).over(before))
            .where(F.col("base").isNotNull())
            .select(*chunk, "base", "peak")
        )
        seeded = seeded.unionByName(seeds, allowMissingColumns=True)
    step = F.coalesce("base", F.col("change").cast("long"))
    reached = F.greatest(F.coalesce("peak", "total"), "total")

    def excess(frame: Window) -> Column:
        return F.greatest(F.coalesce(F.max(reached).over(frame), F.lit(0)) - capacity, F.lit(0))

    return (
        seeded.withColumn("total", F.sum(step).over(through))
        .select("*", excess(through).alias("excess"), excess(earlier).alias("excess_before"))
        .where(F.col("seq").isNotNull())
        .select(
            *queue_events.columns,
            (F.col("total") - F.col("excess")).alias("depth"),
            (F.col("excess") > F.col("excess_before")).alias("dropped"),
        )
    )


def delivery_stalls(
    attempts: DataFrame,
    ticks: DataFrame,
    *,
    stall_minutes: int = 5,
    target: int | None = TARGET_ROWS,
) -> DataFrame:
    """One row per change of delivery health: ``delivery_stalled`` or ``delivery_recovered``.

    ``attempts`` has ``host_id``, ``at``, ``outcome``; ``ticks`` the check times ``host_id``, ``at``.
    Stalled means the last attempt that was not rejected failed and the last success (or, before
    any, the host's first row) is at least ``stall_minutes`` old.  An attempt at the very time of a
    check counts before it.
    """
    told = attempts.where(F.col("outcome") != "rejected").select(
        "host_id",
        "at",
        F.lit(False).alias("tick"),
        (F.col("outcome") != "delivered").alias("failed"),
    )
    rows = (
        told.unionByName(
            ticks.select(
                "host_id", "at", F.lit(True).alias("tick"), F.lit(None).cast("boolean").alias("failed")
            )
        )
        .withColumn("at_us", micros(F.col("at")))
        .withColumn("ok_at", F.when(~F.col("failed"), F.col("at_us")))
    )
    every, only_hot = split_hot(rows, "host_id", "at_us", target=target, max_span=None, flag="hot")
    chunk = ["host_id", "chunk"]
    seeded = every.withColumn("start", F.col("at_us"))
    if only_hot is not None:
        order = F.struct("at_us", F.col("tick"), F.col("failed"))
        per_chunk = only_hot.groupBy(*chunk).agg(
            F.max_by("failed", F.when(F.col("failed").isNotNull(), order)).alias("failed"),
            F.max("ok_at").alias("ok_at"),
            F.min("at_us").alias("start"),
        )
        before = earlier_chunks("host_id")
        seeds = per_chunk.select(
            *chunk,
            F.last("failed", ignorenulls=True).over(before).alias("failed"),
            F.max("ok_at").over(before).alias("ok_at"),
            F.min("start").over(before).alias("start"),
        ).where(F.col("start").isNotNull())
        seeded = seeded.unionByName(
            seeds.withColumn("tick", F.lit(False)).withColumn("hot", F.lit(True)), allowMissingColumns=True
        )
    # the flag is a key of the window, so that a filter on it goes below
    place = ["host_id", "chunk", "hot"]
    through = (
        Window.partitionBy(*place)
        .orderBy(F.asc_nulls_first("at_us"), "tick", "failed")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    gap = F.col("at_us") - F.coalesce("last_ok", "first_start")
    checks = (
        seeded.select(
            "*",
            F.last("failed", ignorenulls=True).over(through).alias("last_failed"),
            F.max("ok_at").over(through).alias("last_ok"),
            F.min("start").over(through).alias("first_start"),
        )
        .where(F.col("tick"))
        .withColumn("gap", gap)
        .withColumn(
            "stalled",
            F.coalesce("last_failed", F.lit(False))
            & (F.col("gap") >= stall_minutes * MICROS_PER_MINUTE),
        )
    )
    previous = F.lag("stalled").over(Window.partitionBy(*place).orderBy("at_us"))
    if only_hot is None:
        was = checks.withColumn("was", F.coalesce(previous, F.lit(False)))
    else:
        # the first check of a chunk is compared with the last one of the chunks before it
        last = checks.where("hot").groupBy(*chunk).agg(F.max_by("stalled", "at_us").alias("verdict"))
        carried = last.select(*chunk, F.last("verdict", ignorenulls=True).over(earlier_chunks("host_id")).alias("verdict"))
        borders = carried.where("verdict")
        was = checks.join(borders, chunk, "left").withColumn("was", F.coalesce(previous, "verdict", F.lit(False)))
    return (
        was.where(F.col("stalled") != F.col("was"))
        .select(
            "host_id",
            "at",
            F.when(F.col("stalled"), "delivery_stalled")
            .otherwise("delivery_recovered")
            .alias("event"),
            F.expr("cast(gap div 1000000 as bigint)").alias("stalled_seconds"),
        )
    )


def forward_duration(attempts: DataFrame) -> DataFrame:
    """Forwarding seconds and count per host."""
    return attempts.groupBy("host_id").agg(
        F.sum("seconds").alias("total_seconds"), F.count(F.lit(1)).alias("n")
    )


def agent_counters(
    captures: DataFrame, outcomes: DataFrame, queue: DataFrame, replays: DataFrame | None = None
) -> DataFrame:
    """The agent's counters in one table (counter, label, n).

    Captures by level, forwards by outcome, queue writes and drops (``queue_depth_timeline``), and
    queued events that were refused for good when they were replayed (``replays`` with outcome).
    """
    parts = [
        captures.select(F.lit("captured").alias("counter"), F.col("level").alias("label")),
        outcomes.select(F.lit("forwarded").alias("counter"), F.col("outcome").alias("label")),
        queue.where(F.col("change") > 0).select(
            F.when(F.col("dropped"), "queue_dropped").otherwise("queue_written").alias("counter"),
            F.lit("").alias("label"),
        ),
    ]
    if replays is not None:
        parts.append(
            replays.where(F.col("outcome") == "rejected").select(
                F.lit("queue_rejected").alias("counter"), F.lit("").alias("label")
            )
        )
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log.groupBy("counter", "label").agg(F.count(F.lit(1)).alias("n"))


def reconcile_delivery(
    captured: DataFrame, stored: DataFrame, pending: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Captured ids that are neither stored nor pending, and the totals in one row.

    All sides are reduced to distinct ids first, so the joins meet unique keys only.
    """
    ids = captured.select("event_id").distinct()
    kept = stored.select("event_id").distinct()
    waiting = pending.select("event_id").distinct()
    lost = ids.join(kept, "event_id", "left_anti").join(waiting, "event_id", "left_anti")

    def size(of: DataFrame) -> Column:
        return of.agg(F.count(F.lit(1))).scalar()

    totals = ids.agg(F.count(F.lit(1)).alias("captured")).select(
        "captured",
        size(kept).alias("stored"),
        size(waiting).alias("pending"),
        size(lost).alias("lost"),
    )
    return lost, totals
