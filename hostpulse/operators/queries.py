"""Fleet questions over the telemetry table.

``tel`` is the telemetry DataFrame (``schemas.TELEMETRY``).  Every order has a last tie-break on
``ingest_seq`` or the key, so results are deterministic; "newest" is by event time.  One-row totals
are scalar subqueries, never joins.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse import schemas as S
from hostpulse.functions import whole_seconds_between
from hostpulse.operators.rules import effective_rules, with_effective_rules

def _newest_first() -> list[Column]:
    return [F.desc("event_timestamp"), F.desc("ingest_seq")]


def _instant(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _filtered(
    tel: DataFrame,
    level: str | None,
    host_id: str | None,
    frm: datetime | Column | None,
    to: datetime | Column | None,
) -> DataFrame:
    """Only the given arguments become predicates, so they reach the Parquet scan."""
    if frm is not None and to is not None and not isinstance(frm, Column) and frm > to:
        raise ValueError("frm must not be after to")
    if level is not None:
        tel = tel.where(F.col("level") == level)
    if host_id is not None:
        tel = tel.where(F.col("host_id") == host_id)
    if frm is not None:
        tel = tel.where(F.col("event_timestamp") >= _instant(frm))
    if to is not None:
        tel = tel.where(F.col("event_timestamp") <= _instant(to))
    return tel


def _checked_page(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    if offset < 0:
        raise ValueError("offset must be zero or more")


def find_events(
    tel: DataFrame,
    *,
    level: str | None = None,
    host_id: str | None = None,
    frm: datetime | Column | None = None,
    to: datetime | Column | None = None,
    limit: int = 50,
    offset: int = 0,
    after: tuple[datetime | Column, int | Column] | None = None,
) -> DataFrame:
    """A page of events, newest first, with inclusive time bounds.

    ``after`` is the (event_timestamp, ingest_seq) of the last row of the page before: what follows it is found by a predicate that
    reaches the scan, so that a page far down costs no more than the first.  With ``offset`` a task keeps the skipped rows too.
    """
    _checked_page(limit, offset)
    rows = _filtered(tel, level, host_id, frm, to)
    if after is not None:
        if offset:
            raise ValueError("a page follows either a row or an offset")
        time, seq = (x if isinstance(x, Column) else F.lit(x) for x in (_instant(after[0]), after[1]))
        same = F.col("event_timestamp") == time
        rows = rows.where((F.col("event_timestamp") <= time) & (~same | (F.col("ingest_seq") < seq)))
    return rows.orderBy(*_newest_first()).offset(offset).limit(limit)


def count_events(
    tel: DataFrame,
    *,
    level: str | None = None,
    host_id: str | None = None,
    frm: datetime | Column | None = None,
    to: datetime | Column | None = None,
) -> DataFrame:
    rows = _filtered(tel, level, host_id, frm, to)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def events_page(
    tel: DataFrame,
    *,
    level: str | None = None,
    host_id: str | None = None,
    frm: datetime | Column | None = None,
    to: datetime | Column | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """The page's item columns with ``limit``, ``offset`` and the ``total`` of all matches."""
    chosen = {"level": level, "host_id": host_id, "frm": frm, "to": to}
    items = find_events(tel, **chosen, limit=limit, offset=offset)
    total = count_events(tel, **chosen)
    return items.select(
        "ingest_seq",
        "event_id",
        "host_id",
        "hostname",
        "level",
        F.col("message").alias("msg"),
        F.col("event_timestamp").alias("timestamp"),
        "cpu_usage",
        "ram_usage",
        "disk_usage",
        F.when(F.col("disk_usage").isNotNull(), F.col("disk_path")).alias("disk_path"),
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        total.scalar().alias("total"),
    )


def latest_event(tel: DataFrame) -> DataFrame:
    return tel.orderBy(*_newest_first()).limit(1)


def recent_events(tel: DataFrame, n: int = S.WINDOW) -> DataFrame:
    return tel.orderBy(*_newest_first()).limit(n)


def top_error_messages(tel: DataFrame, *, limit: int = 5) -> DataFrame:
    return (
        tel.where(F.col("level").isin(*S.ERROR_LEVELS))
        .groupBy("message")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "message")
        .limit(limit)
    )


def level_counts(tel: DataFrame, *, host_id: str | None = None) -> DataFrame:
    return (
        _filtered(tel, None, host_id, None, None)
        .groupBy("host_id", "level")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def _rollup(tel: DataFrame) -> DataFrame:
    """Per host the totals and the newest row's values, even where they are null.

    The texts are grouping keys of a first step, so that all its buffers have a fixed width and it
    runs as a hash aggregate over the data; the second step meets a few rows per host.  Newest is by
    (event time, arrival), packed into one wide number for the same reason.
    """
    # Ten to the power of 19 exceeds every arrival number.
    place = F.expr(
        "cast(cast(unix_micros(cast(event_timestamp as timestamp)) as decimal(18, 0)) "
        "* 10000000000000000000BD + ingest_seq as decimal(38, 0))"
    )
    texts = ("hostname", "agent_version", "disk_path")
    per_text = (
        tel.where(F.col("host_id").isNotNull())
        .select(
            "host_id", *texts, "event_timestamp", "queue_depth", "disk_usage", place.alias("place")
        )
        .groupBy("host_id", *texts)
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("event_timestamp").alias("first_seen"),
            F.max("event_timestamp").alias("last_seen"),
            F.max("place").alias("newest_place"),
            F.max_by("queue_depth", "place").alias("queue_depth"),
            F.max_by("disk_usage", "place").alias("disk_usage"),
        )
    )
    readings = ("agent_version", "queue_depth", "disk_usage", "disk_path")
    return (
        per_text.groupBy("host_id")
        .agg(
            F.max("hostname").alias("hostname"),
            F.sum("event_count").alias("event_count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.max_by(F.struct(*readings), "newest_place").alias("newest"),
        )
        .select(
            "host_id",
            "hostname",
            "event_count",
            "first_seen",
            "last_seen",
            *[f"newest.{name}" for name in readings],
        )
    )


def host_rollup(tel: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Per host the totals and newest readings, all hosts; with ``limit`` a page, newest activity first."""
    rollup = _rollup(tel)
    if limit is None:
        return rollup
    return rollup.orderBy(F.desc("last_seen"), "host_id").limit(limit)


def host_lookup(tel: DataFrame, host_id: str) -> DataFrame:
    return _rollup(tel.where(F.col("host_id") == host_id))


def host_listing(
    tel: DataFrame,
    rules: DataFrame,
    *,
    now: datetime | Column,
    defaults: dict[str, float] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The roll-up with display name, seconds of silence and status."""
    hosts = with_effective_rules(
        host_rollup(tel, limit=limit),
        rules,
        spread="host_id",
        defaults=defaults,
        rule_types=(S.AGENT_SILENT,),
    )
    rule = F.col(f"rule_{S.AGENT_SILENT}")
    seconds = F.greatest(
        F.lit(0).cast("long"), whole_seconds_between(F.col("last_seen"), _instant(now))
    )
    minutes = rule["threshold"].cast("long")
    silent = rule["enabled"] & (F.col("silent_seconds") >= minutes * 60)
    return (
        hosts.withColumn("display_name", F.coalesce("hostname", "host_id"))
        .withColumn("silent_seconds", seconds)
        .withColumn("status", F.when(silent, "silent").otherwise("reporting"))
        .drop(f"rule_{S.AGENT_SILENT}")
    )


def host_detail(
    tel: DataFrame,
    rules: DataFrame,
    alerts: DataFrame,
    *,
    host_id: str,
    now: datetime | Column,
    defaults: dict[str, float] | None = None,
    window: int = S.WINDOW,
) -> DataFrame:
    """Everything about one host in one row; empty when the host is unknown."""
    mine = tel.where(F.col("host_id") == host_id)
    listing = host_listing(mine, rules, now=now, defaults=defaults)
    averages = recent_events(mine, window).agg(
        F.struct(
            F.coalesce(F.avg("cpu_usage"), F.lit(0.0)).alias("cpu"),
            F.coalesce(F.avg("ram_usage"), F.lit(0.0)).alias("ram"),
            F.count(F.lit(1)).alias("window"),
        )
    )
    levels = level_counts(mine).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "occurrences"))))
    )
    active = alerts.where((F.col("host_id") == host_id) & (F.col("status") != "RESOLVED")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "last_seen",
                    "alert_key",
                    "alert_type",
                    "status",
                    "message",
                    "first_seen",
                    "occurrence_count",
                )
            ),
            asc=False,
        )
    )
    one_host = tel.sparkSession.range(1).select(F.lit(host_id).alias("host_id"))
    position = F.array_position(F.array(*[F.lit(t) for t in S.RULE_TYPES]), F.col("rule_type"))
    applying = effective_rules(one_host, rules, defaults=defaults).agg(
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        position.alias("place"), "rule_type", "threshold", "enabled", "source"
                    )
                )
            ),
            lambda rule: rule.dropFields("place"),
        )
    )
    return listing.select(
        "*",
        averages.scalar().alias("averages"),
        levels.scalar().alias("levels"),
        active.scalar().alias("alerts"),
        applying.scalar().alias("rules"),
    )


def fleet_summary(
    tel: DataFrame,
    alerts: DataFrame,
    *,
    window: int = S.WINDOW,
) -> DataFrame:
    """One row: totals, the mean of the newest events fleet-wide and the newest event."""
    recent = recent_events(tel, window).agg(
        F.struct(
            F.coalesce(F.avg("cpu_usage"), F.lit(0.0)).alias("cpu"),
            F.coalesce(F.avg("ram_usage"), F.lit(0.0)).alias("ram"),
        ).alias("mean")
    )
    newest = latest_event(tel).select(F.struct(*tel.columns).alias("event"))
    active = alerts.where(F.col("status") != "RESOLVED").agg(F.count(F.lit(1)))
    totals = tel.groupBy("host_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.count("host_id").alias("hosts"),
    )
    return totals.select(
        "total_events",
        active.scalar().alias("active_alerts"),
        "hosts",
        recent.scalar().getField("cpu").alias("average_cpu"),
        recent.scalar().getField("ram").alias("average_ram"),
        newest.scalar().alias("latest_event"),
    )


def telemetry_snapshot(tel: DataFrame, *, window: int = S.WINDOW) -> DataFrame:
    """One row: total stored, the fleet window's size and means, and the top error messages.

    The fleet window is the newest ``window`` events by time among every host's last ``window``
    arrivals.  ``row_number() <= window`` is limited before the shuffle, so a hot host sends only a
    few rows per input partition.
    """
    arrival = Window.partitionBy("host_id").orderBy(F.desc("ingest_seq"))
    tails = tel.withColumn("rn", F.row_number().over(arrival)).where(F.col("rn") <= window)
    fleet = tails.orderBy(*_newest_first()).limit(window)
    errors = top_error_messages(tel).agg(
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct((-F.col("occurrences")).alias("place"), "message", "occurrences")
                )
            ),
            lambda error: error.dropFields("place"),
        )
    )
    total = tel.agg(F.count(F.lit(1)))
    return fleet.agg(
        F.count(F.lit(1)).alias("window_size"),
        F.coalesce(F.avg("cpu_usage"), F.lit(0.0)).alias("average_cpu"),
        F.coalesce(F.avg("ram_usage"), F.lit(0.0)).alias("average_ram"),
    ).select(
        total.scalar().alias("total_events"),
        "window_size",
        "average_cpu",
        "average_ram",
        errors.scalar().alias("top_errors"),
    )


def fleet_heartbeat(tel: DataFrame, alerts: DataFrame) -> DataFrame:
    hosts = tel.select("host_id").distinct().agg(F.count("host_id").alias("hosts"))
    active = alerts.where(F.col("status") != "RESOLVED").agg(F.count(F.lit(1)))
    return hosts.select("hosts", active.scalar().alias("active_alerts"))


def fullest_disk(rollup: DataFrame) -> DataFrame:
    """The host with the worst known disk; the more recently seen host on a tie."""
    return (
        rollup.where(F.col("disk_usage").isNotNull())
        .orderBy(F.desc("disk_usage"), F.desc("last_seen"), "host_id")
        .limit(1)
        .select("host_id", "hostname", "disk_usage", "disk_path")
    )
