"""Registered event and fleet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.operators import queries as Q
from hostpulse.plans import fixtures
from hostpulse.plans.checks import NOW, check
from hostpulse.plans.lifecycle import alerts_table
from hostpulse.plans.registry import query

_EVENT = (
    "event_id, host_id, hostname, level, message, event_timestamp, cpu_usage, ram_usage, "
    "disk_usage, disk_path"
)
EVENT_COLUMNS = _EVENT.split(", ")
HOST_COLUMNS = [
    "host_id",
    "hostname",
    "event_count",
    "first_seen",
    "last_seen",
    "agent_version",
    "queue_depth",
    "disk_usage",
    "disk_path",
]
_HOST = ", ".join(HOST_COLUMNS)
FROM, TO = "2024-01-05 00:00:00", "2024-01-25 12:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def tel(spark, sf):
    return fixtures.load(spark, sf, "telemetry")


@query(
    "find_events",
    check(
        f"SELECT {_EVENT} FROM telemetry WHERE level = 'ERROR' AND event_timestamp >= "
        f"TIMESTAMP '{FROM}' AND event_timestamp <= TIMESTAMP '{TO}' "
        "ORDER BY event_timestamp DESC, ingest_seq DESC LIMIT 100 OFFSET 20"
    ),
)
def _(spark, sf):
    page = Q.find_events(
        tel(spark, sf), level="ERROR", frm=at(FROM), to=at(TO), limit=100, offset=20
    )
    return page.select(*EVENT_COLUMNS)


@query(
    "count_events",
    check(
        "SELECT count(*) AS total FROM telemetry WHERE host_id = 'host-3' "
        f"AND event_timestamp >= TIMESTAMP '{FROM}'"
    ),
)
def _(spark, sf):
    return Q.count_events(tel(spark, sf), host_id="host-3", frm=at(FROM))


@query(
    "find_events_after",
    check("""
SELECT ingest_seq, event_id, event_timestamp FROM telemetry
ORDER BY event_timestamp DESC, ingest_seq DESC LIMIT 50 OFFSET 150"""),
)
def _(spark, sf):
    """The fourth page, each found from the last row of the one before."""
    rows, after = tel(spark, sf), None
    for _ in range(3):
        page = Q.find_events(rows, after=after)
        last = page.orderBy("event_timestamp", "ingest_seq").limit(1)
        after = tuple(last.select(c).scalar() for c in ("event_timestamp", "ingest_seq"))
    return Q.find_events(rows, after=after).select("ingest_seq", "event_id", "event_timestamp")


@query(
    "events_page",
    check("""
SELECT event_id, host_id, hostname, level, message AS msg, event_timestamp AS "timestamp",
  cpu_usage, ram_usage, disk_usage, CASE WHEN disk_usage IS NOT NULL THEN disk_path END AS disk_path,
  CAST(50 AS INTEGER) AS "limit", CAST(10 AS INTEGER) AS "offset",
  (SELECT count(*) FROM telemetry WHERE level = 'CRITICAL') AS total
FROM telemetry WHERE level = 'CRITICAL' ORDER BY event_timestamp DESC, ingest_seq DESC
LIMIT 50 OFFSET 10"""),
)
def _(spark, sf):
    return Q.events_page(tel(spark, sf), level="CRITICAL", offset=10).drop("ingest_seq")


@query(
    "latest_event",
    check(
        f"SELECT {_EVENT} FROM telemetry ORDER BY event_timestamp DESC, ingest_seq DESC LIMIT 1"
    ),
)
def _(spark, sf):
    return Q.latest_event(tel(spark, sf)).select(*EVENT_COLUMNS)


@query(
    "recent_events",
    check(
        f"SELECT {_EVENT} FROM telemetry ORDER BY event_timestamp DESC, ingest_seq DESC LIMIT 5"
    ),
)
def _(spark, sf):
    return Q.recent_events(tel(spark, sf)).select(*EVENT_COLUMNS)


@query(
    "top_error_messages",
    check("""
SELECT message, count(*) AS occurrences FROM telemetry WHERE level IN ('ERROR', 'CRITICAL')
GROUP BY message ORDER BY count(*) DESC, message LIMIT 5"""),
)
def _(spark, sf):
    return Q.top_error_messages(tel(spark, sf))


@query(
    "level_counts",
    check(
        "SELECT host_id, level, count(*) AS occurrences FROM telemetry GROUP BY host_id, level"
    ),
)
def _(spark, sf):
    return Q.level_counts(tel(spark, sf))


@query("host_rollup", check(f"SELECT {_HOST} FROM hosts_all"))
def _(spark, sf):
    return Q.host_rollup(tel(spark, sf), limit=None)


@query("host_lookup", check(f"SELECT {_HOST} FROM hosts_all WHERE host_id = 'host-7'"))
def _(spark, sf):
    return Q.host_lookup(tel(spark, sf), "host-7")


_LISTING = f"""
SELECT h.*, coalesce(h.hostname, h.host_id) AS display_name,
  greatest(0, (epoch_us({NOW}) - epoch_us(h.last_seen)) // 1000000) AS silent_seconds,
  CASE WHEN r.enabled AND (epoch_us({NOW}) - epoch_us(h.last_seen)) // 1000000
      >= CAST(floor(r.threshold) AS BIGINT) * 60 THEN 'silent' ELSE 'reporting' END AS status
FROM hosts_all h JOIN effective r ON r.host_id = h.host_id AND r.rule_type = 'AGENT_SILENT'
"""


@query("host_listing", check(_LISTING))
def host_listing(spark, sf):
    return Q.host_listing(tel(spark, sf), fixtures.rules(spark, sf), now=fixtures.now())


@query(
    "host_detail",
    check(f"""
SELECT l.*, a.average_cpu, a.average_ram, a.window_size,
  (SELECT count(*) FROM telemetry WHERE host_id = 'host-2' AND level = 'ERROR') AS errors,
  (SELECT count(*) FROM alerts WHERE host_id = 'host-2' AND status <> 'RESOLVED') AS active_alerts,
  (SELECT string_agg(rule_type || ':' || source || ':' || enabled, ',' ORDER BY rule_type)
    FROM effective WHERE host_id = 'host-2') AS rule_sources
FROM ({_LISTING}) AS l, (
  SELECT round(avg(cpu_usage), 6) AS average_cpu, round(avg(ram_usage), 6) AS average_ram,
    count(*) AS window_size FROM (SELECT * FROM telemetry WHERE host_id = 'host-2'
      ORDER BY event_timestamp DESC, ingest_seq DESC LIMIT 5) AS newest) AS a
WHERE l.host_id = 'host-2'"""),
)
def _(spark, sf):
    rules = fixtures.rules(spark, sf)
    alerts = alerts_table(spark, sf, rules)
    detail = Q.host_detail(
        tel(spark, sf), rules, alerts, host_id="host-2", now=fixtures.now()
    )
    sources = F.transform(
        F.array_sort(F.col("rules")),
        lambda r: F.concat_ws(":", r["rule_type"], r["source"], r["enabled"].cast("string")),
    )
    return detail.select(
        *HOST_COLUMNS,
        "display_name",
        "silent_seconds",
        "status",
        F.round("averages.cpu", 6).alias("average_cpu"),
        F.round("averages.ram", 6).alias("average_ram"),
        F.col("averages.window").alias("window_size"),
        F.coalesce(F.col("levels")["ERROR"], F.lit(0)).alias("errors"),
        F.size("alerts").cast("long").alias("active_alerts"),
        F.array_join(sources, ",").alias("rule_sources"),
    )


@query(
    "fleet_summary",
    check("""
SELECT (SELECT count(*) FROM telemetry) AS total_events,
  (SELECT count(*) FROM alerts WHERE status <> 'RESOLVED') AS active_alerts,
  (SELECT count(*) FROM hosts_all) AS hosts,
  round(avg(cpu_usage), 6) AS average_cpu, round(avg(ram_usage), 6) AS average_ram,
  max_by(event_id, event_timestamp) AS latest_event_id
FROM (SELECT * FROM telemetry ORDER BY event_timestamp DESC, ingest_seq DESC LIMIT 5) AS newest"""),
)
def _(spark, sf):
    alerts = alerts_table(spark, sf, fixtures.rules(spark, sf))
    summary = Q.fleet_summary(tel(spark, sf), alerts)
    return summary.select(
        "total_events",
        "active_alerts",
        "hosts",
        F.round("average_cpu", 6).alias("average_cpu"),
        F.round("average_ram", 6).alias("average_ram"),
        F.col("latest_event.event_id").alias("latest_event_id"),
    )


@query(
    "telemetry_snapshot",
    check("""
SELECT (SELECT count(*) FROM flagged WHERE is_new) AS total_events, count(*) AS window_size,
  round(avg(cpu_usage), 6) AS average_cpu, round(avg(ram_usage), 6) AS average_ram,
  (SELECT string_agg(message || '=' || n, ';' ORDER BY n DESC, message) FROM (
    SELECT message, count(*) AS n FROM flagged WHERE is_new AND level IN ('ERROR', 'CRITICAL')
    GROUP BY message ORDER BY n DESC, message LIMIT 5) AS errors) AS top_errors
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ingest_seq DESC)
    AS rn FROM flagged WHERE is_new) AS tails WHERE rn <= 5
  ORDER BY event_timestamp DESC, ingest_seq DESC LIMIT 5) AS fleet"""),
)
def _(spark, sf):
    from hostpulse.operators.ingest import new_events

    stored = new_events(fixtures.load(spark, sf, "deliveries"))
    snapshot = Q.telemetry_snapshot(stored)
    errors = F.transform(
        F.col("top_errors"),
        lambda e: F.concat_ws("=", e["message"], e["occurrences"].cast("string")),
    )
    return snapshot.select(
        "total_events",
        "window_size",
        F.round("average_cpu", 6).alias("average_cpu"),
        F.round("average_ram", 6).alias("average_ram"),
        F.array_join(errors, ";").alias("top_errors"),
    )


@query(
    "fleet_heartbeat",
    check("""
SELECT (SELECT count(*) FROM hosts_all) AS hosts,
  (SELECT count(*) FROM alerts WHERE status <> 'RESOLVED') AS active_alerts"""),
)
def _(spark, sf):
    alerts = alerts_table(spark, sf, fixtures.rules(spark, sf))
    return Q.fleet_heartbeat(tel(spark, sf), alerts)


@query(
    "fullest_disk",
    check("""
SELECT host_id, hostname, disk_usage, disk_path FROM hosts_all WHERE disk_usage IS NOT NULL
ORDER BY disk_usage DESC, last_seen DESC, host_id LIMIT 1"""),
)
def _(spark, sf):
    return Q.fullest_disk(Q.host_rollup(tel(spark, sf)))
