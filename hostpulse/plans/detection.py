"""Registered detection queries, and the stages later queries build on."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.operators import detect as D
from hostpulse.operators.ingest import dedupe_events, new_events
from hostpulse.operators.queries import host_rollup
from hostpulse.plans import fixtures
from hostpulse.plans.checks import NOW, check
from hostpulse.plans.registry import query
from hostpulse.plans.rulebook import rule_log
from hostpulse.sources import materialize


def flagged(spark, sf):
    """Deliveries with ``is_new``, written once: the later stages read it several times."""
    return materialize(dedupe_events(fixtures.load(spark, sf, "deliveries")), "deliveries")


def evaluated(spark, sf):
    return materialize(D.evaluations(flagged(spark, sf)), "evaluations")


def sweep(spark, sf, rules):
    """The silence sweep after all deliveries: it carries the number of the last one."""
    hosts = host_rollup(fixtures.load(spark, sf, "telemetry"))
    newest = fixtures.load(spark, sf, "deliveries").agg(F.max("ingest_seq")).scalar()
    return D.silence_signals(hosts, rules, now=fixtures.now(), sweep_seq=newest)


def _plain(signals):
    """The comparable columns: texts with rounded numbers are left to the unit tests."""
    return signals.select(
        "alert_key",
        "alert_type",
        "host_id",
        "ingest_seq",
        "sub_seq",
        "at",
        "kind",
        F.round("value", 6).alias("value"),
        "threshold",
    )


_SIGNAL = (
    "SELECT alert_key, alert_type, host_id, ingest_seq, sub_seq, at, kind, "
    "round(value, 6) AS value, threshold FROM "
)


@query(
    "host_windows",
    check("""
SELECT host_id, pos, ingest_seq, event_timestamp, round(avg_cpu, 6) AS avg_cpu,
  round(avg_ram, 6) AS avg_ram, size, disk_usage, disk_path FROM windows"""),
)
def host_windows(spark, sf):
    events = materialize(new_events(fixtures.load(spark, sf, "deliveries")), "events")
    return D.host_windows(events).select(
        "host_id",
        "pos",
        "ingest_seq",
        "event_timestamp",
        F.round("avg_cpu", 6).alias("avg_cpu"),
        F.round("avg_ram", 6).alias("avg_ram"),
        "size",
        "disk_usage",
        "disk_path",
    )


@query(
    "evaluations",
    check("""
SELECT e.ingest_seq, e.host_id, e.is_new, e.pos, e.now, round(e.avg_cpu, 6) AS avg_cpu,
  round(e.avg_ram, 6) AS avg_ram, e.size, e.disk_usage, e.disk_path, coalesce(r.n, 0) AS errors
FROM evals e LEFT JOIN (SELECT ingest_seq, sum(times) AS n FROM repeat_counts GROUP BY ingest_seq)
  AS r ON r.ingest_seq = e.ingest_seq"""),
)
def _(spark, sf):
    return D.evaluations(flagged(spark, sf)).select(
        "ingest_seq",
        "host_id",
        "is_new",
        "pos",
        "now",
        F.round("avg_cpu", 6).alias("avg_cpu"),
        F.round("avg_ram", 6).alias("avg_ram"),
        "size",
        "disk_usage",
        "disk_path",
        F.size("errors").cast("long").alias("errors"),
    )


@query(
    "threshold_signals",
    check(_SIGNAL + "(SELECT * FROM cpu_signals UNION ALL SELECT * FROM ram_signals) AS s"),
)
def _(spark, sf):
    return _plain(D.threshold_signals(evaluated(spark, sf), fixtures.rules(spark, sf)))


@query(
    "threshold_signals_asof",
    check(_SIGNAL + "(SELECT * FROM cpu_signals_asof UNION ALL SELECT * FROM ram_signals_asof) AS s"),
)
def _(spark, sf):
    return _plain(D.threshold_signals(evaluated(spark, sf), rule_log(spark, sf)))


@query("disk_signals", check(_SIGNAL + "disk_level_signals"))
def _(spark, sf):
    return _plain(D.disk_signals(evaluated(spark, sf), fixtures.rules(spark, sf)))


@query("repeated_error_signals", check(_SIGNAL + "repeat_signals"))
def repeated_error_signals(spark, sf):
    return _plain(D.repeated_error_signals(evaluated(spark, sf), fixtures.rules(spark, sf)))


@query("silence_recovery_signals", check(_SIGNAL + "recovery_signals"))
def _(spark, sf):
    return _plain(D.silence_recovery_signals(evaluated(spark, sf)))


@query("silence_signals", check(_SIGNAL + "silence_signals_sql"))
def _(spark, sf):
    return _plain(sweep(spark, sf, fixtures.rules(spark, sf)))


@query(
    "silent_agents",
    check(f"SELECT {NOW} AS now, count(*) AS n FROM silence WHERE kind = 'BREACH'"),
)
def _(spark, sf):
    return D.silent_agents(sweep(spark, sf, fixtures.rules(spark, sf)))


@query(
    "alert_messages",
    check("""
SELECT 'repeated-error-' || sha256(c.message) || '@' || c.host_id AS alert_key, c.ingest_seq,
  c.message || ' occurred ' || CAST(c.times AS BIGINT) || ' times' AS message
FROM repeat_counts c JOIN effective r ON r.host_id = c.host_id AND r.rule_type = 'REPEATED_ERROR'
WHERE r.enabled AND c.times >= r.threshold
UNION ALL
SELECT alert_key, ingest_seq, 'no events for ' || CAST(value AS BIGINT) || ' minutes (threshold '
  || CAST(threshold AS BIGINT) || ')' FROM silence WHERE kind = 'BREACH'"""),
)
def _(spark, sf):
    """Texts made of whole numbers; those with rounded percentages are left to the unit tests."""
    rules = fixtures.rules(spark, sf)
    repeats = D.repeated_error_signals(evaluated(spark, sf), rules)
    silences = sweep(spark, sf, rules).where(F.col("kind") == "BREACH")
    return repeats.unionByName(silences).select("alert_key", "ingest_seq", "message")
