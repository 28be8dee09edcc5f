"""Registered signal-log and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.operators import detect as D
from hostpulse.operators import lifecycle as L
from hostpulse.plans import fixtures
from hostpulse.plans.checks import check
from hostpulse.plans.detection import _SIGNAL, _plain, evaluated, sweep
from hostpulse.plans.registry import query
from hostpulse.plans.rulebook import rule_log
from hostpulse.sources import materialize


def actions(spark, sf, kind: str):
    return fixtures.load(spark, sf, "actions").where(F.col("kind") == kind)


def signal_log(spark, sf, rules):
    return D.signals(
        D.delivery_signals(evaluated(spark, sf), rules),
        sweep(spark, sf, rules),
        L.acknowledge_alerts(actions(spark, sf, "ACK")),
        L.resolve_alerts(actions(spark, sf, "RESOLVE")),
    )


def transitions_table(spark, sf, rules):
    log = materialize(signal_log(spark, sf, rules), "signals")
    return materialize(L.alert_transitions(log), "transitions")


def alerts_table(spark, sf, rules):
    return materialize(L.current_alerts(transitions_table(spark, sf, rules)), "alerts")


@query("signals", check(_SIGNAL + "all_signals"))
def _(spark, sf):
    return _plain(signal_log(spark, sf, fixtures.rules(spark, sf)))


_TRANSITION = (
    "SELECT alert_key, alert_type, host_id, ingest_seq, sub_seq, at, transition, status, "
    "first_seen, last_seen, occurrence_count FROM transitions"
)


@query("alert_transitions", check(_TRANSITION))
def alert_transitions(spark, sf):
    log = materialize(signal_log(spark, sf, fixtures.rules(spark, sf)), "signals")
    return L.alert_transitions(log).drop("message")


@query("alert_transitions_asof", check(_TRANSITION.replace("FROM transitions", "FROM transitions_asof")))
def _(spark, sf):
    """Transitions of all deliveries, each judged by the rules in force when it arrived."""
    log = materialize(D.delivery_signals(evaluated(spark, sf), rule_log(spark, sf)), "signals")
    return L.alert_transitions(log).drop("message")


_ALERT = (
    "SELECT alert_key, alert_type, host_id, status, first_seen, last_seen, occurrence_count "
    "FROM alerts"
)


@query("current_alerts", check(_ALERT))
def _(spark, sf):
    rules = fixtures.rules(spark, sf)
    return L.current_alerts(transitions_table(spark, sf, rules)).drop("message")


@query("find_alerts", check(_ALERT + " WHERE status <> 'RESOLVED' AND lower(alert_type) = 'high_cpu'"))
def _(spark, sf):
    alerts = alerts_table(spark, sf, fixtures.rules(spark, sf))
    return L.find_alerts(alerts, type="high_cpu").drop("message")


@query("find_alerts_by_status", check(_ALERT + " WHERE status = 'ACKNOWLEDGED'"))
def _(spark, sf):
    alerts = alerts_table(spark, sf, fixtures.rules(spark, sf))
    return L.find_alerts(alerts, status="acknowledged").drop("message")


@query("alert_by_key", check(_ALERT + " WHERE alert_key = 'ram-high@host-4'"))
def _(spark, sf):
    alerts = alerts_table(spark, sf, fixtures.rules(spark, sf))
    return L.alert_by_key(alerts, "ram-high@host-4").drop("message")


@query("active_alert_count", check("SELECT count(*) AS n FROM alerts WHERE status <> 'RESOLVED'"))
def _(spark, sf):
    return L.active_alert_count(alerts_table(spark, sf, fixtures.rules(spark, sf)))


@query("host_alerts", check(_ALERT + " WHERE status <> 'RESOLVED' AND host_id = 'host-5'"))
def _(spark, sf):
    alerts = alerts_table(spark, sf, fixtures.rules(spark, sf))
    return L.host_alerts(alerts, "host-5").drop("message")


def _ineffective(kind: str) -> str:
    return check(f"""
SELECT a.alert_key, a.ingest_seq FROM actions a WHERE a.kind = '{kind}' AND NOT EXISTS (
  SELECT 1 FROM transitions t WHERE t.alert_key = a.alert_key AND t.ingest_seq = a.ingest_seq)""")


@query("acknowledge_alerts", _ineffective("ACK"))
def _(spark, sf):
    done = transitions_table(spark, sf, fixtures.rules(spark, sf))
    idle = L.ineffective_actions(actions(spark, sf, "ACK"), done)
    return idle.select("alert_key", "ingest_seq")


@query("resolve_alerts", _ineffective("RESOLVE"))
def _(spark, sf):
    done = transitions_table(spark, sf, fixtures.rules(spark, sf))
    idle = L.ineffective_actions(actions(spark, sf, "RESOLVE"), done)
    return idle.select("alert_key", "ingest_seq")
