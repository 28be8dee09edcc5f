from __future__ import annotations

import hashlib

import pytest
from conftest import event, minute, no_rules, rule_table, telemetry
from pyspark.sql import functions as F

from hostpulse.operators import detect as D
from hostpulse.operators import lifecycle as L
from hostpulse.operators.ingest import dedupe_events
from hostpulse.operators.queries import host_rollup

BASE = {"REPEATED_ERROR": 3.0}


def evaluated(spark, rows):
    return D.evaluations(dedupe_events(telemetry(spark, rows)))


def last_kind(signals, key):
    rows = signals.where(F.col("alert_key") == key).orderBy("ingest_seq").collect()
    return rows[-1]["kind"] if rows else None


@pytest.mark.parametrize(
    "cpu,want",
    [([85.0] * 5, "BREACH"), ([10, 10, 10, 10, 100], "CLEAR"), ([5] * 10 + [95] * 5, "BREACH"), ([90], "BREACH")],
)
def test_cpu_average(spark, cpu, want):
    rows = [event(i, cpu_usage=float(c)) for i, c in enumerate(cpu)]
    got = D.threshold_signals(evaluated(spark, rows), no_rules(spark))
    assert last_kind(got, "cpu-high@h") == want


def test_disabled_rule_clears(spark):
    rows = [event(1, cpu_usage=99.0, ram_usage=99.0)]
    rules = rule_table(spark, [("HIGH_CPU", "h", 10.0, False)])
    got = D.threshold_signals(evaluated(spark, rows), rules)
    assert last_kind(got, "cpu-high@h") == "CLEAR"
    ram = got.where("alert_key = 'ram-high@h'").collect()[0]
    assert (ram["kind"], ram["message"]) == ("BREACH", "RAM average is 99.0% (threshold 80.0%)")


def test_disk(spark):
    readings = [(95.0, "/var"), (None, None), (20.0, "/"), (90.0, " ")]
    rows = [event(i, disk_usage=u, disk_path=p) for i, (u, p) in enumerate(readings)]
    got = D.disk_signals(evaluated(spark, rows), no_rules(spark)).orderBy("ingest_seq").collect()
    assert [(r["ingest_seq"], r["kind"], r["message"]) for r in got] == [
        (0, "BREACH", "/var is 95.0% (threshold 90.0%)"), (2, "CLEAR", None),
        (3, "BREACH", "disk is 90.0% (threshold 90.0%)")]


def test_repeated_errors(spark):
    rows = [event(1, level="ERROR", message="disk full"), event(2, level="CRITICAL", message="disk full"),
            event(3, level="ERROR", message="other"), event(4, level="ERROR", message="disk full"), event(5)]
    got = D.repeated_error_signals(evaluated(spark, rows), no_rules(spark), defaults=BASE)
    got = got.orderBy("ingest_seq").collect()
    key = "repeated-error-" + hashlib.sha256(b"disk full").hexdigest() + "@h"
    # Breaches again at the calm event, because the errors are still in the window.
    assert [(r["ingest_seq"], r["alert_key"], r["message"]) for r in got] == [
        (4, key, "disk full occurred 3 times"), (5, key, "disk full occurred 3 times")]
    off = rule_table(spark, [("REPEATED_ERROR", "*", 1.0, False)])
    assert D.repeated_error_signals(evaluated(spark, rows), off).count() == 0


def test_a_repeat_evaluates_the_named_hosts_window(spark):
    rows = [event(1, event_id="a", cpu_usage=90.0), event(2, event_id="a", message="again"),
            event(3, event_id="a", host_id="elsewhere")]
    got = evaluated(spark, rows).orderBy("ingest_seq").collect()
    assert [(r["ingest_seq"], r["pos"], r["is_new"]) for r in got] == [(1, 1, True), (2, 1, False)]
    log = D.delivery_signals(evaluated(spark, rows), no_rules(spark))
    alert = L.current_alerts(L.alert_transitions(log)).where("alert_type = 'HIGH_CPU'").collect()[0]
    assert alert["occurrence_count"] == 2


def test_order_of_a_deliverys_signals(spark):
    rows = [event(1, level="ERROR", message="m", disk_usage=99.0)]
    log = D.delivery_signals(evaluated(spark, rows), no_rules(spark), defaults={"REPEATED_ERROR": 1.0})
    got = [r["alert_key"].split("@")[0][:14] for r in log.orderBy("sub_seq").collect()]
    assert got == ["agent-silent", "cpu-high", "ram-high", "disk-high", "repeated-error"]


def test_silence(spark):
    tel = telemetry(spark, [
        event(1, host_id="five", event_timestamp=minute(15)), event(2, host_id="ten", event_timestamp=minute(10)),
        event(3, host_id="twenty", event_timestamp=minute(0)),
        event(4, host_id="gone", event_timestamp=minute(20 - 7 * 24 * 60 - 0.01)),
        event(5, host_id="edge", event_timestamp=minute(20 - 7 * 24 * 60)),
        event(6, host_id="off", event_timestamp=minute(0)), event(7, host_id="own", event_timestamp=minute(0)),
    ])
    rules = rule_table(spark, [("AGENT_SILENT", "off", 1.0, False), ("AGENT_SILENT", "own", 30.0, True)])
    sweep = D.silence_signals(host_rollup(tel), rules, now=minute(20), sweep_seq=7)
    got = {r["host_id"]: (r["kind"], r["message"]) for r in sweep.collect()}
    assert got == {
        "ten": ("BREACH", "no events for 10 minutes (threshold 10)"),
        "twenty": ("BREACH", "no events for 20 minutes (threshold 10)"),
        "edge": ("BREACH", "no events for 10080 minutes (threshold 10)"),
        "off": ("CLEAR", None),
    }
    assert D.silent_agents(sweep).collect()[0]["n"] == 3


def _signal(key, kind, seq, message=None):
    return (key, kind, seq, 0, minute(seq), message)


def log_of(spark, rows):
    df = spark.createDataFrame(
        rows, "alert_key string, kind string, ingest_seq long, sub_seq int, at timestamp, message string")
    none = F.lit(None).cast("double")
    return df.select("alert_key", F.lit("HIGH_CPU").alias("alert_type"), F.lit("h").alias("host_id"),
                     "ingest_seq", "sub_seq", "at", "kind", none.alias("value"), none.alias("threshold"), "message")


def test_lifecycle(spark):
    kinds = ["BREACH", "BREACH", "ACK", "ACK", "BREACH", "CLEAR", "CLEAR", "ACK", "BREACH", "RESOLVE", "RESOLVE"]
    log = log_of(spark, [_signal("k", kind, i, f"m{i}" if kind == "BREACH" else None) for i, kind in enumerate(kinds)])
    done = L.alert_transitions(log)
    got = [(r["ingest_seq"], r["transition"], r["status"], r["occurrence_count"])
           for r in done.orderBy("ingest_seq").collect()]
    assert got == [
        (0, "OPENED", "OPEN", 1), (1, "OCCURRENCE", "OPEN", 2), (2, "ACKNOWLEDGED", "ACKNOWLEDGED", 2),
        (4, "OCCURRENCE", "ACKNOWLEDGED", 3), (5, "RESOLVED", "RESOLVED", 3), (8, "REOPENED", "OPEN", 4),
        (9, "RESOLVED", "RESOLVED", 4)]
    alert = L.current_alerts(done).collect()[0]
    assert (alert["first_seen"], alert["last_seen"], alert["message"]) == (minute(0), minute(9), "m8")
    actions = spark.createDataFrame([("k", 3), ("k", 2), ("nobody", 1)], "alert_key string, ingest_seq long")
    idle = L.ineffective_actions(actions, done)
    assert sorted(map(tuple, idle.collect())) == [("k", 3), ("nobody", 1)]


def test_finding_alerts(spark):
    log = log_of(spark, [_signal("a", "BREACH", 1), _signal("b", "BREACH", 2), _signal("b", "CLEAR", 3),
                         _signal("c", "BREACH", 4), _signal("c", "ACK", 5)])
    alerts = L.current_alerts(L.alert_transitions(log))

    def keys(df):
        return [r["alert_key"] for r in df.collect()]

    assert keys(L.find_alerts(alerts)) == ["c", "a"]
    assert keys(L.find_alerts(alerts, status="resolved")) == ["b"]
    assert keys(L.find_alerts(alerts, status="nonsense")) == []
    assert keys(L.find_alerts(alerts, type="high_CPU")) == ["c", "a"]
    assert keys(L.alert_by_key(alerts, "b")) == ["b"]
    assert L.active_alert_count(alerts).collect()[0]["n"] == 2
    assert keys(L.host_alerts(alerts, "h")) == ["c", "a"]
    assert keys(L.host_alerts(alerts, "x")) == []


def test_operator_actions_join_the_log(spark):
    log = log_of(spark, [_signal("a", "BREACH", 1)])
    act = spark.createDataFrame([("a", 2, minute(7))], "alert_key string, ingest_seq long, at timestamp")
    acked = D.signals(log, L.acknowledge_alerts(act))
    alert = L.current_alerts(L.alert_transitions(acked)).collect()[0]
    assert (alert["status"], alert["last_seen"]) == ("ACKNOWLEDGED", minute(1))
    closed = D.signals(log, L.resolve_alerts(act))
    alert = L.current_alerts(L.alert_transitions(closed)).collect()[0]
    assert (alert["status"], alert["last_seen"]) == ("RESOLVED", minute(7))
