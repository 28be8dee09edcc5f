from __future__ import annotations

import pytest
from conftest import event, minute, no_rules, rule_table, telemetry
from pyspark.sql import functions as F

from hostpulse.operators import queries as Q
from hostpulse.operators import rules as R
from hostpulse.schemas import ALERTS


def alerts(spark, rows=()):
    return spark.createDataFrame(list(rows), ALERTS)


def ids(df):
    return [r["event_id"] for r in df.collect()]


def test_filters_and_paging(spark):
    tel = telemetry(spark, [
        event(1, event_timestamp=minute(0)),
        event(2, event_timestamp=minute(60), level="ERROR"),
        event(3, event_timestamp=minute(120), level="ERROR", host_id="other"),
    ])

    def total(**chosen):
        return Q.count_events(tel, **chosen).first()["total"]

    assert [total(level="ERROR"), total(level="INFO"), total(frm=minute(60))] == [2, 1, 2]
    assert [total(level="ERROR", frm=minute(90)), total(to=minute(30)), total(host_id="other")] == [1, 1, 1]
    assert ids(Q.find_events(tel, level="ERROR")) == ["e3", "e2"]
    assert ids(Q.find_events(tel, limit=1, offset=1)) == ["e2"]
    page = Q.events_page(tel, level="ERROR", limit=1).collect()[0]
    assert (page["event_id"], page["total"], page["limit"], page["offset"]) == ("e3", 2, 1, 0)
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            Q.find_events(tel, **bad)
    with pytest.raises(ValueError):
        Q.find_events(tel, frm=minute(2), to=minute(1))


def test_top_errors(spark):
    tel = telemetry(spark, [
        event(1, level="ERROR", message="repeated"), event(2, level="ERROR", message="repeated"),
        event(3, level="CRITICAL", message="severe"), event(4, message="ignored"),
    ])
    assert [tuple(r) for r in Q.top_error_messages(tel).collect()] == [("repeated", 2), ("severe", 1)]


def test_rollup_shows_the_newest_row(spark):
    tel = telemetry(spark, [
        event(1, agent_version="9", disk_usage=99.0, disk_path="/", event_timestamp=minute(1)),
        event(3, agent_version="10", queue_depth=None, event_timestamp=minute(5)),
        event(4, agent_version="11", disk_usage=10.0, event_timestamp=minute(2)),
        event(5, host_id="late", event_timestamp=minute(3)),
    ])
    first, second = Q.host_rollup(tel).collect()
    assert (first["host_id"], first["event_count"], first["agent_version"]) == ("h", 3, "10")
    assert (first["queue_depth"], first["disk_usage"], first["disk_path"]) == (None, None, None)
    assert second["host_id"] == "late"
    assert Q.host_rollup(tel, limit=1).count() == 1
    assert Q.host_lookup(tel, "nobody").count() == 0


def test_listing_status(spark):
    tel = telemetry(spark, [
        event(1, host_id="a", hostname=None, event_timestamp=minute(0)),
        event(2, host_id="b", event_timestamp=minute(0.01)),
        event(3, host_id="c", event_timestamp=minute(20)),
        event(4, host_id="d", event_timestamp=minute(0)),
    ])
    rules = rule_table(spark, [("AGENT_SILENT", "d", 1.0, False)])
    rows = {r["host_id"]: r for r in Q.host_listing(tel, rules, now=minute(10)).collect()}
    assert {h: r["status"] for h, r in rows.items()} == {
        "a": "silent", "b": "reporting", "c": "reporting", "d": "reporting"}
    assert (rows["a"]["silent_seconds"], rows["c"]["silent_seconds"]) == (600, 0)
    assert (rows["a"]["display_name"], rows["b"]["display_name"]) == ("a", "h.lab")


def test_detail(spark):
    tel = telemetry(spark, [event(i, level="ERROR" if i > 6 else "INFO", cpu_usage=float(i))
                            for i in range(1, 8)])
    active = ("k", "HIGH_CPU", "h", "m", "OPEN", minute(1), minute(2), 1)
    other = ("k2", "HIGH_CPU", "x", "m", "OPEN", minute(1), minute(2), 1)
    closed = ("k3", "HIGH_RAM", "h", "m", "RESOLVED", minute(1), minute(2), 1)
    rules = rule_table(spark, [("HIGH_CPU", "h", 95.0, False), ("HIGH_CPU", "*", 70.0, True)])
    row = Q.host_detail(
        tel, rules, alerts(spark, [active, other, closed]), host_id="h", now=minute(9)
    ).collect()[0]
    assert (row["averages"]["cpu"], row["averages"]["window"]) == (5.0, 5)
    assert row["levels"] == {"INFO": 6, "ERROR": 1}
    assert [a["alert_key"] for a in row["alerts"]] == ["k"]
    assert [(r["rule_type"], r["source"], r["enabled"]) for r in row["rules"]] == [
        ("HIGH_CPU", "host", False), ("HIGH_RAM", "default", True), ("HIGH_DISK", "default", True),
        ("REPEATED_ERROR", "default", True), ("AGENT_SILENT", "default", True)]
    unknown = Q.host_detail(tel, rules, alerts(spark), host_id="nobody", now=minute(9))
    assert unknown.count() == 0


def test_summary_and_snapshot(spark):
    empty = telemetry(spark, [])
    row = Q.fleet_summary(empty, alerts(spark)).collect()[0]
    assert (row["total_events"], row["hosts"], row["average_cpu"], row["latest_event"]) == (0, 0, 0.0, None)
    tel = telemetry(spark, [event(i, host_id=f"h{i % 2}", cpu_usage=float(i)) for i in range(1, 11)])
    row = Q.fleet_summary(tel, alerts(spark)).collect()[0]
    assert (row["total_events"], row["hosts"], row["average_cpu"]) == (10, 2, 8.0)
    assert row["latest_event"]["event_id"] == "e10"
    # A late event enters its host's window but is not among the newest by time.
    late = tel.unionByName(telemetry(spark, [event(11, host_id="h0", event_timestamp=minute(0))]))
    snapshot = Q.telemetry_snapshot(late).collect()[0]
    assert (snapshot["total_events"], snapshot["window_size"], snapshot["average_cpu"]) == (11, 5, 8.0)
    assert snapshot["top_errors"] == []
    beat = Q.fleet_heartbeat(tel, alerts(spark)).collect()[0]
    assert tuple(beat) == (2, 0)


def test_fullest_disk_ignores_unknown(spark):
    tel = telemetry(spark, [event(1, host_id="a"), event(2, host_id="b", disk_usage=40.0)])
    assert Q.fullest_disk(Q.host_rollup(tel)).collect()[0]["host_id"] == "b"
    assert Q.fullest_disk(Q.host_rollup(telemetry(spark, [event(1)]))).count() == 0


def test_rule_precedence(spark):
    hosts = spark.createDataFrame([("x",), ("y",)], "host_id string")

    def cpu(rules, host):
        row = R.effective_rules(hosts, rules).where((F.col("host_id") == host) & (F.col("rule_type") == "HIGH_CPU"))
        return tuple(row.select("threshold", "enabled", "source").collect()[0])

    assert cpu(no_rules(spark), "x") == (85.0, True, "default")
    fleet = ("HIGH_CPU", "*", 70.0, True)
    assert cpu(rule_table(spark, [fleet]), "x") == (70.0, True, "fleet")
    both = rule_table(spark, [fleet, ("HIGH_CPU", "x", 95.0, False)])
    assert cpu(both, "x") == (95.0, False, "host")
    assert cpu(both, "y") == (70.0, True, "fleet")


def test_rule_validation(spark):
    ok = [("HIGH_CPU", None, 0.0), ("HIGH_DISK", "h", 100.0), ("REPEATED_ERROR", None, 5.0),
          ("AGENT_SILENT", None, 1.0), ("AGENT_SILENT", "h" * 128, 10080.0)]
    bad = [("NOPE", None, 1.0), (None, None, 1.0), ("HIGH_CPU", " ", 1.0), ("HIGH_CPU", "h" * 129, 1.0),
           ("HIGH_CPU", "*", 1.0), ("HIGH_CPU", None, float("nan")), ("HIGH_CPU", None, float("inf")),
           ("HIGH_RAM", None, -1.0), ("HIGH_RAM", None, 100.5), ("REPEATED_ERROR", None, 0.0),
           ("REPEATED_ERROR", None, 2.5), ("REPEATED_ERROR", None, 6.0), ("AGENT_SILENT", None, 0.0),
           ("AGENT_SILENT", None, 10081.0), ("AGENT_SILENT", None, 1.5)]
    got = R.validate_rules(
        spark.createDataFrame(ok + bad, "rule_type string, host_id string, threshold double").coalesce(1)
    ).collect()
    assert [r["reason"] is None for r in got] == [True] * len(ok) + [False] * len(bad)


def test_upsert_and_delete(spark):
    log = spark.createDataFrame(
        [
            (1, "HIGH_CPU", None, 50.0, True, False), (2, "HIGH_CPU", None, 55.0, None, False),
            (3, "HIGH_CPU", None, 500.0, True, False), (1, "HIGH_RAM", "h", 30.0, True, False),
            (2, "HIGH_RAM", "h", None, None, True), (4, "HIGH_DISK", "h", 60.0, False, False),
        ],
        "version long, rule_type string, host_id string, threshold double, enabled boolean, deleted boolean",
    ).withColumn("updated_at", F.lit(minute(0)))
    rules = R.upsert_rules(log)
    assert sorted(tuple(r)[:4] for r in rules.collect()) == [
        ("HIGH_CPU", "*", 55.0, True), ("HIGH_DISK", "h", 60.0, False)]
    keys = spark.createDataFrame([("HIGH_CPU", None), ("HIGH_RAM", "h")], "rule_type string, host_id string")
    remaining, existed = R.delete_rules(rules, keys)
    assert [r["rule_type"] for r in remaining.collect()] == ["HIGH_DISK"]
    assert {(r["rule_type"], r["existed"]) for r in existed.collect()} == {
        ("HIGH_CPU", True), ("HIGH_RAM", False)}
    assert R.list_rules(rules).collect()[0]["display_name"] == "All machines"
    stored = rule_table(spark, [("REPEATED_ERROR", "*", 4.0, True)])
    assert R.unreachable_rules(stored, window=4).collect()[0]["scope"] == "default"
    assert R.unreachable_rules(stored).count() == 0
