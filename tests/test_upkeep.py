from __future__ import annotations

import json
import math
import random
from datetime import timedelta

import pytest
from conftest import START, event, minute, telemetry
from pyspark.sql import functions as F

from hostpulse import schemas as S
from hostpulse.operators import agents as A
from hostpulse.operators import credentials as C
from hostpulse.operators import maintain as M
from hostpulse.operators import notify as N
from hostpulse.sources import append_telemetry, prune_table, read_telemetry


def test_policy_and_outbox(spark):
    rows = [("k", i, 0, minute(i * 10), t) for i, t in enumerate(
        ["OPENED", "OCCURRENCE", "OCCURRENCE", "ACKNOWLEDGED", "RESOLVED", "REOPENED"])]
    transitions = spark.createDataFrame(
        rows, "alert_key string, ingest_seq long, sub_seq int, at timestamp, transition string"
    ).select("*", F.lit("HIGH_CPU").alias("alert_type"), F.lit("OPEN").alias("status"), F.lit("m").alias("message"),
             F.lit(minute(0.5)).alias("first_seen"), F.lit(minute(1)).alias("last_seen"),
             F.lit(2).cast("long").alias("occurrence_count"))
    log = spark.createDataFrame(
        [("k", "DELIVERED", minute(0))], "alert_key string, delivery_status string, attempted_at timestamp")
    policy = N.notification_policy(transitions, log)
    got = {r["ingest_seq"]: (r["event_type"], r["decision"]) for r in policy.collect()}
    assert got == {0: ("alert.opened", "DELIVER"), 1: (None, "SUPPRESSED"), 2: ("alert.reminder", "DELIVER"),
                   3: ("alert.acknowledged", "DELIVER"), 4: ("alert.resolved", "DELIVER"), 5: ("alert.reopened", "DELIVER")}
    outbox = N.notification_outbox(policy, schema_version="mine.v2").where("event_type = 'alert.opened'").collect()[0]
    body = json.loads(outbox["payload"])
    assert body["schema_version"] == "mine.v2"
    assert list(body) == ["schema_version", "event_type", "occurred_at", "source", "alert"]
    assert body["occurred_at"] == "2026-01-01T00:00:00Z" and body["alert"]["first_seen"] == "2026-01-01T00:00:30Z"
    assert body["alert"]["occurrence_count"] == 2 and body["source"]["channel"] == "webhook"
    outcomes = N.notification_outcomes(policy, log).collect()
    assert {tuple(r) for r in outcomes} == {("SUPPRESSED", 1), ("DELIVERED", 1)}


@pytest.mark.parametrize("statuses,want", [
    ([500, 500, 500, 200], ["FAILED"] * 3), ([400, 200], ["FAILED"]), ([429, 429, 429], ["FAILED"] * 3),
    ([None, 200, 200], ["FAILED", "DELIVERED"]), ([204], ["DELIVERED"]), ([302, 200], ["FAILED", "DELIVERED"])])
def test_attempts(spark, statuses, want):
    rows = [("n", i + 1, s) for i, s in enumerate(statuses)]
    got = N.classify_attempts(
        spark.createDataFrame(rows, "notification_id string, attempt_number int, http_status int")
    ).orderBy("attempt_number").collect()
    assert [r["delivery_status"] for r in got] == want
    assert got[-1]["terminal"]


def test_history_and_last_delivery(spark):
    rows = [(1, "k", "DELIVERED", minute(9)), (2, "k", "DELIVERED", minute(3)), (3, "k", "FAILED", minute(12))]
    log = spark.createDataFrame(rows, "id long, alert_key string, delivery_status string, attempted_at timestamp")
    assert [r["id"] for r in N.delivery_history(log, "k", limit=2).collect()] == [3, 2]
    assert N.last_delivered(log).collect()[0]["attempted_at"] == minute(3)


def test_fullest_mount(spark):
    def one(readings, **kw):
        rows = [("h", 1, i, p, t, u) for i, (p, t, u) in enumerate(readings)]
        df = spark.createDataFrame(rows, "host_id string, sample long, ord int, path string, total long, used double")
        return tuple(A.fullest_mount(df, **kw).select("disk_usage", "disk_path").collect()[0])

    assert one([("/", 10, 40.0), ("/var", 10, 91.0), ("/x", 0, 99.0)]) == (91.0, "/var")
    assert one([("/", 10, 50.0), ("/var", 10, 50.0)]) == (50.0, "/")
    assert one([("/", 10, math.nan), ("/v", 10, math.inf), ("/z", 10, None)]) == (None, None)
    assert one([("/", 10, 104.0)]) == (100.0, "/") and one([("/", 10, -3.0)]) == (0.0, "/")
    assert one([("/", 10, 40.0), ("/var", 10, 91.0)], paths=["/"]) == (40.0, "/")


def test_forwarding(spark):
    rows = [("a", 200, False), ("b", 503, False), ("c", None, False), ("d", 429, True), ("e", 400, True), ("f", 302, False)]
    got = A.forward_outcomes(spark.createDataFrame(rows, "event_id string, status int, queue_full boolean"))
    assert [r["outcome"] for r in got.orderBy("event_id").collect()] == [
        "delivered", "queued", "queued", "failed", "rejected", "rejected"]
    tries = [("x", 1, 500), ("x", 2, 429), ("x", 3, 200), ("y", 1, None), ("y", 2, 500), ("z", 4, 200), ("z", 1, None)]
    got = A.retry_outcome(spark.createDataFrame(tries, "event_id string, attempt int, status int"))
    assert sorted(tuple(r) for r in got.collect()) == [("x", 429, 2, True), ("y", 500, 2, False), ("z", None, 1, False)]


def test_reconcile(spark):
    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "event_id string")

    lost, totals = A.reconcile_delivery(ids("a", "b", "b", "c", "d"), ids("a", "a"), ids("c"))
    assert sorted(r["event_id"] for r in lost.collect()) == ["b", "d"]
    assert tuple(totals.collect()[0]) == (4, 1, 1, 2)


def test_credentials(spark):
    rows = [("old", "h", "l", "x", minute(0), None, minute(1)), ("new", "h", None, "y", minute(5), None, None)]
    table = spark.createDataFrame(rows, S.CREDENTIALS)
    listed = C.list_credentials(table)
    assert [r["id"] for r in listed.collect()] == ["new", "old"] and "token_hash" not in listed.columns
    log = spark.createDataFrame(
        [("new", minute(7)), ("new", minute(6)), ("old", minute(6)), ("nobody", minute(6)), ("new", minute(99))],
        "id string, at timestamp")
    after, idle = C.revoke_credentials(table, log, now=minute(10))
    assert {r["id"]: r["revoked_at"] for r in after.collect()} == {"old": minute(1), "new": minute(6)}
    assert sorted(tuple(r) for r in idle.collect()) == [("new", minute(7)), ("nobody", minute(6)), ("old", minute(6))]


def test_retention(spark, tmp_path):
    now = START + timedelta(days=40)
    ages = [30, 8, 7, 1, 0]
    tel = telemetry(spark, [event(i, event_timestamp=now - timedelta(days=a)) for i, a in enumerate(ages)])
    kept, removed = M.prune_history(tel, time_col="event_timestamp", now=now, days=7)
    assert (kept.count(), removed.collect()[0]["removed"]) == (3, 2)
    for days in (0, -1):
        kept, removed = M.prune_history(tel, time_col="event_timestamp", now=now, days=days)
        assert (kept.count(), removed.collect()[0]["removed"]) == (5, 0)
    path = str(tmp_path / "tel")
    extra = telemetry(spark, [event(9, event_timestamp=now - timedelta(days=7, seconds=1))])
    append_telemetry(tel.unionByName(extra), path)
    assert prune_table(spark, path, schema=S.TELEMETRY, time_col="event_timestamp", now=now, days=7) == 3
    left = read_telemetry(spark, path).collect()
    assert sorted(r["ingest_seq"] for r in left) == [2, 3, 4]
    assert prune_table(spark, path, schema=S.TELEMETRY, time_col="event_timestamp", now=now, days=7) == 0


def test_old_files_read_new_columns_as_null(spark, tmp_path):
    path = str(tmp_path / "tel")
    tel = telemetry(spark, [event(1, disk_usage=5.0), event(2, disk_usage=6.0)])
    append_telemetry(tel.where("ingest_seq = 1").drop("disk_usage", "disk_path"), path)
    append_telemetry(tel.where("ingest_seq = 2"), path)
    got = {r["ingest_seq"]: r["disk_usage"] for r in read_telemetry(spark, path).collect()}
    assert got == {1: None, 2: 6.0}


@pytest.mark.parametrize("values", [[10, 20, 30, 40, 50], [7], None])
def test_percentiles(spark, values):
    if values is None:
        rng = random.Random(3)
        values = [rng.choice([0.0, rng.uniform(-5, 5), rng.lognormvariate(0, 4)]) for _ in range(700)]
    ordered = sorted(values)
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = dict(map(tuple, M.nearest_rank(
        spark.createDataFrame([(float(v),) for v in values], "v double"), "v", fractions).collect()))
    assert got == {n: ordered[max(math.ceil(f * len(ordered)) - 1, 0)] for n, f in fractions.items()}


def test_latency_report(spark):
    rows = [(0.01, 200), (0.02, 201), (0.03, 429), (0.04, 500), (0.05, 200), (9.0, None)]
    report = M.latency_report(spark.createDataFrame(rows, "seconds double, status int"), elapsed_s=3)
    assert dict(map(tuple, report.collect())) == {
        "elapsed_seconds": 3.0, "events_per_second": 2.0, "accepted": 3.0, "transport_failures": 1.0,
        "latency_max": 0.05, "status_200": 2.0, "status_201": 1.0, "status_429": 1.0, "status_500": 1.0,
        "latency_p50": 0.03, "latency_p95": 0.05, "latency_p99": 0.05}
