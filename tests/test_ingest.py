from __future__ import annotations

import json

import pytest
from conftest import START, event, minute, telemetry
from pyspark.sql import functions as F

from hostpulse.operators import ingest as I

GOOD = {
    "level": "WARN",
    "msg": "two fans stopped",
    "event_id": "evt-000123",
    "timestamp": "2025-11-20T07:05:30Z",
    "host_id": "rack7-node3",
    "hostname": "node3.lab",
    "cpu_usage": 41.5,
    "ram_usage": 63.25,
    "disk_usage": 57.5,
    "disk_path": "/data",
    "queue_depth": 2,
    "agent_version": "3.1",
    "correlation_id": "trace-77",
}


def raw(spark, bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b), None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(
        rows, "ingest_seq long, value string, header_correlation_id string"
    )


def reasons(spark, bodies):
    checked = I.validate_events(I.parse_events(raw(spark, bodies)))
    return [r["reason"] for r in checked.orderBy("ingest_seq").collect()]


def test_acceptable_events(spark):
    good = [
        GOOD,
        {**GOOD, "level": "critical"},
        {**GOOD, "surprise": [1]},
        {**GOOD, "cpu_usage": 0, "ram_usage": 100, "disk_usage": 1e1},
        {**GOOD, "msg": "m" * 1000, "event_id": "e" * 128},
        {**GOOD, "host_id": " ", "hostname": None, "queue_depth": None, "disk_usage": None},
        {k: GOOD[k] for k in ("event_id", "level", "msg", "timestamp", "cpu_usage", "ram_usage")},
        {**GOOD, "timestamp": "2025-11-20T07:05:30.123456789+02:00"},
        {**GOOD, "msg": " "},
    ]
    assert reasons(spark, good) == [None] * len(good)


FAULTS = [
    ({"event_id": None}, I.BAD_EVENT_ID),
    ({"event_id": 7}, I.BAD_EVENT_ID),
    ({"event_id": " 　"}, I.BAD_EVENT_ID),
    ({"event_id": "e" * 129}, I.BAD_EVENT_ID),
    ({"event_id": "\U0001f600" * 65}, I.BAD_EVENT_ID),
    ({"level": "FATAL"}, I.BAD_LEVEL),
    ({"level": 3}, I.BAD_LEVEL),
    ({"msg": 3}, I.MSG_NOT_TEXT),
    ({"msg": "  "}, I.BAD_MSG_LENGTH),
    ({"msg": "m" * 1001}, I.BAD_MSG_LENGTH),
    ({"timestamp": "yesterday"}, I.BAD_TIMESTAMP),
    ({"timestamp": "2026-09-04"}, I.BAD_TIMESTAMP),
    ({"timestamp": "2025-11-20T07:05Z"}, I.BAD_TIMESTAMP),
    ({"timestamp": "2026-02-30T07:05:30Z"}, I.BAD_TIMESTAMP),
    ({"timestamp": 1}, I.BAD_TIMESTAMP),
    ({"cpu_usage": -0.1}, I.BAD_CPU_RAM),
    ({"cpu_usage": 100.1}, I.BAD_CPU_RAM),
    ({"ram_usage": "40"}, I.BAD_CPU_RAM),
    ({"host_id": 5}, "host_id must be a text value"),
    ({"hostname": "h" * 129}, "hostname must contain at most 128 characters"),
    ({"agent_version": True}, "agent_version must be a text value"),
    ({"queue_depth": -1}, I.BAD_QUEUE_DEPTH),
    ({"queue_depth": 1.5}, I.BAD_QUEUE_DEPTH),
    ({"queue_depth": "1"}, I.BAD_QUEUE_DEPTH),
    ({"disk_usage": 101}, I.BAD_DISK),
    ({"disk_usage": "9"}, I.BAD_DISK),
    ({"disk_path": "p" * 129}, "disk_path must contain at most 128 characters"),
    # The first broken rule is the one reported.
    ({"level": "FATAL", "msg": " ", "cpu_usage": 101}, I.BAD_LEVEL),
]


def test_refused_events(spark):
    got = reasons(spark, [{**GOOD, **fault} for fault, _ in FAULTS])
    assert got == [want for _, want in FAULTS]


@pytest.mark.parametrize("field", ["event_id", "level", "msg", "timestamp", "cpu_usage", "ram_usage"])
def test_required_fields(spark, field):
    assert reasons(spark, [{k: v for k, v in GOOD.items() if k != field}])[0] is not None


def test_unusable_bodies(spark):
    large = json.dumps({**GOOD, "extra": "x" * 65_536})
    edge = json.dumps(GOOD)
    edge += " " * (65_536 - len(edge))
    got = reasons(spark, ["[1]", "{broken", "7", "", large, edge, "null"])
    assert got == ["invalid_json"] * 4 + ["too_large", None, "invalid_json"]


def test_normalised_columns(spark):
    bodies = [
        {**GOOD, "level": "warn"},
        {**GOOD, "host_id": " ", "hostname": "", "agent_version": "\t", "disk_usage": None},
        {**GOOD, "disk_path": " ", "queue_depth": 4},
    ]
    clean = I.normalize_events(I.validate_events(I.parse_events(raw(spark, bodies))))
    first, second, third = clean.orderBy("ingest_seq").collect()
    assert (first["level"], first["correlation_id"], first["disk_path"]) == ("WARN", "trace-77", "/data")
    assert first["event_timestamp"].isoformat() == "2025-11-20T07:05:30"
    assert (second["host_id"], second["hostname"], second["agent_version"]) == ("unknown", None, None)
    assert (second["disk_usage"], second["disk_path"], second["claimed_host_id"]) == (None, None, None)
    assert (third["disk_usage"], third["disk_path"], third["queue_depth"]) == (57.5, None, 4)


def test_first_arrival_wins(spark):
    rows = [
        event(1, event_id="dup", message="first"),
        event(2, event_id="dup", message="second"),
        event(3, event_id=None),
        event(4, event_id=None),
        event(5, event_id="old"),
    ]
    tel = telemetry(spark, rows)
    flags = I.dedupe_events(tel).orderBy("ingest_seq").collect()
    assert [r["is_new"] for r in flags] == [True, False, True, True, True]
    stored = telemetry(spark, [event(0, event_id="old")])
    assert I.new_events(tel, stored=stored).count() == 3


def credentials(spark):
    rows = [
        ("a1", "host-a", None, "hash-a", START, None, None),
        ("a2", "host-b", None, "hash-b", START, None, minute(1)),
    ]
    from hostpulse.schemas import CREDENTIALS

    return spark.createDataFrame(rows, CREDENTIALS)


def test_credentials(spark):
    presented = spark.createDataFrame(
        [(1, "hash-a"), (2, "hash-b"), (3, "nope"), (4, None), (5, "shared")],
        "ingest_seq long, presented_hash string",
    )
    got = I.authorize_events(presented, credentials(spark), shared_hash="shared")
    methods = [r["method"] for r in got.orderBy("ingest_seq").collect()]
    assert methods == ["agent_token", "unauthorized", "unauthorized", "unauthorized", "shared_key"]
    off = I.authorize_events(
        presented, credentials(spark), shared_hash="shared", shared_enabled=False
    )
    assert off.where("method = 'shared_key'").count() == 0


def test_large_credential_table_is_salted_not_broadcast(spark):
    from hostpulse.operators.lookup import lookup

    rows = spark.range(2000).selectExpr("id as ingest_seq", "if(id % 3 = 0, 7, id % 50) as k")
    side = spark.range(40).selectExpr("id as k", "id * 2 as v")
    small = lookup(rows, side, "k", spread="ingest_seq")
    large = lookup(rows, side, "k", spread="ingest_seq", max_rows=10, salts=4)
    assert sorted(map(tuple, small.select("ingest_seq", "v").collect())) == sorted(
        map(tuple, large.select("ingest_seq", "v").collect())
    )
    assert large.count() == 2000


def test_bound_host_replaces_the_claim(spark):
    events = spark.createDataFrame(
        [("x", "x", "y"), ("x", "x", "x"), ("unknown", None, "y"), ("x", "x", None)],
        "host_id string, claimed_host_id string, bound_host_id string",
    )
    got = [(r["host_id"], r["host_mismatch"]) for r in I.attribute_events(events).collect()]
    assert got == [("y", True), ("x", False), ("y", False), ("x", False)]


def test_token_hash(spark):
    import base64
    import hashlib

    tokens = ["secret", "ünïcode", "x" * 300]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(
        I.hash_tokens(F.col("t")).alias("h")
    )
    want = [base64.urlsafe_b64encode(hashlib.sha256(t.encode()).digest()).rstrip(b"=").decode()
            for t in tokens]
    assert [r["h"] for r in got.collect()] == want


def test_admission_order(spark):
    def submission(i, **change):
        row = {"ingest_seq": i, "value": json.dumps(GOOD), "client": "c", "received_at": minute(i),
               "http_method": "POST", "content_type": "application/json", "presented_hash": "shared",
               "header_correlation_id": None}
        row.update(change)
        return tuple(row.values())

    rows = [
        submission(1, http_method="GET", presented_hash=None),
        submission(2, presented_hash=None, content_type="text/plain"),
        submission(3, content_type="text/plain"),
        submission(4, value="x" * 70_000, content_type="application/JSON; charset=utf-8"),
        submission(5, value="{"),
        submission(6, value="{}"),
        submission(7),
        submission(8, received_at=minute(7.2), value="{"),
        submission(9, received_at=minute(7.3), content_type=None),
    ]
    df = spark.createDataFrame(
        rows,
        "ingest_seq long, value string, client string, received_at timestamp, http_method string, "
        "content_type string, presented_hash string, header_correlation_id string",
    )
    got = I.admit(df, credentials(spark), shared_hash="shared", max_requests=2)
    assert [r["reason"] for r in got.orderBy("ingest_seq").collect()] == [
        "method_not_allowed", "unauthorized", "content_type", "too_large", "invalid_json",
        "validation", None, "invalid_json", "rate_limited",
    ]
