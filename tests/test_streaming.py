"""The stream against the batch operators on the same submissions, with a stop and a restart."""

from __future__ import annotations

import json
import random
from datetime import timedelta

import pytest
from conftest import START, no_rules
from pyspark.sql import functions as F

from hostpulse.operators import detect, ingest, lifecycle
from hostpulse.sources import read_raw_events, replay_queue
from hostpulse import schemas as S
from hostpulse.sources import materialize, prune_table
from hostpulse.sources.raw import ROW_BITS, SUBMISSION_COLUMNS, number_batch
from hostpulse.streaming import Fleet, start_fleet, stream_new_events, sweep_once


def _lines(seed: int, n: int, start: int):
    rng = random.Random(seed)
    for i in range(start, start + n):
        at = START + timedelta(minutes=i + rng.randrange(-3, 3))
        yield json.dumps(
            {
                "event_id": f"e{rng.randrange(max(i - 5, 0), i + 1)}",
                "host_id": rng.choice(["a", "b", ""]),
                "level": rng.choice(["info", "ERROR"]) if i % 17 else "nope",
                "msg": rng.choice(["x", "y"]),
                "timestamp": at.isoformat() + "Z",
                "cpu_usage": rng.choice([10, 99.5]),
                "ram_usage": 90,
                "disk_usage": rng.choice([None, 95]),
            }
        )


def _drop(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def _plain(transitions):
    columns = [
        "alert_key", "at", "transition", "status", "first_seen", "last_seen", "occurrence_count",
        "message",
    ]
    return sorted(map(tuple, transitions.select(*columns).collect()), key=str)


def _batch(spark, path):
    checked = ingest.validate_events(ingest.parse_events(read_raw_events(spark, str(path))))
    deliveries = ingest.dedupe_events(ingest.normalize_events(checked))
    evals = detect.evaluations(deliveries)
    log = detect.delivery_signals(evals, no_rules(spark))
    return deliveries, lifecycle.alert_transitions(log)


@pytest.mark.parametrize("same_time", [False, True])
def test_stream_equals_batch_across_a_restart(spark, tmp_path, same_time):
    source = tmp_path / "in"
    fleet = Fleet(str(tmp_path / "fleet"), same_time_copies=same_time)
    source.mkdir()
    for number in range(3):
        _drop(source, f"part-{number}.json", _lines(number, 25, number * 25))
        raw = read_raw_events(spark, str(source), streaming=True)
        start_fleet(raw, fleet, once=True).awaitTermination()
    deliveries, transitions = _batch(spark, source)
    stored = fleet.telemetry(spark)
    fresh = deliveries.where("is_new")
    assert stored.count() == fresh.count()
    columns = ["event_id", "message", "event_timestamp", "host_id", "cpu_usage", "disk_usage"]
    assert sorted(map(str, stored.select(*columns).collect())) == sorted(
        map(str, fresh.select(*columns).collect())
    )
    assert _plain(fleet.transitions(spark)) == _plain(transitions)
    assert fleet.rejected(spark).count() == 5
    assert {r["reason"] for r in fleet.rejected(spark).collect()} == {ingest.BAD_LEVEL}


def test_a_repeated_batch_replaces_its_own_results(spark, tmp_path):
    from hostpulse.streaming.fleet import process_batch

    source, fleet = tmp_path / "in", Fleet(str(tmp_path / "fleet"))
    source.mkdir()
    _drop(source, "part-0.json", _lines(1, 20, 0))
    batch = spark.read.text(str(source)).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.current_timestamp().alias("received_at"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "client", "presented_hash", "header_correlation_id", "http_method", "content_type")],
    )
    process_batch(fleet, batch, 0)
    once = _plain(fleet.transitions(spark)), fleet.telemetry(spark).count()
    process_batch(fleet, batch, 0)
    assert (_plain(fleet.transitions(spark)), fleet.telemetry(spark).count()) == once


def test_sweep_opens_and_the_next_event_resolves(spark, tmp_path):
    source, fleet = tmp_path / "in", Fleet(str(tmp_path / "fleet"))
    source.mkdir()

    def report(minutes, name):
        at = (START + timedelta(minutes=minutes)).isoformat() + "Z"
        body = {"event_id": name, "host_id": "a", "level": "INFO", "msg": "m", "timestamp": at,
                "cpu_usage": 1, "ram_usage": 1}
        _drop(source, f"{name}.json", [json.dumps(body)])
        start_fleet(
            read_raw_events(spark, str(source), streaming=True), fleet, once=True
        ).awaitTermination()

    report(0, "first")
    quiet = START + timedelta(minutes=9)
    assert sweep_once(spark, fleet, now=quiet).count() == 0
    for minutes in (10, 11):
        sweep_once(spark, fleet, now=START + timedelta(minutes=minutes))
    alert = fleet.alerts(spark).collect()[0]
    assert (alert["alert_key"], alert["status"], alert["occurrence_count"]) == (
        "agent-silent@a", "OPEN", 2)
    assert alert["message"] == "no events for 11 minutes (threshold 10)"
    report(20, "second")
    alert = fleet.alerts(spark).collect()[0]
    assert (alert["status"], alert["last_seen"]) == ("RESOLVED", START + timedelta(minutes=20))


def test_outage_queue_is_replayed_without_loss(spark, tmp_path):
    """Five events before and five queued during an outage: ten stored, none lost."""
    source, queue, fleet = tmp_path / "in", tmp_path / "queue", Fleet(str(tmp_path / "fleet"))
    source.mkdir()
    queue.mkdir()

    def body(i):
        return json.dumps({"event_id": f"e{i}", "level": "ERROR", "msg": f"reading {i} while the link was down",
                           "correlation_id": f"c{i}",
                           "timestamp": f"2026-01-01T00:00:{i:02d}Z", "cpu_usage": 1, "ram_usage": 1})

    for i in range(5, 10):
        (queue / f"event-17{i}-{i}.json").write_text(body(i))
    (queue / "event-179-9.json.tmp").write_text("{")
    _drop(source, "before.json", [body(i) for i in range(5)])
    start_fleet(read_raw_events(spark, str(source), streaming=True), fleet, once=True).awaitTermination()
    pending = replay_queue(spark, str(queue))
    assert [r["ingest_seq"] for r in pending.orderBy("ingest_seq").collect()] == [1, 2, 3, 4, 5]
    assert json.loads(pending.orderBy("ingest_seq").first()["value"])["event_id"] == "e5"
    replay = Fleet(str(tmp_path / "fleet2"))
    start_fleet(replay_queue(spark, str(queue), streaming=True), replay, once=True).awaitTermination()
    stored = fleet.telemetry(spark).unionByName(replay.telemetry(spark))
    assert stored.count() == 10
    assert stored.where("event_id = 'e7'").first()["correlation_id"] == "c7"


def test_queue_of_many_files(spark, tmp_path):
    """Ranks follow the file names over several ranges; every file is read, and none of the sorting is one task's."""
    for i in range(60):
        folder = tmp_path / f"agent {i % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"event-{1000 - i}-{i}.json").write_text(f"{i}")
    (tmp_path / "agent 0" / "event-1.json.tmp").write_text("{")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges for few rows
    try:
        pending = replay_queue(spark, str(tmp_path), recursive=True)
        got = [(r["ingest_seq"], r["value"]) for r in pending.orderBy("ingest_seq").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    names = sorted((f"event-{1000 - i}-{i}.json", str(i)) for i in range(60))
    assert got == [(n, value) for n, (_, value) in enumerate(names, 1)]


def test_queue_fixture_is_written_by_many_tasks(spark, tmp_path):
    from hostpulse.plans import fixtures

    rows = [(f"host-{i}", i, f'{{"event_id":"e{i}"}}') for i in range(500)] + [(None, 7, "{}")]
    schema = "host_id string, ingest_seq long, value string"
    fixtures.write_queue(spark.createDataFrame(rows, schema), str(tmp_path / "queue"))
    assert len(list((tmp_path / "queue").iterdir())) > 32
    found = replay_queue(spark, str(tmp_path / "queue"), recursive=True)
    assert sorted(r["value"] for r in found.collect()) == sorted(value for _, _, value in rows)


def test_stateful_dedupe(spark, tmp_path):
    rows = [("a", 1, START), ("b", 2, START)]
    schema = "event_id string, n int, event_timestamp timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        events = stream_new_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option(
            "path", str(tmp_path / "out")
        ).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2
    spark.createDataFrame([("a", 3, START), ("c", 4, START)], schema).coalesce(1).write.mode(
        "append"
    ).parquet(str(tmp_path / "in"))
    assert run() == 3


def test_agent_credentials_bind_the_host(spark, tmp_path):
    from hostpulse.schemas import CREDENTIALS

    table = str(tmp_path / "credentials")
    spark.createDataFrame(
        [("id1", "bound", None, "hash", START, None, None)], CREDENTIALS
    ).write.parquet(table)
    fleet = Fleet(str(tmp_path / "fleet"), credentials=table)
    source = tmp_path / "in"
    source.mkdir()
    _drop(source, "one.json", list(_lines(3, 3, 1)))
    raw = read_raw_events(spark, str(source), streaming=True)
    signed = raw.withColumn(
        "presented_hash", F.when(~F.col("value").contains('"b"'), F.lit("hash"))
    )
    start_fleet(signed, fleet, once=True).awaitTermination()
    hosts = {r["host_id"] for r in fleet.telemetry(spark).collect()}
    assert hosts <= {"bound"}
    reasons = {r["reason"] for r in fleet.rejected(spark).collect()}
    assert reasons <= {"unauthorized"}


@pytest.mark.parametrize("streaming", [False, True])
def test_raw_columns(spark, tmp_path, streaming):
    _drop(tmp_path, "b.json", ["3", "4"])
    _drop(tmp_path, "a.json", ["1", "2"])
    raw = read_raw_events(spark, str(tmp_path), streaming=streaming)
    assert raw.isStreaming == streaming
    if not streaming:
        assert [r["value"] for r in raw.orderBy("ingest_seq").collect()] == ["1", "2", "3", "4"]
        assert raw.select("ingest_seq").distinct().count() == 4


def test_numbers_of_a_split_file_follow_its_lines(spark, tmp_path):
    wide = "x" * 40
    (tmp_path / "big.json").write_text("".join(f"{i:07d}{wide}\n" for i in range(250_000)))
    (tmp_path / "a.json").write_text("-000001\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(3 << 20))
    try:
        raw = read_raw_events(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 1
        rows = raw.orderBy("ingest_seq").selectExpr("int(substr(value, 1, 7)) as n").toPandas()["n"]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        with pytest.raises(ValueError):
            read_raw_events(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.tolist() == list(range(-1, 250_000))


def _event(event_id, host, minutes):
    at = (START + timedelta(minutes=minutes)).isoformat() + "Z"
    return json.dumps({"event_id": event_id, "host_id": host, "level": "INFO", "msg": "m", "timestamp": at,
                       "cpu_usage": 1, "ram_usage": 1})


def test_sweep_after_a_redelivery_counts_last(spark, tmp_path):
    """Opened by a sweep, resolved by a repeated delivery, opened again: the newest state is that of the last sweep."""
    source, fleet = tmp_path / "in", Fleet(str(tmp_path / "fleet"))
    source.mkdir()
    raw = read_raw_events(spark, str(source), streaming=True)

    def deliver(name):
        _drop(source, name, [_event("only", "quiet", 0)])
        start_fleet(raw, fleet, once=True).awaitTermination()

    deliver("first.json")
    assert sweep_once(spark, fleet, now=START + timedelta(hours=2)).count() == 1
    deliver("again.json")
    assert fleet.alerts(spark).where("alert_type = 'AGENT_SILENT'").first()["status"] == "RESOLVED"
    sweep_once(spark, fleet, now=START + timedelta(hours=3))
    alert = fleet.alerts(spark).where("alert_type = 'AGENT_SILENT'").first()
    assert (alert["status"], alert["occurrence_count"]) == ("OPEN", 2)


def test_every_host_is_swept_and_half_a_batch_is_not_read(spark, tmp_path):
    source, fleet = tmp_path / "in", Fleet(str(tmp_path / "fleet"))
    source.mkdir()
    _drop(source, "all.json", [_event(f"e{i}", f"h{i:03d}", i / 100) for i in range(230)])
    raw = read_raw_events(spark, str(source), streaming=True)
    late = START + timedelta(hours=2)
    start_fleet(raw, fleet, once=True, clock=lambda: late).awaitTermination()
    assert fleet.alerts(spark).where("status = 'OPEN' AND alert_type = 'AGENT_SILENT'").count() == 230
    fleet.telemetry(spark).drop("version").limit(5).write.parquet(fleet.path("telemetry/version=000000000009-000000"))
    assert fleet.telemetry(spark).count() == 230


def test_retention_on_the_streams_table(spark, tmp_path):
    source, fleet = tmp_path / "in", Fleet(str(tmp_path / "fleet"))
    source.mkdir()
    for part in range(2):
        _drop(source, f"{part}.json", [_event(f"e{i}", "h", i * 720) for i in range(part * 10, part * 10 + 10)])
        start_fleet(read_raw_events(spark, str(source), streaming=True), fleet, once=True).awaitTermination()
    now = START + timedelta(minutes=19 * 720)
    gone = prune_table(spark, fleet.path("telemetry"), schema=S.TELEMETRY, time_col="event_timestamp", now=now, days=3)
    assert gone == 13
    assert sorted(r["event_id"] for r in fleet.telemetry(spark).select("event_id").collect()) == sorted(f"e{i}" for i in range(13, 20))


def test_numbers_follow_whatever_came_before(spark):
    """A batch is numbered above the last number received, however many batches there were."""
    rows = [("x", None, f, start) for f, start in [("/q/b", 0), ("/q/a", 0), ("/q/a", 7)]]
    schema = "value string, received_at timestamp, file string, split_start long"
    unset = [F.lit(None).cast("string").alias(name) for name in SUBMISSION_COLUMNS]
    batch = spark.createDataFrame(rows, schema).coalesce(1).select("*", *unset)
    blocks = 1 << 37  # more than five million batches of 20,000 splits each
    for after in (-1, 5, (blocks << ROW_BITS) + 17):
        numbers = [r["ingest_seq"] for r in number_batch(batch, after).orderBy("ingest_seq").collect()]
        assert len(set(numbers)) == 3 and numbers[0] > after
    with pytest.raises(Exception, match="does not fit"):
        number_batch(batch, (1 << 63) - 1).collect()


def _numbered(spark, lines, **columns):
    """Submissions as a stream hands them to a batch; columns not named are unset."""
    rows = spark.createDataFrame([(line, "f", 0) for line in lines], "value string, file string, split_start long").coalesce(1)
    told = {name: columns.get(name, F.lit(None).cast("string")) for name in SUBMISSION_COLUMNS}
    return rows.select("*", columns.get("received_at", F.current_timestamp()).alias("received_at"), *(c.alias(n) for n, c in told.items()))


def test_a_repeated_batch_neither_counts_nor_sweeps_again(spark, tmp_path):
    from hostpulse.streaming.fleet import process_batch

    fleet = Fleet(str(tmp_path / "fleet"), id_buckets=4, retention_days=30)
    batch = _numbered(spark, [_event("one", "q", 0)])
    late = F.lit(START + timedelta(hours=2))

    def state():
        alert = fleet.alerts(spark).where("alert_key = 'agent-silent@q'").first()
        return alert["occurrence_count"], fleet.transitions(spark).count(), fleet.telemetry(spark).count(), fleet.finished(spark)

    process_batch(fleet, batch, 0, now=late)
    once = state()
    assert once[0] == 1 and once[2] == 1
    process_batch(fleet, batch, 0, now=late)
    assert state() == once
    process_batch(fleet, _numbered(spark, [_event("one", "q", 0), _event("two", "q", 60 * 24 * 40), "{"]), 1, now=F.lit(START + timedelta(days=41)))
    assert {(r["outcome"], r["reason"], r["n"]) for r in fleet.outcomes(spark).collect()} == {
        ("received", None, 2), ("duplicate", None, 1), ("rejected", ingest.INVALID_JSON, 1)
    }
    # the batch's clock is 41 days on: retention has taken the first event
    assert [r["event_id"] for r in fleet.telemetry(spark).collect()] == ["two"]


def test_admission_rules_and_notifications_of_the_stream_equal_one_batch(spark, tmp_path):
    """Three batches with a rule change and a delivery between them, against the batch operators on all submissions."""
    from hostpulse.operators import notify
    from hostpulse.operators.rules import RuleLog
    from hostpulse.streaming.fleet import process_batch

    rules, log = str(tmp_path / "rules"), str(tmp_path / "deliveries")
    spark.createDataFrame([(1, "cpu-high@h", "alert.opened", "DELIVERED", 200, None, 1, START + timedelta(minutes=3))], S.DELIVERIES).withColumn(
        "event_date", F.to_date("attempted_at")
    ).write.partitionBy("event_date").parquet(log)
    no_rules(spark).write.parquet(rules)
    fleet = Fleet(str(tmp_path / "fleet"), rules=rules, deliveries=log, max_requests=1, window_ms=600_000, id_buckets=4)
    bodies = [
        json.dumps({"event_id": f"e{i}", "host_id": "h", "level": "INFO", "msg": "m", "cpu_usage": 95, "ram_usage": 1,
                    "timestamp": (START + timedelta(minutes=4 * i)).isoformat() + "Z"}) for i in range(30)
    ]
    method = {"http_method": F.lit("POST"), "content_type": F.lit("application/json")}
    client = F.concat(F.lit("c"), (F.get_json_object("value", "$.event_id").substr(2, 9).cast("int") % 2).cast("string"))
    at = F.get_json_object("value", "$.timestamp").cast("timestamp")
    table = lambda part: _numbered(spark, part, client=client, received_at=at, **method)
    for number, (low, high) in enumerate([(0, 8), (8, 20), (20, 30)]):
        if number == 1:
            changed = spark.createDataFrame([("HIGH_CPU", "h", 99.0, True, START)], S.RULES)
            changed.write.mode("overwrite").parquet(rules)
        process_batch(fleet, table(bodies[low:high]), number)
    whole = table(bodies).withColumn("ingest_seq", F.get_json_object("value", "$.event_id").substr(2, 9).cast("long")).withColumn("method", F.lit("open"))
    whole = materialize(whole, "whole")
    limited = ingest.limit_requests(ingest.asked_requests(whole), max_requests=1, window_ms=600_000, target=None)
    admitted = materialize(ingest.admission_reason(ingest.admitted_bodies(whole, limited, max_requests=1)).drop("j"), "admitted")
    accepted = admitted.where("reason IS NULL").withColumn("j", F.try_parse_json("value"))
    deliveries = materialize(ingest.dedupe_events(ingest.normalize_events(accepted)), "deliveries")
    change = spark.createDataFrame([(1, "HIGH_CPU", "h", 99.0, True, False, 7)], "version long, rule_type string, host_id string, threshold double, enabled boolean, deleted boolean, ingest_seq long")
    evals = materialize(detect.evaluations(deliveries, target=None), "evaluations")
    signals = materialize(detect.delivery_signals(evals, RuleLog(change)), "signals")
    transitions = materialize(lifecycle.alert_transitions(signals, target=None), "transitions")
    assert _plain(fleet.transitions(spark)) == _plain(transitions)
    refused = admitted.where("reason IS NOT NULL")
    assert fleet.rejected(spark).count() == refused.count() > 0
    outbox = notify.notification_outbox(notify.notification_policy(transitions, spark.read.parquet(log), target=None))
    payloads = lambda box: sorted(r["payload"] for r in box.collect())
    assert payloads(fleet.outbox(spark)) == payloads(outbox)
    assert any("alert.reminder" in p for p in payloads(outbox))
