"""Ordered operators against plain event-by-event folds, with and without split hot keys."""

from __future__ import annotations

import random
from collections import deque

import pytest
from conftest import event, minute, no_rules, rule_table, telemetry
from pyspark.sql import functions as F

from hostpulse.operators import agents, credentials, detect, lifecycle, notify
from hostpulse.operators.anchors import NEVER, mark_anchors
from hostpulse.operators.hot_keys import split_hot
from hostpulse.operators.ingest import dedupe_events, rate_limit_decisions

TARGETS = [None, 1_000_000, 5]


def _random_deliveries(seed: int, n: int = 160):
    rng = random.Random(seed)
    rows, seq = [], 0
    for i in range(n):
        seq += rng.choice([1, 1, 2, 30])
        rows.append(
            event(
                seq,
                event_id=f"e{rng.randrange(i + 1) if rng.random() < 0.35 else i}",
                host_id=rng.choice(["hot", "hot", "hot", "a", "b"]),
                level=rng.choice(["INFO", "ERROR", "CRITICAL"]),
                message=rng.choice(["x", "y", "z"]),
                event_timestamp=minute(seq + rng.randrange(-20, 20)),
                cpu_usage=float(rng.randrange(100)),
                ram_usage=float(rng.randrange(100)),
                disk_usage=rng.choice([None, 50.0, 95.0]),
                disk_path="/",
            )
        )
    return rows


def _windows(rows, size=5):
    """Event by event: first arrivals enter their host's window, every arrival evaluates it."""
    seen, windows, counts, out = set(), {}, {}, []
    for seq, eid, level, message, at, host, _n, _v, _q, cpu, ram, disk, path in rows:
        new = eid not in seen
        if new:
            seen.add(eid)
            windows.setdefault(host, deque(maxlen=size)).append(
                (at, level, message, cpu, ram, disk, path)
            )
            counts[host] = counts.get(host, 0) + 1
        window = windows.get(host)
        if not window:
            continue
        last = window[-1]
        out.append(
            (
                seq,
                host,
                counts[host],
                new,
                last[0],
                round(sum(w[3] for w in window) / len(window), 9),
                round(sum(w[4] for w in window) / len(window), 9),
                len(window),
                last[5],
                last[6],
                sorted(w[2] for w in window if w[1] in ("ERROR", "CRITICAL")),
            )
        )
    return sorted(out)


def _collected(evals):
    rows = evals.select(
        "ingest_seq", "host_id", "pos", "is_new", "now", F.round("avg_cpu", 9), F.round("avg_ram", 9),
        "size", "disk_usage", "disk_path", F.array_sort("errors"),
    ).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("target", TARGETS)
@pytest.mark.parametrize("seed", [1, 2])
def test_evaluations_equal_a_fold(spark, seed, target):
    rows = _random_deliveries(seed)
    deliveries = dedupe_events(telemetry(spark, rows))
    assert _collected(detect.evaluations(deliveries, target=target)) == _windows(rows)


@pytest.mark.parametrize("target", [1_000_000, 4])
def test_evaluations_continue_from_stored_windows(spark, target):
    rows = _random_deliveries(5)
    deliveries = dedupe_events(telemetry(spark, rows)).persist()
    cut = rows[70][0]
    early, late = deliveries.where(F.col("ingest_seq") <= cut), deliveries.where(
        F.col("ingest_seq") > cut
    )
    state = detect.window_state(early)
    first = _collected(detect.evaluations(early, target=target))
    second = _collected(detect.evaluations(late, tails=state, target=target))
    assert sorted(first + second) == _windows(rows)
    middle = rows[120][0]
    part = late.where(F.col("ingest_seq") <= middle)
    state = detect.window_state(part, tails=state)
    third = detect.evaluations(late.where(F.col("ingest_seq") > middle), tails=state)
    assert _collected(third) == [r for r in _windows(rows) if r[0] > middle]


def _fold_alerts(signals):
    """The lifecycle one signal at a time."""
    alerts, out = {}, []
    for key, kind, seq, sub, at, message in signals:
        state = alerts.get(key)
        if kind == "BREACH":
            if state is None:
                state = alerts[key] = {"status": "OPEN", "first": at, "n": 1}
                change = "OPENED"
            else:
                change = "OCCURRENCE" if state["status"] != "RESOLVED" else "REOPENED"
                if change == "REOPENED":
                    state["status"] = "OPEN"
                state["n"] += 1
            state["last"], state["message"] = at, message
        elif state is None:
            continue
        elif kind == "ACK":
            if state["status"] != "OPEN":
                continue
            state["status"], change = "ACKNOWLEDGED", "ACKNOWLEDGED"
        else:
            if state["status"] == "RESOLVED":
                continue
            state["status"], state["last"], change = "RESOLVED", at, "RESOLVED"
        out.append(
            (key, seq, sub, change, state["status"], state["first"], state["last"], state["n"],
             state["message"])
        )
    return sorted(out)


def _random_signals(seed, n=220):
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.choice([0, 1, 1, 25])
        kind = rng.choice(["BREACH", "BREACH", "CLEAR", "ACK", "RESOLVE"])
        rows.append((rng.choice(["hot", "hot", "k"]), kind, seq, len(rows), minute(len(rows)),
                     f"m{len(rows)}"))
    return rows


def _signals(spark, rows):
    df = spark.createDataFrame(
        rows, "alert_key string, kind string, ingest_seq long, sub_seq int, at timestamp, message string"
    )
    text, number = F.lit("T"), F.lit(None).cast("double")
    return df.select(
        "alert_key", text.alias("alert_type"), F.lit("h").alias("host_id"), "ingest_seq", "sub_seq",
        "at", "kind", number.alias("value"), number.alias("threshold"), "message",
    )


def _changes(transitions):
    rows = transitions.select(
        "alert_key", "ingest_seq", "sub_seq", "transition", "status", "first_seen", "last_seen",
        "occurrence_count", "message",
    ).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("target", TARGETS)
@pytest.mark.parametrize("seed", [1, 2])
def test_transitions_equal_a_fold(spark, seed, target):
    rows = _random_signals(seed)
    got = lifecycle.alert_transitions(_signals(spark, rows), target=target)
    assert _changes(got) == _fold_alerts(rows)


@pytest.mark.parametrize("target", [1_000_000, 5])
def test_transitions_continue_from_stored_state(spark, target):
    rows = _random_signals(9)
    want = _fold_alerts(rows)
    cuts = [0, 40, 41, 130, len(rows)]
    state, got = None, []
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = _signals(spark, rows[low:high])
        got += _changes(lifecycle.alert_transitions(part, state=state, target=target))
        after = lifecycle.alert_state(part, state=state, target=target)
        state = spark.createDataFrame(after.collect(), after.schema)
    assert sorted(got) == want


def _fold_anchors(rows, gap, entry):
    threshold, anchor, out = dict(), dict(), []
    for key, t, tie, forced in sorted(rows, key=lambda r: (r[0], r[1], not r[3], r[2])):
        reach = threshold.get(key, entry)
        hit = forced or t >= reach
        if hit:
            anchor[key], threshold[key] = t, t + gap
        out.append((key, tie, anchor.get(key), hit))
    return sorted(out)


@pytest.mark.parametrize("target", TARGETS)
@pytest.mark.parametrize("entry,share", [(-NEVER, 0.0), (NEVER, 0.08), (-NEVER, 0.1)])
def test_anchors_equal_a_walk(spark, entry, share, target):
    rng = random.Random(int(share * 100))
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 1, 2, 3, 40])
        rows.append((rng.choice(["hot", "hot", "k"]), t, i, rng.random() < share))
    df = spark.createDataFrame(rows, "key string, t long, tie long, must boolean")
    for gap in (7, 100):
        got = mark_anchors(
            df, "key", "t", tie="tie", gap=gap, entry=entry, forced="must", target=target
        ).select("key", "tie", "anchor", "is_anchor")
        assert sorted(tuple(r) for r in got.collect()) == _fold_anchors(rows, gap, entry)


@pytest.mark.parametrize("target", TARGETS)
def test_rate_limit(spark, target):
    rng = random.Random(4)
    rows, at = [], 0.0
    for i in range(120):
        at += rng.choice([0.0, 0.1, 0.2, 2.0])
        rows.append((rng.choice("aab"), minute(at), i))
    started, count, want = {}, {}, []
    for client, at, seq in rows:
        if client not in started or (at - started[client]).total_seconds() >= 60:
            started[client], count[client] = at, 0
        count[client] += 1
        want.append((seq, started[client], count[client] <= 4))
    got = rate_limit_decisions(
        spark.createDataFrame(rows, "client string, at timestamp, seq long"),
        max_requests=4,
        target=target,
    ).select("seq", "window_started_at", "allowed")
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("target", TARGETS)
def test_queue_depth_equals_a_walk(spark, target):
    rng = random.Random(6)
    rows, held, want = [], {}, []
    for i in range(250):
        host = rng.choice(["hot", "hot", "k"])
        depth = held.get(host, 0)
        change = -1 if depth and rng.random() < 0.35 else 1
        dropped = change > 0 and depth >= 6
        held[host] = depth if dropped else depth + change
        rows.append((host, minute(i), i, change))
        want.append((host, i, held[host], dropped))
    got = agents.queue_depth_timeline(
        spark.createDataFrame(rows, "host_id string, at timestamp, seq long, change int"),
        capacity=6,
        target=target,
    ).select("host_id", "seq", "depth", "dropped")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("target", TARGETS)
def test_delivery_stalls_equal_a_walk(spark, target):
    rng = random.Random(8)
    attempts, ticks, want = [], [], []
    for host in ("hot", "k"):
        ok, failed, alerted = minute(0), False, False
        attempts.append((host, minute(0), "delivered"))
        for i in range(1, 120):
            if i % 3 == 0:
                ticks.append((host, minute(i)))
                gap = minute(i) - ok
                stalled = failed and gap.total_seconds() >= 300
                if stalled != alerted:
                    alerted = stalled
                    name = "delivery_stalled" if stalled else "delivery_recovered"
                    want.append((host, minute(i), name, int(gap.total_seconds())))
                continue
            outcome = rng.choices(["delivered", "queued", "failed", "rejected"], [2, 5, 2, 3])[0]
            if outcome == "delivered":
                ok, failed = minute(i), False
            elif outcome != "rejected":
                failed = True
            attempts.append((host, minute(i), outcome))
    got = agents.delivery_stalls(
        spark.createDataFrame(attempts, "host_id string, at timestamp, outcome string"),
        spark.createDataFrame(ticks, "host_id string, at timestamp"),
        target=target,
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert want


def test_hot_key_is_cut_and_others_are_not(spark):
    rows = spark.range(1000).selectExpr(
        "case when id % 3 = 0 then 'hot' else cast(id as string) end as k", "id as o"
    )
    every, only_hot = split_hot(rows, "k", "o", target=100)
    sizes = {r["chunk"]: r["n"] for r in only_hot.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 334 and max(sizes.values()) <= 110 and len(sizes) >= 4
    assert every.where("k <> 'hot' and chunk <> 0").count() == 0 and every.count() == 1000


def test_reminders(spark):
    occurrences = spark.createDataFrame(
        [("a", minute(n), i) for i, n in enumerate([0, 5, 16, 20, 31, 32, 60])],
        "alert_key string, at timestamp, ingest_seq long",
    )
    log = spark.createDataFrame(
        [("a", "DELIVERED", minute(1)), ("a", "FAILED", minute(2)), ("a", "DELIVERED", minute(40))],
        "alert_key string, delivery_status string, attempted_at timestamp",
    )
    due = notify.reminder_due(occurrences, log).where("due").select("ingest_seq").collect()
    assert sorted(r[0] for r in due) == [2, 4, 6]
    never = notify.reminder_due(occurrences, log.where("delivery_status = 'FAILED'"))
    assert never.where("due").count() == 0
    assert notify.reminder_due(occurrences, log, cooldown_s=0).where("due").count() == 0


def test_credential_use_is_throttled(spark):
    table = spark.createDataFrame(
        [("x", None), ("y", minute(0)), ("z", minute(0))], "id string, last_used_at timestamp"
    )
    uses = spark.createDataFrame(
        [("x", minute(1)), ("x", minute(1.5)), ("x", minute(11)), ("x", minute(12)),
         ("y", minute(5)), ("z", minute(5.1))],
        "id string, at timestamp",
    )
    got = {r["id"]: r["last_used_at"] for r in credentials.credential_last_used(table, uses).collect()}
    assert got == {"x": minute(11), "y": minute(0), "z": minute(5.1)}


def test_signals_of_a_hot_host(spark):
    rows = _random_deliveries(11)
    deliveries = dedupe_events(telemetry(spark, rows))
    rules = rule_table(spark, [("HIGH_CPU", "*", 50.0, True), ("REPEATED_ERROR", "hot", 2.0, True)])
    plain = detect.delivery_signals(detect.evaluations(deliveries), rules)
    split = detect.delivery_signals(detect.evaluations(deliveries, target=9), rules)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    assert detect.delivery_signals(detect.evaluations(deliveries), no_rules(spark)).count() > 0


def test_fleet_rules_leave_the_rows_with_their_hosts(spark):
    """Rules as of each row: the work after them is dealt by host, not by the slices of the one fleet key."""
    from hostpulse.operators import rules as R

    rows = spark.range(4000).selectExpr("concat('h', id % 50) AS host_id", "id * 10 AS ingest_seq")
    log = spark.range(1000).selectExpr(
        "id AS version", "id * 40 + 1 AS ingest_seq", "'HIGH_CPU' AS rule_type", "IF(id % 5 = 0, concat('h', id % 50), NULL) AS host_id",
        "CAST(id % 90 AS DOUBLE) AS threshold", "true AS enabled", "timestamp'2024-01-01' AS updated_at",
    )
    judged = [R.with_effective_rules(rows, R.RuleLog(log, slice_rows=n), spread="ingest_seq", rule_types=("HIGH_CPU",)) for n in (300, 10**9)]
    plan = judged[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "host_id" in next(line for line in plan.splitlines() if "Window" in line).split("windowspecdefinition(")[1].split(",")[0]
    small, whole = (sorted((r["ingest_seq"], r["rule_HIGH_CPU"]["threshold"], r["rule_HIGH_CPU"]["source"]) for r in j.collect()) for j in judged)
    assert small == whole and len(small) == 4000
    assert {source for _, _, source in small} == {"default", "fleet", "host"}
