"""Versioned tables, the id index, state carried across batches, and as-of rules against plain walks."""

from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import START
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostpulse import schemas as S
from hostpulse.operators import id_index as X
from hostpulse.operators import ingest as I
from hostpulse.operators import maintain as M
from hostpulse.operators import notify as N
from hostpulse.operators import queries as Q
from hostpulse.operators import rules as R
from hostpulse.operators.asof import as_of
from hostpulse.sources import materialize
from hostpulse.sources.versions import Versions, due_for_merge, merged_name


def test_merge_levels():
    folders = [f"{i:012d}-000000" for i in range(3)]
    assert due_for_merge(folders, 3) == folders and due_for_merge(folders, 4) == []
    one = merged_name(folders)
    assert folders[-1] < one < "000000000002-000001" and merged_name([one]) == "000000000002-000000.2"
    assert due_for_merge([one, *folders], 3) == folders and due_for_merge([one, folders[0], one, one], 2) == [one, one]


def test_commits_are_whole_and_folders_stay_few(spark, tmp_path):
    store = Versions(spark, str(tmp_path), fan_in=3)
    for n in range(14):
        before, version = store.newest(), f"{n:012d}-000000"
        rows = spark.range(n, n + 1).select(F.col("id").cast("long").alias("n"))
        store.write(rows, "numbers", version)
        store.write(rows, "state/last", version)
        if n == 5:  # broke off before its commit, and is done again
            assert store.table("numbers").count() == 5
            store.write(rows, "numbers", version)
        after = store.commit(version, before, tables={"numbers": rows.schema}, states={"last": rows.schema}, numbers={"n": n})
        with pytest.raises(ValueError):
            store.commit(version, after, tables={})
        after = store.compact(after)
        assert sorted(r["n"] for r in store.table("numbers").collect()) == list(range(n + 1))
        assert [r["n"] for r in store.state("last").collect()] == [n] and after.numbers == {"n": n}
        # two of each of three levels at most
        assert len(after.tables["numbers"]) <= 6
    assert len(list((tmp_path / "snapshots").glob("0*.json"))) <= 3
    assert len(list((tmp_path / "numbers").iterdir())) <= 10 and len(list((tmp_path / "state/last").iterdir())) <= 4


def test_bloom_filters_never_miss():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = X.bloom_bits(h[:4000])
    assert X.may_hold(bits, h[:4000]).all()
    assert X.may_hold(bits, h[4000:]).mean() < 0.05
    assert not X.may_hold(X.bloom_bits(h[:0]), h).any()


def test_a_batch_opens_only_files_that_may_hold_its_ids(spark, tmp_path):
    folders = []
    for part in range(2):
        ids = spark.range(part * 400, part * 400 + 400).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit(START.date()).alias("event_date"))
        folders.append(f"v{part}")
        X.write_ids(ids, str(tmp_path / f"ids{part}"), str(tmp_path / f"blooms{part}"), buckets=16)
    blooms = spark.read.schema(X.BLOOMS).parquet(*(str(tmp_path / f"blooms{p}") for p in range(2)))
    assert blooms.count() >= 32
    few = spark.createDataFrame([("e7",), ("e777",), ("new",), (None,)], "event_id string")
    files = X.files_to_open(few, blooms, buckets=16)
    assert 2 <= len(files) <= 3
    stored = X.stored_ids(few, folders, blooms, buckets=16)
    names = lambda paths: sorted(p.rsplit("/", 1)[-1] for p in paths)
    assert names(stored.inputFiles()) == names(files)
    events = spark.createDataFrame([(1, "e7"), (2, "new"), (3, "new"), (4, None), (5, "e777")], "ingest_seq long, event_id string")
    flags = {r["ingest_seq"]: r["is_new"] for r in I.dedupe_events(events, stored=stored).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: True, 5: False}
    none = spark.createDataFrame([("x",), ("y",)], "event_id string")
    if not X.files_to_open(none, blooms, buckets=16):
        assert X.stored_ids(none, folders, blooms, buckets=16).count() == 0


def test_limiter_goes_on_across_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), START + timedelta(seconds=i * 7), i) for i in range(120)]
    table = lambda part: spark.createDataFrame(part, "client string, at timestamp, seq long")
    limits = {"max_requests": 3, "window_ms": 60_000}
    want = {r["seq"]: (r["allowed"], r["window_started_at"]) for r in I.rate_limit_decisions(table(rows), **limits).collect()}
    state, got = None, {}
    for part in (rows[:37], rows[37:41], rows[41:]):
        limited = materialize(I.limit_requests(table(part), state=state, **limits), "limited")
        decided = I.rate_limit_decisions(table(part), state=state, **limits)
        got |= {r["seq"]: (r["allowed"], r["window_started_at"]) for r in decided.collect()}
        state = materialize(I.limiter_state(limited, state, **limits), "limiter")
    assert got == want
    assert state.count() <= 3
    # a request older than the open window counts in it
    late = table([(r["client"], START, 500 + i) for i, r in enumerate(state.collect()) for _ in range(1)])
    assert {r["window_started_at"] for r in I.rate_limit_decisions(late, state=state, **limits).collect()} == {
        r["t"] for r in state.select(F.timestamp_millis("started_ms").alias("t")).collect()
    }


def test_reminders_go_on_across_batches(spark):
    rng = random.Random(6)
    kinds = ["OCCURRENCE"] * 6 + ["OPENED", "RESOLVED"]
    rows = [(rng.choice("xyz"), START + timedelta(minutes=i), rng.choice(kinds), i, i % 3) for i in range(150)]
    log = [(i, rng.choice("xyz"), "alert.opened", rng.choice(["DELIVERED", "FAILED"]), 200, None, 1, START + timedelta(minutes=9 * i, seconds=30)) for i in range(16)]
    table = lambda part: spark.createDataFrame(part, "alert_key string, at timestamp, transition string, ingest_seq long, sub_seq int")
    deliveries = lambda part: spark.createDataFrame(part, S.DELIVERIES)
    plain = lambda policy: {(r["ingest_seq"], r["event_type"], r["decision"]) for r in policy.collect()}
    want = plain(N.notification_policy(table(rows), deliveries(log), cooldown_s=900))
    assert any(e == N.REMINDER for _, e, _ in want)
    state, got, cuts = None, set(), (0, 60, 61, 150)
    for low, high in zip(cuts, cuts[1:]):
        since, until = START + timedelta(minutes=low), START + timedelta(minutes=high)
        new = deliveries([d for d in log if since <= d[-1] < until])
        part = table(rows[low:high])
        marked = materialize(N.fold_reminders(part, new, cooldown_s=900, state=state), "reminders")
        got |= plain(N.notification_policy(part, new, cooldown_s=900, marked=marked))
        state = materialize(N.reminder_state(marked, state), "reminder-state")
    assert got == want


def plain_as_of(rows, changes):
    out = []
    for key, order in rows:
        told = [c for c in changes if c[0] == key and key is not None and c[1] < order and c[2] is not None]
        out.append((key, order, max(told, key=lambda c: c[1])[2] if told else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("target", [None, 7, 1_000_000])
def test_as_of_equals_plain_walk(spark, target):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), i * 2) for i in range(100)]
    changes = [(rng.choice(["a", "b", "c", None]), n, rng.choice([None, n * 10, n])) for n in rng.sample(range(200), 40)]
    left = spark.createDataFrame([(k, o, "kept") for k, o in rows], "k string, o long, x string")
    right = spark.createDataFrame(changes, "k string, o long, v int")
    got = as_of(left, right, "k", "o", {"value": F.col("v")}, target=target)
    assert got.columns == ["k", "o", "x", "value"]
    assert sorted((tuple(r)[:2] + (r["value"],) for r in got.collect()), key=str) == plain_as_of(rows, changes)


def test_rules_change_from_the_next_event(spark):
    log = [
        (1, "HIGH_CPU", None, 50.0, True, False, 10), (2, "HIGH_CPU", "h", 70.0, False, False, 20), (3, "HIGH_CPU", "h", 400.0, True, False, 25),
        (4, "HIGH_CPU", "h", None, None, True, 30), (5, "HIGH_CPU", None, None, None, True, 40),
    ]
    schema = "version long, rule_type string, host_id string, threshold double, enabled boolean, deleted boolean, ingest_seq long"
    rows = spark.createDataFrame([("h", n) for n in (10, 11, 20, 21, 26, 31, 41)] + [("g", 26), (None, 26)], "host_id string, ingest_seq long")
    got = R.effective_rules_as_of(rows, R.RuleLog(spark.createDataFrame(log, schema), slice_rows=3), rule_types=("HIGH_CPU",))
    told = {(r["host_id"], r["ingest_seq"]): (r["threshold"], r["enabled"], r["source"]) for r in got.collect()}
    fleet, default = (50.0, True, "fleet"), (85.0, True, "default")
    assert told == {
        ("h", 10): default, ("h", 11): fleet, ("h", 20): fleet, ("h", 21): (70.0, False, "host"), ("h", 26): (70.0, False, "host"),
        ("h", 31): fleet, ("h", 41): default, ("g", 26): fleet, (None, 26): fleet,
    }


def test_dense_values_are_spread_and_ranked_exactly(spark):
    values = spark.range(100_000).select((100 + F.col("id") / 100_000).alias("v"))
    values = values.union(values.where("v > 100.999").withColumn("v", F.lit(-5.0)))
    got = {r["metric"]: r["value"] for r in M.nearest_rank(values, "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}).collect()}
    every = sorted([100 + i / 100_000 for i in range(100_000)] + [-5.0] * 99)
    rank = lambda f: every[max(1, -int(-f * len(every) // 1)) - 1]
    assert got == {"p50": rank(0.5), "p99": rank(0.99), "p0": -5.0}
    few = spark.createDataFrame([(3.0,), (1.0,), (None,), (1.0,)], "v double")
    assert {r["value"] for r in M.nearest_rank(few, "v", {"p50": 0.5, "p100": 1.0}).collect()} == {1.0, 3.0}


def test_distinct_values_share_no_range(spark):
    rows = spark.range(50_000).select((100 + F.col("id") / 50_000).alias("value"))
    bounds = rows.agg(F.percentile_approx("value", [i / 1024 for i in range(1, 1024)], 10_000)).scalar()
    most = rows.withColumn("b", bounds).groupBy(M._range_of(F.col("value"), F.col("b"))).count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= 200 and most[1] >= 500


def test_pages_follow_a_row(spark):
    schema = T.StructType([f for f in S.TELEMETRY.fields])
    rows = [(i, f"e{i}", None, "INFO", "m", START + timedelta(minutes=i // 3), "h", None, None, None, 1.0, 1.0, None, None) for i in range(40)]
    tel = spark.createDataFrame(rows, schema)
    seen, after = [], None
    while page := Q.find_events(tel, limit=7, after=after).collect():
        seen += [r["ingest_seq"] for r in page]
        after = (page[-1]["event_timestamp"], page[-1]["ingest_seq"])
    assert seen == list(range(39, -1, -1))
    with pytest.raises(ValueError):
        Q.find_events(tel, offset=1, after=after)
