"""Registered queries against their checking SQL, and facts about the physical plans."""

from __future__ import annotations

import pytest
from conftest import event, no_rules, telemetry

from __spark_entry__ import entry
from check_queries import compare, connect
from hostpulse.operators import detect as D
from hostpulse.operators import lifecycle as L
from hostpulse.operators import queries as Q
from hostpulse.operators import rules as R
from hostpulse.operators.ingest import dedupe_events
from hostpulse.plans import CHECKS, QUERIES
from hostpulse.sources import drop_stages, materialize
from hostpulse.sources.tables import subfolders

# Single-host queries may be empty on the smallest tables.
MAY_BE_EMPTY = {"host_alerts", "alert_by_key", "delivery_history", "find_alerts_by_status"}


@pytest.fixture(scope="module")
def duck():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, sf_dir, name):
    problem = compare(spark, duck, name, QUERIES[name], CHECKS.get(name), sf_dir)
    assert problem in (("", "equal but empty") if name in MAY_BE_EMPTY else ("",)), problem


def test_every_query_has_sql():
    assert set(CHECKS) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 15


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def exchanges(df) -> int:
    return plan(df).split("\n\n\n")[0].count("+- Exchange")


@pytest.fixture(scope="module")
def stored(spark):
    rows = [event(i, host_id=f"h{i % 3}", event_id=f"e{i % 30}") for i in range(40)]
    return materialize(telemetry(spark, rows), "stored")


def test_predicates_and_columns_reach_the_scan(stored):
    text = plan(Q.find_events(stored, level="ERROR", host_id="h1").select("event_id"))
    assert "EqualTo(level,ERROR)" in text and "EqualTo(host_id,h1)" in text
    assert "TakeOrderedAndProject" in text
    assert "disk_path" not in text.split("ReadSchema")[1].splitlines()[0]


def test_top_k_and_rollup_shapes(stored):
    assert "TakeOrderedAndProject" in plan(Q.latest_event(stored))
    assert "TakeOrderedAndProject" in plan(Q.top_error_messages(stored))
    rollup = plan(Q.host_rollup(stored, limit=None))
    # The step over the data hashes; only the few rows per host it leaves are sorted.
    assert rollup.index("HashAggregate") > rollup.index("SortAggregate")
    assert exchanges(Q.host_rollup(stored, limit=None)) == 2
    assert "WindowGroupLimit" in plan(Q.telemetry_snapshot(stored))


def test_small_rules_are_broadcast_and_no_cross_join_appears(spark, stored):
    evals = D.evaluations(dedupe_events(stored))
    log = materialize(D.delivery_signals(evals, no_rules(spark)), "log")
    for df in (
        R.effective_rules(stored.select("host_id").distinct(), no_rules(spark)),
        D.delivery_signals(materialize(evals, "evals"), no_rules(spark)),
        Q.events_page(stored),
        Q.fleet_summary(stored, L.current_alerts(L.alert_transitions(log))),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BroadcastHashJoin" in plan(D.delivery_signals(materialize(evals, "evals"), no_rules(spark)))


def test_windows_share_one_exchange_per_operator(spark, stored):
    """Without hot keys the executed plan has one data exchange besides the key counts."""
    flagged = materialize(dedupe_events(stored), "flagged")
    evals = D.evaluations(flagged)
    evals.collect()
    executed = evals._jdf.queryExecution().executedPlan().toString()
    final = executed.split("Initial Plan")[0]
    assert final.count("hashpartitioning(host_id") + final.count("hashpartitioning(chunk") <= 2
    assert final.count("Window ") == 2


def test_stages_can_be_dropped(spark):
    df = materialize(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 2)[0]
    assert df.count() == 3 and subfolders(spark, path)
    drop_stages(spark)
    assert subfolders(spark, path) == []
