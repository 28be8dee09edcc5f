from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hostpulse.session import local_session  # noqa: E402

START = datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8, name="hostpulse-tests", **{"spark.sql.shuffle.partitions": "4"}
    )
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


def minute(n: float) -> datetime:
    return START + timedelta(minutes=n)


TEL = (
    "ingest_seq long, event_id string, level string, message string, event_timestamp timestamp, "
    "host_id string, hostname string, agent_version string, queue_depth int, cpu_usage double, "
    "ram_usage double, disk_usage double, disk_path string"
)


def event(seq: int, **values):
    """A telemetry row; later rows are later in time unless said otherwise."""
    row = {
        "ingest_seq": seq,
        "event_id": f"e{seq}",
        "level": "INFO",
        "message": "sample",
        "event_timestamp": minute(seq),
        "host_id": "h",
        "hostname": "h.lab",
        "agent_version": "1",
        "queue_depth": 0,
        "cpu_usage": 10.0,
        "ram_usage": 10.0,
        "disk_usage": None,
        "disk_path": None,
    }
    row.update(values)
    return tuple(row.values())


def telemetry(spark, rows):
    return spark.createDataFrame(rows, TEL)


def no_rules(spark):
    return spark.createDataFrame(
        [], "rule_type string, scope string, threshold double, enabled boolean, updated_at timestamp"
    )


def rule_table(spark, rows):
    """Rules from (rule_type, scope, threshold, enabled)."""
    return spark.createDataFrame(
        [(*row, START) for row in rows],
        "rule_type string, scope string, threshold double, enabled boolean, updated_at timestamp",
    )
