"""Readers and sinks."""

from hostpulse.sources.raw import read_raw_events, replay_queue
from hostpulse.sources.tables import (
    append_deliveries,
    append_telemetry,
    drop_stages,
    materialize,
    prune_table,
    read_deliveries,
    read_telemetry,
    write_rejected,
)

__all__ = [
    "append_deliveries",
    "append_telemetry",
    "drop_stages",
    "materialize",
    "prune_table",
    "read_deliveries",
    "read_raw_events",
    "read_telemetry",
    "replay_queue",
    "write_rejected",
]
