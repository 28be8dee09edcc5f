"""Table schemas and the closed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Every string below is part of the stored data or the wire contract.
LEVELS = ("INFO", "WARN", "ERROR", "CRITICAL")
ERROR_LEVELS = ("ERROR", "CRITICAL")

HIGH_CPU = "HIGH_CPU"
HIGH_RAM = "HIGH_RAM"
HIGH_DISK = "HIGH_DISK"
REPEATED_ERROR = "REPEATED_ERROR"
AGENT_SILENT = "AGENT_SILENT"
RULE_TYPES = (HIGH_CPU, HIGH_RAM, HIGH_DISK, REPEATED_ERROR, AGENT_SILENT)
DEFAULT_THRESHOLDS = {
    HIGH_CPU: 85.0,
    HIGH_RAM: 80.0,
    HIGH_DISK: 90.0,
    REPEATED_ERROR: 5.0,
    AGENT_SILENT: 10.0,
}
FLEET_SCOPE = "*"

STATUSES = ("OPEN", "ACKNOWLEDGED", "RESOLVED")
TRANSITIONS = ("OPENED", "REOPENED", "OCCURRENCE", "ACKNOWLEDGED", "RESOLVED")
SIGNAL_KINDS = ("BREACH", "CLEAR", "ACK", "RESOLVE")
UNKNOWN_HOST = "unknown"

# Limits of the ingestion contract.
WINDOW = 5
MAX_BODY_BYTES = 65_536
MAX_ID_LENGTH = 128
MAX_MESSAGE_LENGTH = 1000
MAX_SILENCE_MINUTES = 10_080
FORGET_HOURS = 168

TELEMETRY = T.StructType(
    [
        T.StructField("ingest_seq", T.LongType(), False),
        T.StructField("event_id", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("host_id", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("agent_version", T.StringType()),
        T.StructField("queue_depth", T.IntegerType()),
        T.StructField("cpu_usage", T.DoubleType()),
        T.StructField("ram_usage", T.DoubleType()),
        T.StructField("disk_usage", T.DoubleType()),
        T.StructField("disk_path", T.StringType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("alert_key", T.StringType(), False),
        T.StructField("alert_type", T.StringType()),
        T.StructField("host_id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("occurrence_count", T.LongType()),
    ]
)

DELIVERIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("alert_key", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("delivery_status", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("attempt_number", T.IntegerType()),
        T.StructField("attempted_at", T.TimestampType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_type", T.StringType(), False),
        T.StructField("scope", T.StringType(), False),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

CREDENTIALS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("host_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("token_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_used_at", T.TimestampType()),
        T.StructField("revoked_at", T.TimestampType()),
    ]
)
