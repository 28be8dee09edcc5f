"""Registered source, sink and cleaning queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hostpulse.functions import token_hash
from hostpulse.operators import ingest as I
from hostpulse.plans import fixtures
from hostpulse.plans.checks import check, quoted
from hostpulse.plans.registry import query
from hostpulse.sources import (
    append_deliveries,
    append_telemetry,
    materialize,
    read_deliveries,
    read_raw_events,
    read_telemetry,
    replay_queue,
    write_rejected,
)
from hostpulse.sources.tables import stages_folder

WINDOW_MS, MAX_REQUESTS = 6 * 3_600_000, 3

# What the JSON fault chosen by ``k`` must be refused with; the checks never parse JSON.
_FAULTS = {
    1: I.BAD_EVENT_ID, 2: I.BAD_LEVEL, 3: I.BAD_MSG_LENGTH, 4: I.BAD_MSG_LENGTH, 5: I.BAD_TIMESTAMP,
    6: I.BAD_CPU_RAM, 7: I.BAD_CPU_RAM, 8: I.BAD_QUEUE_DEPTH, 16: I.BAD_QUEUE_DEPTH, 9: I.BAD_DISK,
    10: I.TOO_LONG.format("host_id"),
}
_BODY_FAULTS = {18: I.TOO_LARGE, 11: I.INVALID_JSON, 12: I.INVALID_JSON}


def _by_fault(reasons: dict[int, str]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {quoted(reason)}" for k, reason in reasons.items()) + " END"


_BODY_REASON = _by_fault(_BODY_FAULTS)
_REASON = f"coalesce({_BODY_REASON}, {_by_fault(_FAULTS)})"
_METHOD = """
CASE WHEN s.token = 'fleet-shared-key' THEN 'shared_key' WHEN c.id IS NOT NULL THEN 'agent_token'
  ELSE 'unauthorized' END"""
_LOGIN = """submissions s LEFT JOIN credentials_in c
  ON c.token = s.token AND c.revoked_at IS NULL AND s.token <> 'fleet-shared-key'"""


def _scratch(spark, name: str) -> str:
    return f"{stages_folder(spark)}/{name}-{uuid.uuid4().hex}"


def raw(spark, sf):
    made = fixtures.raw_events(spark, sf)
    return made.withColumn("presented_hash", I.hash_tokens(F.col("token")))


def authorised(spark, sf, rows):
    return I.authorize_events(
        rows, fixtures.credentials(spark, sf), shared_hash=shared_hash(spark)
    )


def shared_hash(spark) -> str:
    one = spark.range(1).select(token_hash(F.lit(fixtures.SHARED_TOKEN)).alias("hash"))
    return one.first()["hash"]


@query(
    "read_raw_events",
    check("""
SELECT '{"event_id":"' || event_id || '","msg":"' || message || '"}' AS value,
  CAST(length(event_id) + length(message) + 24 AS INTEGER) AS bytes,
  row_number() OVER (ORDER BY ingest_seq) - 1 AS ingest_seq FROM telemetry"""),
)
def _(spark, sf):
    path = _scratch(spark, "lines")
    lines = fixtures.load(spark, sf, "telemetry").select(
        "ingest_seq",
        F.to_json(F.struct("event_id", F.col("message").alias("msg"))).alias("value"),
    )
    lines.repartitionByRange(8, "ingest_seq").sortWithinPartitions("ingest_seq").select(
        "value"
    ).write.text(path)
    return read_raw_events(spark, path).select("value", F.octet_length("value").alias("bytes"), "ingest_seq")


@query(
    "replay_queue",
    check("""
SELECT '{"event_id":"' || max_by(event_id, ingest_seq) || '"}' AS value
FROM telemetry GROUP BY host_id"""),
)
def _(spark, sf):
    path = _scratch(spark, "queue")
    newest = fixtures.load(spark, sf, "telemetry").groupBy("host_id").agg(
        F.max_by("event_id", "ingest_seq").alias("event_id"), F.max("ingest_seq").alias("ingest_seq")
    )
    fixtures.write_queue(newest.select("host_id", "ingest_seq", F.to_json(F.struct("event_id")).alias("value")), path)
    return replay_queue(spark, path, recursive=True).select(F.rtrim("value", F.lit("\n")).alias("value"))


@query(
    "append_telemetry",
    check("""
SELECT ingest_seq, event_id, level, message, event_timestamp, host_id, hostname, agent_version,
  queue_depth, cpu_usage, ram_usage, disk_usage, disk_path,
  CAST(event_timestamp AS DATE) AS event_date FROM telemetry"""),
)
def _(spark, sf):
    path = _scratch(spark, "telemetry")
    append_telemetry(fixtures.load(spark, sf, "telemetry"), path)
    return spark.read.parquet(path)


@query(
    "read_telemetry",
    check("""
SELECT ingest_seq, event_id, CAST(NULL AS VARCHAR) AS correlation_id, level, message,
  event_timestamp, host_id, hostname, agent_version, queue_depth, cpu_usage, ram_usage,
  CASE WHEN k >= 50 THEN disk_usage END AS disk_usage, CASE WHEN k >= 50 THEN disk_path END
    AS disk_path, CAST(event_timestamp AS DATE) AS event_date FROM telemetry"""),
)
def _(spark, sf):
    # Half of the rows were written before the disk columns existed.
    path = _scratch(spark, "telemetry")
    tel = fixtures.load(spark, sf, "telemetry").withColumn(
        "event_timestamp", F.col("event_timestamp").cast("timestamp")
    )
    append_telemetry(tel.where(F.col("k") < 50).drop("disk_usage", "disk_path"), path)
    append_telemetry(tel.where(F.col("k") >= 50), path)
    stored = read_telemetry(spark, path)
    return stored.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))


@query(
    "append_deliveries",
    check("""
SELECT id, alert_key, event_type, delivery_status, http_status, error_message, attempt_number,
  attempted_at FROM delivery_log"""),
)
def _(spark, sf):
    path = _scratch(spark, "deliveries")
    log = fixtures.load(spark, sf, "delivery_log")
    append_deliveries(log.withColumn("attempted_at", F.col("attempted_at").cast("timestamp")), path)
    return (
        read_deliveries(spark, path)
        .withColumn("attempted_at", F.col("attempted_at").cast("timestamp_ntz"))
        .drop("event_date")
    )


@query(
    "write_rejected",
    check(f"""
SELECT ingest_seq, reason FROM (SELECT ingest_seq, {_REASON} AS reason FROM submissions) AS checked
WHERE reason IS NOT NULL"""),
)
def _(spark, sf):
    path = _scratch(spark, "rejected")
    write_rejected(I.validate_events(I.parse_events(raw(spark, sf))), path)
    return spark.read.parquet(path).select("ingest_seq", "reason")


@query("parse_events", check(f"SELECT ingest_seq, {_BODY_REASON} AS reason FROM submissions"))
def _(spark, sf):
    return I.parse_events(raw(spark, sf)).select("ingest_seq", "reason")


@query("validate_events", check(f"SELECT ingest_seq, {_REASON} AS reason FROM submissions"))
def _(spark, sf):
    checked = I.validate_events(I.parse_events(raw(spark, sf)))
    return checked.select("ingest_seq", "reason")


_CLEAN = f"""
SELECT s.ingest_seq, s.event_id, CASE WHEN k % 10 = 0 THEN 'header-' || event_id
    ELSE 'corr-' || event_id END AS correlation_id, s.level, s.message, s.event_timestamp,
  CASE WHEN k = 15 THEN 'unknown' ELSE s.host_id END AS host_id,
  CASE WHEN k <> 15 THEN s.host_id END AS claimed_host_id,
  CASE WHEN k = 17 THEN CAST(3 AS INTEGER) END AS queue_depth, s.cpu_usage, s.ram_usage,
  s.disk_usage, CASE WHEN s.disk_usage IS NOT NULL THEN s.disk_path END AS disk_path, s.token
FROM submissions s WHERE {_REASON} IS NULL
"""


@query(
    "normalize_events",
    check(f"""
SELECT ingest_seq, event_id, correlation_id, level, message, event_timestamp, host_id, queue_depth,
  cpu_usage, ram_usage, disk_usage, disk_path FROM ({_CLEAN}) AS clean"""),
)
def _(spark, sf):
    clean = I.normalize_events(I.validate_events(I.parse_events(raw(spark, sf))))
    return clean.withColumn(
        "event_timestamp", F.col("event_timestamp").cast("timestamp_ntz")
    ).drop("hostname", "agent_version", "claimed_host_id")


@query(
    "authorize_events",
    check(f"""
SELECT s.ingest_seq, {_METHOD} AS method, c.id AS agent_id, c.host_id AS bound_host_id
FROM {_LOGIN}"""),
)
def _(spark, sf):
    return authorised(spark, sf, raw(spark, sf)).select(
        "ingest_seq", "method", "agent_id", "bound_host_id"
    )


@query(
    "attribute_events",
    check(f"""
SELECT s.ingest_seq, s.event_id, coalesce(c.host_id, s.host_id) AS host_id,
  coalesce(c.host_id <> s.claimed_host_id, false) AS host_mismatch
FROM ({_CLEAN}) AS s LEFT JOIN credentials_in c ON c.token = s.token AND c.revoked_at IS NULL
  AND s.token <> 'fleet-shared-key'"""),
)
def _(spark, sf):
    checked = I.validate_events(I.parse_events(authorised(spark, sf, raw(spark, sf))))
    clean = I.normalize_events(checked, keep=("bound_host_id",))
    return I.attribute_events(clean).select("ingest_seq", "event_id", "host_id", "host_mismatch")


def _limiter(source: str) -> str:
    """The limiter request by request: a recursive walk along each client's requests."""
    return f"""
ordered AS (SELECT client, ingest_seq, epoch_us(received_at) // 1000 AS ms,
  row_number() OVER (PARTITION BY client ORDER BY epoch_us(received_at) // 1000, ingest_seq) AS rn
  FROM {source}),
walk AS (SELECT client, rn, ingest_seq, ms AS started, 1 AS place FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.client, o.rn, o.ingest_seq,
    CASE WHEN o.ms - w.started >= {WINDOW_MS} THEN o.ms ELSE w.started END,
    CASE WHEN o.ms - w.started >= {WINDOW_MS} THEN 1 ELSE w.place + 1 END
  FROM walk w JOIN ordered o ON o.client = w.client AND o.rn = w.rn + 1)"""


@query(
    "rate_limit_decisions",
    check(
        f"""
SELECT client, ingest_seq AS seq, epoch_ms(started) AS window_started_at,
  place <= {MAX_REQUESTS} AS allowed FROM walk""",
        extra=_limiter("submissions"),
    ),
)
def _(spark, sf):
    asked = fixtures.load(spark, sf, "submissions").select(
        "client", F.col("received_at").alias("at"), F.col("ingest_seq").alias("seq")
    )
    decided = I.rate_limit_decisions(asked, max_requests=MAX_REQUESTS, window_ms=WINDOW_MS)
    return decided.withColumn(
        "window_started_at", F.col("window_started_at").cast("timestamp_ntz")
    ).drop("at")


_ADMISSION = f"""
SELECT s.ingest_seq, s.event_id, {_METHOD} AS method,
  CASE WHEN upper(s.http_method) <> 'POST' THEN 'method_not_allowed'
    WHEN {_METHOD} = 'unauthorized' THEN 'unauthorized'
    WHEN w.place > {MAX_REQUESTS} THEN 'rate_limited'
    WHEN lower(coalesce(s.content_type, '')) NOT LIKE 'application/json%' THEN 'content_type'
    WHEN {_BODY_REASON} IS NOT NULL THEN {_BODY_REASON}
    WHEN {_REASON} IS NOT NULL THEN 'validation' END AS reason
FROM {_LOGIN} LEFT JOIN walk w ON w.ingest_seq = s.ingest_seq"""
_ASKED = f"""
asked AS (SELECT s.client, s.ingest_seq, s.received_at FROM {_LOGIN}
  WHERE upper(s.http_method) = 'POST' AND {_METHOD} <> 'unauthorized'),
{_limiter('asked')}"""


def _admitted(spark, sf):
    return I.admit(
        raw(spark, sf),
        fixtures.credentials(spark, sf),
        shared_hash=shared_hash(spark),
        max_requests=MAX_REQUESTS,
        window_ms=WINDOW_MS,
    )


@query(
    "admission_reason",
    check(
        f"SELECT ingest_seq, method, reason FROM ({_ADMISSION}) AS admitted", extra=_ASKED
    ),
)
def _(spark, sf):
    return _admitted(spark, sf).select("ingest_seq", "method", "reason")


@query(
    "ingest_outcomes",
    check(
        """
SELECT outcome, reason, method, count(*) AS n FROM (
  SELECT a.reason, a.method, CASE WHEN a.reason IS NOT NULL THEN 'rejected'
    WHEN a.ingest_seq = min(CASE WHEN a.reason IS NULL THEN a.ingest_seq END)
      OVER (PARTITION BY a.event_id) THEN 'received' ELSE 'duplicate' END AS outcome
  FROM admitted a) AS outcomes GROUP BY outcome, reason, method""",
        extra=_ASKED + f",\nadmitted AS ({_ADMISSION})",
    ),
)
def _(spark, sf):
    admitted = materialize(
        _admitted(spark, sf).select("ingest_seq", "event_id", "method", "reason"), "admitted"
    )
    accepted = I.dedupe_events(admitted.where(F.col("reason").isNull()))
    refused = admitted.where(F.col("reason").isNotNull()).withColumn("is_new", F.lit(False))
    return I.ingest_outcomes(accepted.unionByName(refused))


@query("dedupe_events", check("SELECT ingest_seq, event_id, message, is_new FROM flagged"))
def dedupe_events(spark, sf):
    deliveries = fixtures.load(spark, sf, "deliveries")
    return I.dedupe_events(deliveries).select("ingest_seq", "event_id", "message", "is_new")


@query(
    "dedupe_events_stored",
    check("""
SELECT ingest_seq, event_id FROM flagged WHERE is_new
  AND event_id NOT IN (SELECT event_id FROM telemetry WHERE level = 'WARN')"""),
)
def _(spark, sf):
    deliveries = fixtures.load(spark, sf, "deliveries")
    stored = fixtures.load(spark, sf, "telemetry").where(F.col("level") == "WARN")
    return I.new_events(deliveries, stored=stored).select("ingest_seq", "event_id")


@query(
    "processing_duration",
    check("""
SELECT '/' || event_type AS path, round(sum((cpu_usage + 1) / 100), 4) AS total_seconds,
  count(*) AS n FROM telemetry GROUP BY event_type"""),
)
def _(spark, sf):
    requests = fixtures.load(spark, sf, "telemetry").select(
        F.concat(F.lit("/"), "event_type").alias("path"),
        ((F.col("cpu_usage") + 1) / 100).alias("seconds"),
    )
    return I.processing_duration(requests).withColumn(
        "total_seconds", F.round("total_seconds", 4)
    )
