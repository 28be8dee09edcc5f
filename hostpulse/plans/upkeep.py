"""Registered notification, agent, credential and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.operators import agents as A
from hostpulse.operators import credentials as C
from hostpulse.operators import maintain as M
from hostpulse.operators import notify as N
from hostpulse.plans import fixtures
from hostpulse.plans.checks import NOW, check
from hostpulse.plans.lifecycle import transitions_table
from hostpulse.plans.registry import query

COOLDOWN_S = 86_400
COOLDOWN_US = f"CAST({COOLDOWN_S * 1_000_000} AS BIGINT)"
QUEUE_CAPACITY = 20


def _load(spark, sf, name):
    return fixtures.load(spark, sf, name)


def _reminders(occurrences: str) -> str:
    """Reminders row by row: a recursive walk along each key's occurrences and deliveries."""
    return f"""
mixed AS (SELECT alert_key, epoch_us(at) AS us, 1 AS late, ingest_seq, sub_seq
    FROM {occurrences}
  UNION ALL SELECT alert_key, epoch_us(attempted_at), 0, NULL, NULL FROM delivery_log
    WHERE delivery_status = 'DELIVERED'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY us, late, ingest_seq,
  sub_seq) AS rn FROM mixed),
walk AS (SELECT alert_key, rn, late, ingest_seq, sub_seq, false AS due,
    CASE WHEN late = 0 THEN us END AS recent FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.alert_key, o.rn, o.late, o.ingest_seq, o.sub_seq,
    o.late = 1 AND coalesce(w.recent + {COOLDOWN_US} <= o.us, false),
    CASE WHEN o.late = 0 OR w.recent + {COOLDOWN_US} <= o.us THEN o.us ELSE w.recent END
  FROM walk w JOIN ordered o ON o.alert_key = w.alert_key AND o.rn = w.rn + 1)"""


@query(
    "reminder_due",
    check(
        "SELECT alert_key, ingest_seq, due FROM walk WHERE late = 1",
        extra=_reminders("(SELECT *, 0 AS sub_seq FROM occurrences)"),
    ),
)
def _(spark, sf):
    due = N.reminder_due(
        _load(spark, sf, "occurrences"), _load(spark, sf, "delivery_log"), cooldown_s=COOLDOWN_S
    )
    return due.select("alert_key", "ingest_seq", "due")


_POLICY = """
SELECT t.*, CASE WHEN t.transition <> 'OCCURRENCE' THEN 'alert.' || lower(t.transition)
  WHEN w.due THEN 'alert.reminder' END AS event_type
FROM transitions t LEFT JOIN walk w ON t.transition = 'OCCURRENCE' AND w.late = 1
  AND w.alert_key = t.alert_key AND w.ingest_seq = t.ingest_seq AND w.sub_seq = t.sub_seq"""
_OCCURRED = _reminders("(SELECT * FROM transitions WHERE transition = 'OCCURRENCE')")


def _policy(spark, sf):
    changes = transitions_table(spark, sf, fixtures.rules(spark, sf))
    return N.notification_policy(
        changes, _load(spark, sf, "delivery_log"), cooldown_s=COOLDOWN_S
    )


@query(
    "notification_policy",
    check(
        f"""
SELECT alert_key, ingest_seq, sub_seq, transition, event_type,
  CASE WHEN event_type IS NULL THEN 'SUPPRESSED' ELSE 'DELIVER' END AS decision
FROM ({_POLICY}) AS policy""",
        extra=_OCCURRED,
    ),
)
def _(spark, sf):
    return _policy(spark, sf).select(
        "alert_key", "ingest_seq", "sub_seq", "transition", "event_type", "decision"
    )


@query(
    "notification_outbox",
    check(
        f"""
SELECT alert_key, event_type, at AS occurred_at, status, first_seen, last_seen, occurrence_count
FROM ({_POLICY}) AS policy WHERE event_type IS NOT NULL""",
        extra=_OCCURRED,
    ),
)
def _(spark, sf):
    outbox = N.notification_outbox(_policy(spark, sf))

    def field(path: str):
        return F.get_json_object("payload", f"$.{path}")

    return outbox.select(
        field("alert.alert_key").alias("alert_key"),
        field("event_type").alias("event_type"),
        field("occurred_at").cast("timestamp").cast("timestamp_ntz").alias("occurred_at"),
        field("alert.status").alias("status"),
        field("alert.first_seen").cast("timestamp").cast("timestamp_ntz").alias("first_seen"),
        field("alert.last_seen").cast("timestamp").cast("timestamp_ntz").alias("last_seen"),
        field("alert.occurrence_count").cast("long").alias("occurrence_count"),
    )


_CLASSIFIED = """
SELECT t.event_id, t.attempt, t.http_status,
  CASE WHEN t.http_status BETWEEN 200 AND 299 THEN 'DELIVERED' ELSE 'FAILED' END AS delivery_status,
  CASE WHEN t.http_status IS NULL THEN 'Webhook request failed'
    WHEN t.http_status NOT BETWEEN 200 AND 299 THEN 'Webhook returned HTTP ' || t.http_status END
    AS error_message
FROM tries t WHERE t.attempt <= 3 AND NOT EXISTS (SELECT 1 FROM tries e
  WHERE e.event_id = t.event_id AND e.attempt < t.attempt AND (e.http_status BETWEEN 200 AND 299
    OR (e.http_status BETWEEN 400 AND 499 AND e.http_status <> 429)))"""


def _attempts(spark, sf):
    return N.classify_attempts(
        _load(spark, sf, "tries")
        .withColumnRenamed("event_id", "notification_id")
        .withColumnRenamed("attempt", "attempt_number")
    )


@query("classify_attempts", check(_CLASSIFIED))
def _(spark, sf):
    return _attempts(spark, sf).select(
        F.col("notification_id").alias("event_id"),
        F.col("attempt_number").alias("attempt"),
        "http_status",
        "delivery_status",
        "error_message",
    )


@query(
    "delivery_history",
    check("""
SELECT id, alert_key, event_type, delivery_status, http_status, error_message, attempt_number,
  attempted_at FROM delivery_log WHERE alert_key = 'cpu-high@host-6' ORDER BY id DESC LIMIT 50"""),
)
def _(spark, sf):
    return N.delivery_history(_load(spark, sf, "delivery_log"), "cpu-high@host-6")


@query(
    "last_delivered",
    check("""
SELECT alert_key, max_by(attempted_at, id) AS attempted_at FROM delivery_log
WHERE delivery_status = 'DELIVERED' GROUP BY alert_key"""),
)
def _(spark, sf):
    return N.last_delivered(_load(spark, sf, "delivery_log"))


@query(
    "notification_outcomes",
    check(
        f"""
SELECT status, count(*) AS n FROM (
  SELECT 'SUPPRESSED' AS status FROM ({_POLICY}) AS policy WHERE event_type IS NULL
  UNION ALL SELECT delivery_status FROM ({_CLASSIFIED}) AS classified) AS outcomes
GROUP BY status""",
        extra=_OCCURRED,
    ),
)
def _(spark, sf):
    return N.notification_outcomes(_policy(spark, sf), _attempts(spark, sf))


@query(
    "fullest_mount",
    check("""
SELECT h.host_id, h.sample, b.used AS disk_usage, b.path AS disk_path
FROM (SELECT DISTINCT host_id, sample FROM mounts) AS h LEFT JOIN (
  SELECT host_id, sample, path, least(used, 100) AS used, row_number() OVER (
    PARTITION BY host_id, sample ORDER BY least(used, 100) DESC, ord) AS rn
  FROM mounts WHERE total <> 0 AND NOT isnan(used)) AS b
  ON b.host_id = h.host_id AND b.sample = h.sample AND b.rn = 1"""),
)
def _(spark, sf):
    return A.fullest_mount(_load(spark, sf, "mounts"))


_OUTCOME = """
CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered'
  WHEN (status IS NULL OR status >= 500 OR status = 429) AND queue_full THEN 'failed'
  WHEN status IS NULL OR status >= 500 OR status = 429 THEN 'queued' ELSE 'rejected' END"""


@query("forward_outcomes", check(f"SELECT event_id, {_OUTCOME} AS outcome FROM forwards"))
def _(spark, sf):
    return A.forward_outcomes(_load(spark, sf, "forwards")).select("event_id", "outcome")


@query(
    "retry_outcome",
    check("""
SELECT t.event_id, CASE WHEN a.first_answer IS NOT NULL THEN t.http_status ELSE l.http_status END
  AS status, coalesce(a.first_answer, 3) AS attempts, a.first_answer IS NOT NULL AS answered
FROM (SELECT event_id, min(CASE WHEN http_status < 500 THEN attempt END) AS first_answer
  FROM tries WHERE attempt <= 3 GROUP BY event_id) AS a
JOIN tries t ON t.event_id = a.event_id AND t.attempt = coalesce(a.first_answer, 3)
JOIN tries l ON l.event_id = a.event_id AND l.attempt = 3"""),
)
def _(spark, sf):
    return A.retry_outcome(
        _load(spark, sf, "tries").withColumnRenamed("http_status", "status")
    )


@query(
    "queue_depth_timeline",
    check(
        "SELECT host_id, seq, depth, dropped FROM walk",
        extra=f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY seq) AS rn
  FROM queue_events),
walk AS (SELECT host_id, rn, seq, greatest(change, 0) AS depth, false AS dropped FROM ordered
    WHERE rn = 1
  UNION ALL
  SELECT o.host_id, o.rn, o.seq,
    CASE WHEN o.change > 0 THEN least(w.depth + 1, {QUEUE_CAPACITY}) ELSE greatest(w.depth - 1, 0)
      END, o.change > 0 AND w.depth >= {QUEUE_CAPACITY}
  FROM walk w JOIN ordered o ON o.host_id = w.host_id AND o.rn = w.rn + 1)""",
    ),
)
def _(spark, sf):
    timeline = A.queue_depth_timeline(
        _load(spark, sf, "queue_events"), capacity=QUEUE_CAPACITY
    )
    return timeline.select("host_id", "seq", "depth", "dropped")


# Every hour of January and the first of February is a health check of every host.
_TICKS = """
SELECT h.host_id, t.at FROM host_names h CROSS JOIN (SELECT unnest(generate_series(
  TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 1 HOUR)) AS at) AS t"""


def _ticks(spark, sf):
    hosts = _load(spark, sf, "telemetry").select("host_id").distinct()
    hours = F.expr(
        "sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-02-01 00:00:00', "
        "INTERVAL 1 HOUR)"
    )
    return hosts.select("host_id", F.explode(hours).alias("at"))


@query(
    "delivery_stalls",
    check(
        """
SELECT host_id, at, CASE WHEN stalled THEN 'delivery_stalled' ELSE 'delivery_recovered' END AS event,
  gap // 1000000 AS stalled_seconds
FROM (SELECT *, lag(stalled, 1, false) OVER (PARTITION BY host_id ORDER BY at) AS was FROM judged)
  AS judged_was
WHERE stalled <> was""",
        extra=f"""
told AS (SELECT host_id, at, {_OUTCOME} AS outcome, event_id FROM forwards),
starts AS (SELECT host_id, least(min(at), TIMESTAMP '2024-01-01 00:00:00') AS started
  FROM forwards GROUP BY host_id),
marked AS (SELECT host_id, at, 0 AS tick, outcome <> 'delivered' AS failed,
    CASE WHEN outcome = 'delivered' THEN at END AS ok_at FROM told WHERE outcome <> 'rejected'
  UNION ALL SELECT host_id, at, 1, NULL, NULL FROM ({_TICKS}) AS ticks),
seen AS (SELECT *, last_value(failed IGNORE NULLS) OVER so_far AS last_failed,
    max(ok_at) OVER so_far AS last_ok FROM marked
  WINDOW so_far AS (PARTITION BY host_id ORDER BY at, tick
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
judged AS (SELECT s.host_id, s.at, epoch_us(s.at) - epoch_us(coalesce(s.last_ok, st.started)) AS gap,
    coalesce(s.last_failed, false) AND epoch_us(s.at) - epoch_us(coalesce(s.last_ok, st.started))
      >= 300000000 AS stalled
  FROM seen s JOIN starts st ON st.host_id = s.host_id WHERE s.tick = 1)""",
    ),
)
def _(spark, sf):
    told = A.forward_outcomes(_load(spark, sf, "forwards"))
    return A.delivery_stalls(told, _ticks(spark, sf))


@query(
    "forward_duration",
    check("""
SELECT host_id, round(sum(seconds), 4) AS total_seconds, count(*) AS n FROM forwards
GROUP BY host_id"""),
)
def _(spark, sf):
    return A.forward_duration(_load(spark, sf, "forwards")).withColumn(
        "total_seconds", F.round("total_seconds", 4)
    )


@query(
    "agent_counters",
    check(
        f"""
SELECT counter, label, count(*) AS n FROM (
  SELECT 'captured' AS counter, level AS label FROM telemetry
  UNION ALL SELECT 'forwarded', {_OUTCOME} FROM forwards
  UNION ALL SELECT CASE WHEN place > 0 THEN 'queue_dropped' ELSE 'queue_written' END, ''
    FROM (SELECT 0 AS place FROM queue_events WHERE change > 0) AS written
  UNION ALL SELECT 'queue_rejected', '' FROM forwards WHERE queue_full AND {_OUTCOME} = 'rejected'
  ) AS counters
GROUP BY counter, label"""
    ),
)
def _(spark, sf):
    queue = A.queue_depth_timeline(_load(spark, sf, "queue_events"), capacity=1_000_000)
    outcomes = A.forward_outcomes(_load(spark, sf, "forwards"))
    replays = outcomes.where("queue_full")
    return A.agent_counters(_load(spark, sf, "telemetry"), outcomes, queue, replays)


_LOST = """
SELECT event_id FROM telemetry EXCEPT SELECT event_id FROM deliveries WHERE level <> 'WARN'
EXCEPT SELECT event_id FROM forwards WHERE status = 429"""


def _reconciled(spark, sf):
    stored = _load(spark, sf, "deliveries").where(F.col("level") != "WARN")
    pending = _load(spark, sf, "forwards").where(F.col("status") == 429)
    return A.reconcile_delivery(_load(spark, sf, "telemetry"), stored, pending)


@query("reconcile_delivery", check(_LOST))
def _(spark, sf):
    return _reconciled(spark, sf)[0]


@query(
    "reconcile_delivery_totals",
    check(f"""
SELECT (SELECT count(DISTINCT event_id) FROM telemetry) AS captured,
  (SELECT count(DISTINCT event_id) FROM deliveries WHERE level <> 'WARN') AS stored,
  (SELECT count(DISTINCT event_id) FROM forwards WHERE status = 429) AS pending,
  (SELECT count(*) FROM ({_LOST}) AS lost) AS lost"""),
)
def _(spark, sf):
    return _reconciled(spark, sf)[1]


@query(
    "list_credentials",
    check("SELECT id, host_id, label, created_at, last_used_at, revoked_at FROM credentials_in"),
)
def _(spark, sf):
    return C.list_credentials(fixtures.credentials(spark, sf))


# Every purchase of a host is a request to revoke its credential; some name an unknown one.
_REVOCATIONS = f"""
SELECT CASE WHEN k < 5 THEN 'nobody' ELSE 'agent-' || host_id END AS id, event_timestamp AS at
FROM telemetry WHERE event_type = 'purchase' AND event_timestamp <= {NOW}"""


def _revoked(spark, sf):
    log = _load(spark, sf, "telemetry").where(F.col("event_type") == "purchase").select(
        F.when(F.col("k") < 5, "nobody")
        .otherwise(F.concat(F.lit("agent-"), "host_id"))
        .alias("id"),
        F.col("event_timestamp").alias("at"),
    )
    return C.revoke_credentials(fixtures.credentials(spark, sf), log, now=fixtures.now())


@query(
    "revoke_credentials",
    check(f"""
SELECT c.id, c.host_id, c.label, c.created_at, c.last_used_at,
  coalesce(c.revoked_at, (SELECT min(at) FROM ({_REVOCATIONS}) AS r WHERE r.id = c.id))
    AS revoked_at FROM credentials_in c"""),
)
def _(spark, sf):
    return _revoked(spark, sf)[0].drop("token_hash")


@query(
    "revoke_credentials_no_ops",
    check(f"""
SELECT r.id, r.at FROM ({_REVOCATIONS}) AS r LEFT JOIN credentials_in c ON c.id = r.id
WHERE c.id IS NULL OR c.revoked_at IS NOT NULL OR r.at > (
  SELECT min(f.at) FROM ({_REVOCATIONS}) AS f WHERE f.id = r.id)"""),
)
def _(spark, sf):
    return _revoked(spark, sf)[1]


_THROTTLE_MINUTES = 600
_THROTTLE_US = f"CAST({_THROTTLE_MINUTES * 60_000_000} AS BIGINT)"


@query(
    "credential_last_used",
    check(
        """
SELECT c.id, max(CASE WHEN w.recorded THEN make_timestamp(w.recent) END) AS last_used_at
FROM credentials_in c JOIN walk w ON w.id = c.id GROUP BY c.id""",
        extra=f"""
uses AS (SELECT 'agent-' || host_id AS id, epoch_us(event_timestamp) AS us, row_number() OVER (
  PARTITION BY host_id ORDER BY event_timestamp, ingest_seq) AS rn FROM telemetry),
walk AS (SELECT c.id, CAST(0 AS BIGINT) AS rn, epoch_us(c.last_used_at) AS recent,
    c.last_used_at IS NOT NULL AS recorded FROM credentials_in c
  UNION ALL
  SELECT u.id, u.rn, CASE WHEN w.recent IS NULL OR w.recent < u.us - {_THROTTLE_US}
    THEN u.us ELSE w.recent END, true
  FROM walk w JOIN uses u ON u.id = w.id AND u.rn = w.rn + 1)""",
    ),
)
def _(spark, sf):
    uses = _load(spark, sf, "telemetry").select(
        F.concat(F.lit("agent-"), "host_id").alias("id"), F.col("event_timestamp").alias("at")
    )
    used = C.credential_last_used(
        fixtures.credentials(spark, sf), uses, throttle_minutes=_THROTTLE_MINUTES
    )
    return used.select("id", "last_used_at")


@query(
    "prune_history",
    check(f"""
SELECT event_id, event_timestamp FROM telemetry
WHERE event_timestamp >= {NOW} - INTERVAL 10 DAY"""),
)
def _(spark, sf):
    tel = _load(spark, sf, "telemetry")
    kept, _removed = M.prune_history(
        tel, time_col="event_timestamp", now=fixtures.now(), days=10
    )
    return kept.select("event_id", "event_timestamp")


@query(
    "prune_history_removed",
    check(f"""
SELECT (SELECT count(*) FROM telemetry WHERE event_timestamp < {NOW} - INTERVAL 10 DAY)
  + (SELECT count(*) FROM delivery_log WHERE attempted_at < {NOW} - INTERVAL 10 DAY) AS removed"""),
)
def _(spark, sf):
    tables = {"telemetry": "event_timestamp", "delivery_log": "attempted_at"}
    counts = [
        M.prune_history(_load(spark, sf, name), time_col=column, now=fixtures.now(), days=10)[1]
        for name, column in tables.items()
    ]
    return counts[0].unionByName(counts[1]).agg(F.sum("removed").alias("removed"))


@query(
    "latency_report",
    check(
        """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'elapsed_seconds' AS metric, elapsed AS value FROM totals
  UNION ALL SELECT 'events_per_second', total / elapsed FROM totals
  UNION ALL SELECT 'accepted', accepted FROM totals
  UNION ALL SELECT 'transport_failures', failures FROM totals
  UNION ALL SELECT 'latency_max', slowest FROM totals
  UNION ALL SELECT 'status_' || status, count(*) FROM forwards WHERE status IS NOT NULL
    GROUP BY status
  UNION ALL SELECT 'latency_p50', p50 FROM ranks UNION ALL SELECT 'latency_p95', p95 FROM ranks
  UNION ALL SELECT 'latency_p99', p99 FROM ranks) AS report""",
        extra="""
totals AS (SELECT count(*) AS total, count(CASE WHEN status BETWEEN 200 AND 299 THEN 1 END)
    AS accepted, count(CASE WHEN status IS NULL THEN 1 END) AS failures,
    max(CASE WHEN status IS NOT NULL THEN seconds END) AS slowest,
    CAST((epoch_us(max(at)) - epoch_us(min(at))) / 1000000 AS DOUBLE) AS elapsed FROM forwards),
ranks AS (SELECT quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95,
  quantile_disc(seconds, 0.99) AS p99 FROM forwards WHERE status IS NOT NULL)""",
    ),
)
def _(spark, sf):
    span = F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(
        F.min("at").cast("timestamp")
    )
    report = M.latency_report(_load(spark, sf, "forwards"), elapsed_s=span / 1_000_000)
    return report.withColumn("value", F.round("value", 6))


@query(
    "http_outcomes",
    check("""
SELECT '/' || (CASE WHEN k < 50 THEN 'receive' ELSE 'events' END) AS path, status, count(*) AS n
FROM forwards GROUP BY 1, 2"""),
)
def _(spark, sf):
    route = F.when(F.col("k") < 50, "/receive").otherwise("/events")
    return M.http_outcomes(_load(spark, sf, "forwards").withColumn("path", route))
