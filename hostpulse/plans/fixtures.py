"""Host telemetry derived from the ``events`` table, for Spark and for the checking SQL.

The given tables hold no host telemetry, so every view below is computed over all of ``events``.  The
texts are plain SQL understood by both engines; ``{k}`` is the number inside the ``props`` text.
Faults, repeats and operator actions are chosen by that number, never by row position.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.sources import materialize
from hostpulse.sources.tables import folder_uri

SPARK_K = "CAST(get_json_object(props, '$.k') AS INT)"
DUCK_K = "CAST(json_extract(props, '$.k') AS INT)"

NOW_TEXT = "2024-01-31 00:00:00"
SHARED_TOKEN = "fleet-shared-key"

TELEMETRY = """
SELECT concat('evt-', event_id) AS event_id, event_id AS n, k, event_id * 10 AS ingest_seq,
  concat('host-', user_id) AS host_id, concat('host-', user_id, '.lab') AS hostname,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 10 < 7 THEN '0.15.0' ELSE '0.14.0' END
    AS agent_version,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS queue_depth,
  CASE WHEN event_type = 'error' THEN (CASE WHEN k % 5 = 0 THEN 'CRITICAL' ELSE 'ERROR' END)
       WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
  event_type, concat(event_type, ' code ', k % 4) AS message, ts AS event_timestamp,
  least(value, CAST(100 AS DOUBLE)) AS cpu_usage, CAST(k AS DOUBLE) AS ram_usage,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 37) % 1000 AS DOUBLE) / 10 END
    AS disk_usage,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '/'
       WHEN event_id % 3 = 1 THEN '/var' ELSE 'C:' END AS disk_path
FROM numbered
"""

# Late arrivals, and repeats of which some overtake a late original and some name another host.
DELIVERIES = """
SELECT event_id, n, k, CASE WHEN k IN (10, 60) THEN ingest_seq + 6001 ELSE ingest_seq END
  AS ingest_seq, host_id, level, message, event_timestamp, cpu_usage, ram_usage, disk_usage,
  disk_path
FROM telemetry
UNION ALL
SELECT event_id, n, k, ingest_seq + 3005 AS ingest_seq,
  CASE WHEN k = 99 THEN 'host-1' ELSE host_id END AS host_id, level, 'redelivered' AS message,
  event_timestamp, cpu_usage, ram_usage, disk_usage, disk_path
FROM telemetry WHERE k >= 95 OR k = 10
"""

# Every event is a change request to the alert rules, some of them unacceptable.
RULE_REQUESTS = """
SELECT n AS version, rule_type,
  CASE WHEN k = 7 THEN ' ' WHEN k = 8 THEN '*' WHEN k = 9 THEN repeat('h', 129)
       WHEN k >= 90 THEN NULL ELSE host_id END AS host_id,
  CASE WHEN k = 11 THEN CAST('NaN' AS DOUBLE) WHEN k = 13 THEN CAST(-1 AS DOUBLE)
       WHEN rule_type = 'REPEATED_ERROR' THEN (n % 7) + CASE WHEN k = 15 THEN 0.5E0 ELSE 0E0 END
       WHEN rule_type = 'AGENT_SILENT' THEN CAST((n * 13) % 3000 AS DOUBLE)
       ELSE cpu_usage + CASE WHEN k = 17 THEN 90.0E0 ELSE 20.0E0 END END AS threshold,
  CASE WHEN k % 9 = 0 THEN false WHEN k % 9 = 1 THEN NULL ELSE true END AS enabled,
  k % 20 = 19 AS deleted, event_timestamp AS updated_at
FROM (SELECT *, CASE CAST((n * 7 + k) % 6 AS INT) WHEN 0 THEN 'HIGH_CPU' WHEN 1 THEN 'HIGH_RAM'
  WHEN 2 THEN 'HIGH_DISK' WHEN 3 THEN 'REPEATED_ERROR' WHEN 4 THEN 'AGENT_SILENT'
  ELSE CASE WHEN k < 50 THEN 'HIGH_CPU' ELSE 'HIGH_NETWORK' END END AS rule_type
  FROM telemetry) AS typed
"""

# Operators act on a host's CPU alert just after an event of that host.
ACTIONS = """
SELECT concat('cpu-high@', host_id) AS alert_key, ingest_seq + 2 AS ingest_seq,
  event_timestamp AS at, CASE WHEN event_type = 'signup' THEN 'RESOLVE' ELSE 'ACK' END AS kind
FROM telemetry WHERE (event_type = 'purchase' AND k < 50) OR (event_type = 'signup' AND k < 20)
"""

# One credential per host; hosts whose number ends in 3 lost theirs, some were used long ago.
CREDENTIALS = """
SELECT concat('agent-', host_id) AS id, host_id,
  CASE WHEN host_id LIKE '%7' THEN NULL ELSE concat('label of ', host_id) END AS label,
  concat('token-', host_id) AS token, min(event_timestamp) AS created_at,
  CASE WHEN host_id LIKE '%5' THEN min(event_timestamp) END AS last_used_at,
  CASE WHEN host_id LIKE '%3' THEN max(event_timestamp) END AS revoked_at
FROM telemetry GROUP BY host_id
"""

# Every delivery as a raw request: credentials, methods and content types go wrong now and then.
SUBMISSIONS = """
SELECT n, k, ingest_seq, event_id, host_id, level, message, event_timestamp, cpu_usage, ram_usage,
  disk_usage, disk_path, event_timestamp AS received_at,
  concat('10.0.0.', (n * 31 + k) % 40) AS client,
  CASE WHEN k = 20 THEN 'GET' WHEN k = 21 THEN 'post' ELSE 'POST' END AS http_method,
  CASE WHEN k = 22 THEN 'text/plain' WHEN k = 23 THEN NULL
       WHEN k = 24 THEN 'Application/JSON; charset=utf-8' ELSE 'application/json' END
    AS content_type,
  CASE WHEN k = 25 THEN NULL WHEN k = 26 THEN '  ' WHEN k = 27 THEN 'wrong'
       WHEN k < 45 THEN 'fleet-shared-key' WHEN k = 45 THEN 'token-host-1'
       ELSE concat('token-', host_id) END AS token,
  CASE WHEN k % 10 = 0 THEN concat('header-', event_id) WHEN k % 10 = 1 THEN ' ' END
    AS header_correlation_id
FROM deliveries
"""

# Forwarding attempts of the agents; a null status is no response.
FORWARDS = """
SELECT host_id, event_id, n, k, event_timestamp AS at, (cpu_usage + 1) / 100 AS seconds,
  CASE WHEN k < 8 THEN 500 WHEN k < 13 THEN 429 WHEN k < 18 THEN 400 WHEN k < 22 THEN NULL
       WHEN k < 24 THEN 302 ELSE 200 END AS status,
  k % 4 = 0 AS queue_full
FROM telemetry
"""

# Up to four tries per event; the later ones are more likely to succeed.
TRIES = """
SELECT event_id, attempt, CASE WHEN (k * attempt) % 7 < 3 THEN 503
  WHEN (k * attempt) % 7 = 3 THEN NULL WHEN (k * attempt) % 7 = 4 THEN 429
  WHEN (k * attempt) % 7 = 5 THEN 404 ELSE 200 END AS http_status
FROM (SELECT event_id, k, 1 AS attempt FROM telemetry UNION ALL
      SELECT event_id, k, 2 AS attempt FROM telemetry UNION ALL
      SELECT event_id, k, 3 AS attempt FROM telemetry UNION ALL
      SELECT event_id, k, 4 AS attempt FROM telemetry) AS tries
"""

# Purchases stand for webhook attempts on the host's CPU alert.
DELIVERY_LOG = """
SELECT n AS id, concat('cpu-high@', host_id) AS alert_key, 'alert.opened' AS event_type,
  CASE WHEN k % 3 = 0 THEN 'FAILED' ELSE 'DELIVERED' END AS delivery_status,
  CASE WHEN k % 3 = 0 THEN 500 ELSE 200 END AS http_status,
  CASE WHEN k % 3 = 0 THEN 'Webhook returned HTTP 500' END AS error_message,
  CAST(1 + k % 3 AS INT) AS attempt_number, event_timestamp AS attempted_at
FROM telemetry WHERE event_type = 'purchase'
"""

OCCURRENCES = """
SELECT concat('cpu-high@', host_id) AS alert_key, event_timestamp AS at, ingest_seq
FROM telemetry WHERE event_type <> 'purchase'
"""

# Three mounts per sample: one may pass 100, one has no size, one reading is not a number.
MOUNTS = """
SELECT n AS sample, host_id, 1 AS ord, '/' AS path, 100 AS total,
  CASE WHEN k = 1 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n % 55 AS DOUBLE) END AS used FROM telemetry
UNION ALL
SELECT n AS sample, host_id, 2 AS ord, '/var' AS path, CASE WHEN k < 4 THEN 0 ELSE 100 END AS total,
  50.0E0 + (n * 2) % 55 AS used FROM telemetry
UNION ALL
SELECT n AS sample, host_id, 3 AS ord, 'C:' AS path, 0 AS total, 99.0E0 AS used FROM telemetry
"""

# Queue traffic: every sign-up is queued and leaves at once, errors, clicks and views stay.
QUEUE = """
SELECT host_id, event_timestamp AS at, ingest_seq AS seq, 1 AS change FROM telemetry
WHERE event_type <> 'purchase'
UNION ALL
SELECT host_id, event_timestamp AS at, ingest_seq + 1 AS seq, -1 AS change FROM telemetry
WHERE event_type = 'signup' OR (event_type = 'error' AND k < 50)
"""

TEXTS = {
    "telemetry": TELEMETRY,
    "deliveries": DELIVERIES,
    "rule_requests": RULE_REQUESTS,
    "actions": ACTIONS,
    "credentials_in": CREDENTIALS,
    "submissions": SUBMISSIONS,
    "forwards": FORWARDS,
    "tries": TRIES,
    "delivery_log": DELIVERY_LOG,
    "occurrences": OCCURRENCES,
    "mounts": MOUNTS,
    "queue_events": QUEUE,
}
_INPUT = {"telemetry": "numbered", "submissions": "deliveries"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame over the given ``events`` table."""
    if name == "numbered":
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        return events.withColumn("k", F.expr(SPARK_K))
    source = _INPUT.get(name, "telemetry")
    return spark.sql(
        TEXTS[name].replace(f"FROM {source}", f"FROM {{{source}}}"),
        **{source: load(spark, sf_dir, source)},
    )


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostpulse.operators.ingest import hash_tokens

    made = load(spark, sf_dir, "credentials_in")
    return made.withColumn("token_hash", hash_tokens(F.col("token"))).drop("token")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules in force after all change requests, as a small written table."""
    from hostpulse.operators.rules import upsert_rules

    return materialize(upsert_rules(load(spark, sf_dir, "rule_requests")), "rules")


#: Folders of a queue, each written by a task of its own.
QUEUE_FOLDERS = 64


def write_queue(events: DataFrame, path: str) -> None:
    """Single-event files of (host_id, ingest_seq, value), one per host: ``<folder>/event-<ingest_seq>-<digest of the host>.json``.

    The names depend on the rows alone, so a task that runs again replaces its own files.
    """
    target = folder_uri(events.sparkSession, path)
    host = F.coalesce(F.sha2("host_id", 256), F.lit("none"))
    name = F.concat(F.lit("event-"), F.coalesce(F.col("ingest_seq").cast("string"), F.lit("0")), F.lit("-"), host, F.lit(".json"))
    folder = F.pmod(F.xxhash64("host_id"), F.lit(QUEUE_FOLDERS))
    files = events.select(folder.cast("int").alias("folder"), name.alias("name"), "value").repartition(QUEUE_FOLDERS, "folder")

    def run(batches):
        store, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            made = set()
            for folder, name, value in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "value"))):
                if folder not in made:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{root}/{folder}/{name}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    files.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with their JSON bodies; the number ``k`` chooses the fault of the body."""
    # The given table is one small file; building the JSON texts deserves more than one task.
    rows = load(spark, sf_dir, "submissions").repartition("ingest_seq")
    k = F.col("k")

    def faulty(number: int, bad, good):
        return F.when(k == number, bad).otherwise(good)

    stamp = F.date_format(F.col("event_timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    usual = F.to_json(
        F.struct(
            F.when(k != 1, F.col("event_id")).alias("event_id"),
            F.concat(F.lit("corr-"), "event_id").alias("correlation_id"),
            faulty(2, F.lit("FATAL"), faulty(13, F.lower("level"), F.col("level"))).alias("level"),
            faulty(
                3, F.lit(" \t "), faulty(4, F.repeat(F.lit("m"), F.lit(1001)), F.col("message"))
            ).alias("msg"),
            faulty(5, F.lit("yesterday"), F.concat(stamp, F.lit("Z"))).alias("timestamp"),
            faulty(6, F.lit(100.1), F.col("cpu_usage")).alias("cpu_usage"),
            F.when(k != 7, F.col("ram_usage")).alias("ram_usage"),
            F.when(k == 7, F.lit("40")).alias("ram_text"),
            faulty(
                10,
                F.repeat(F.lit("h"), F.lit(129)),
                faulty(15, F.lit("  "), F.col("host_id")),
            ).alias("host_id"),
            F.when(k == 8, F.lit(-1)).when(k == 17, F.lit(3)).alias("queue_depth"),
            F.when(k == 16, F.lit(1.5)).alias("queue_fraction"),
            faulty(9, F.lit(101.0), F.col("disk_usage")).alias("disk_usage"),
            "disk_path",
            F.when(k == 14, F.lit("x")).alias("extra"),
        )
    )
    body = F.regexp_replace(usual, '"ram_text":', '"ram_usage":')
    body = F.regexp_replace(body, '"queue_fraction":', '"queue_depth":')
    body = (
        F.when(k == 11, F.concat(F.lit("["), body, F.lit("]")))
        .when(k == 12, body.substr(F.lit(1), F.length(body) - 1))
        .when(k == 18, F.concat(body, F.repeat(F.lit(" "), F.lit(65_536))))
        .otherwise(body)
    )
    return rows.select(
        "ingest_seq",
        "event_id",
        body.alias("value"),
        "received_at",
        "client",
        "http_method",
        "content_type",
        "token",
        "header_correlation_id",
    )
