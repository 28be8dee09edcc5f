"""Cleaning: parse, validate with a reason, normalise, authorise, attribute, limit, deduplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse import schemas as S
from hostpulse.functions import (
    blank_to_null,
    compute_once,
    first_reason,
    is_blank,
    token_hash,
    utf16_length,
)
from hostpulse.operators.anchors import mark_anchors, with_anchors_before
from hostpulse.operators.lookup import broadcast_if_small, lookup

# The refusal reasons callers of the contract see, in the order they are tested.
TOO_LARGE = "too_large"
INVALID_JSON = "invalid_json"
BAD_EVENT_ID = "event_id must contain 1-128 characters"
BAD_LEVEL = "level must be INFO, WARN, ERROR, or CRITICAL"
MSG_NOT_TEXT = "msg must be a text value"
BAD_MSG_LENGTH = "msg must contain 1-1000 characters"
BAD_TIMESTAMP = "timestamp must be an ISO-8601 value"
BAD_CPU_RAM = "cpu_usage and ram_usage must be numbers between 0 and 100"
NOT_TEXT = "{} must be a text value"
TOO_LONG = "{} must contain at most 128 characters"
BAD_QUEUE_DEPTH = "queue_depth must be a whole number of zero or more"
BAD_DISK = "disk_usage must be a number between 0 and 100"

# Fixed value: the accepted instant texts (seconds required, zone ``Z`` or an offset with colon).
ISO_INSTANT = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,9})?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
)


def parse_events(raw: DataFrame) -> DataFrame:
    """Add ``j`` (the parsed object) and ``reason`` when the body is too large or no JSON object."""
    small = F.octet_length("value") <= S.MAX_BODY_BYTES
    parsed = compute_once(raw, j=F.when(small, F.try_parse_json(F.col("value"))))
    is_object = F.schema_of_variant("j").startswith("OBJECT")
    return parsed.withColumn(
        "reason",
        first_reason(
            (F.octet_length("value") > S.MAX_BODY_BYTES, TOO_LARGE),
            (~F.coalesce(is_object, F.lit(False)), INVALID_JSON),
        ),
    )


_FIELDS = (
    "event_id",
    "level",
    "msg",
    "timestamp",
    "host_id",
    "hostname",
    "agent_version",
    "disk_path",
    "cpu_usage",
    "ram_usage",
    "disk_usage",
    "queue_depth",
)
_NUMBERS = ("cpu_usage", "ram_usage", "disk_usage", "queue_depth")


def _read_fields(parsed: DataFrame) -> DataFrame:
    """Add per field ``type_<field>`` (its JSON type, VOID when absent) and ``value_<field>``.

    A text is read only from a JSON string and a number only from a JSON number, so ``"40"`` is no
    number.  Every field is looked up once; the checks refer to the results.
    """
    nodes = {
        f"node_{name}": F.try_variant_get(F.col("j"), f"$.{name}", "variant") for name in _FIELDS
    }
    read = {}
    for name in _FIELDS:
        node = F.col(f"node_{name}")
        kind = F.schema_of_variant(node)
        if name in _NUMBERS:
            numeric = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\()")
            value = F.when(numeric, F.try_variant_get(node, "$", "double"))
        else:
            value = F.when(kind == "STRING", F.try_variant_get(node, "$", "string"))
        read[f"type_{name}"] = F.coalesce(kind, F.lit("VOID"))
        read[f"value_{name}"] = value
    return compute_once(compute_once(parsed, **nodes), **read).drop(*nodes)


def _value(field: str) -> Column:
    return F.col(f"value_{field}")


def _type(field: str) -> Column:
    return F.col(f"type_{field}")


def _percentage(field: str) -> Column:
    """The field's value when it is a number from 0 to 100, otherwise null."""
    return F.when(_value(field).between(0, 100), _value(field))


def _instant(text: Column) -> Column:
    """The instant an ISO-8601 text names, null when it is none."""
    upper = F.upper(text)
    return F.when(upper.rlike(ISO_INSTANT), upper.try_cast("timestamp"))


def _identity_checks(field: str) -> list[tuple[Column, str]]:
    text = _value(field)
    return [
        ((_type(field) != "VOID") & text.isNull(), NOT_TEXT.format(field)),
        (utf16_length(text) > S.MAX_ID_LENGTH, TOO_LONG.format(field)),
    ]


def validate_events(parsed: DataFrame) -> DataFrame:
    """Fill ``reason`` with the first broken rule of the contract; null means acceptable."""
    event_id, message = _value("event_id"), _value("msg")
    depth_type = _type("queue_depth")
    checks = [
        (
            event_id.isNull() | is_blank(event_id) | (utf16_length(event_id) > S.MAX_ID_LENGTH),
            BAD_EVENT_ID,
        ),
        (
            ~F.coalesce(F.upper(_value("level")).isin(*S.LEVELS), F.lit(False)),
            BAD_LEVEL,
        ),
        (message.isNull(), MSG_NOT_TEXT),
        (is_blank(message) | (utf16_length(message) > S.MAX_MESSAGE_LENGTH), BAD_MSG_LENGTH),
        (_instant(_value("timestamp")).isNull(), BAD_TIMESTAMP),
        (_percentage("cpu_usage").isNull() | _percentage("ram_usage").isNull(), BAD_CPU_RAM),
        *_identity_checks("host_id"),
        *_identity_checks("hostname"),
        *_identity_checks("agent_version"),
        (
            (depth_type != "VOID") & ((depth_type != "BIGINT") | (_value("queue_depth") < 0)),
            BAD_QUEUE_DEPTH,
        ),
        ((_type("disk_usage") != "VOID") & _percentage("disk_usage").isNull(), BAD_DISK),
        *_identity_checks("disk_path"),
    ]
    checked = compute_once(
        _read_fields(parsed), reason=F.coalesce("reason", first_reason(*checks))
    )
    return checked.select(*parsed.columns)


def correlation_id() -> Column:
    """The header's correlation id, or the payload's when the header is missing or blank."""
    return F.coalesce(
        blank_to_null(F.col("header_correlation_id")),
        F.try_variant_get(F.col("j"), "$.correlation_id", "string"),
    )


def normalize_events(valid: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed telemetry columns of valid events; ``keep`` names raw columns to carry along."""
    header = (
        correlation_id()
        if "header_correlation_id" in valid.columns
        else F.try_variant_get(F.col("j"), "$.correlation_id", "string")
    )
    read = _read_fields(valid.where(F.col("reason").isNull()))
    disk = _value("disk_usage")
    return read.select(
        "ingest_seq",
        _value("event_id").alias("event_id"),
        header.alias("correlation_id"),
        F.upper(_value("level")).alias("level"),
        _value("msg").alias("message"),
        _instant(_value("timestamp")).alias("event_timestamp"),
        F.coalesce(blank_to_null(_value("host_id")), F.lit(S.UNKNOWN_HOST)).alias("host_id"),
        blank_to_null(_value("hostname")).alias("hostname"),
        blank_to_null(_value("agent_version")).alias("agent_version"),
        F.when(
            _type("queue_depth") == "BIGINT", _value("queue_depth").try_cast("int")
        ).alias("queue_depth"),
        _value("cpu_usage").alias("cpu_usage"),
        _value("ram_usage").alias("ram_usage"),
        disk.alias("disk_usage"),
        F.when(disk.isNotNull(), blank_to_null(_value("disk_path"))).alias("disk_path"),
        blank_to_null(_value("host_id")).alias("claimed_host_id"),
        *keep,
    )


def authorize_events(
    raw: DataFrame,
    credentials: DataFrame,
    *,
    shared_hash: str | None = None,
    shared_enabled: bool = True,
) -> DataFrame:
    """Add ``method`` (shared_key, agent_token or unauthorized), ``agent_id``, ``bound_host_id``.

    ``raw.presented_hash`` is the hash of the presented credential, null when none was presented; a
    revoked credential looks exactly like an unknown one.
    """
    active = credentials.where(F.col("revoked_at").isNull()).select(
        F.col("token_hash").alias("presented_hash"),
        F.col("id").alias("agent_id"),
        F.col("host_id").alias("bound_host_id"),
    )
    shared = F.lit(False)
    if shared_enabled and shared_hash is not None:
        shared = F.coalesce(F.col("presented_hash") == shared_hash, F.lit(False))
    found = lookup(raw, active, "presented_hash", spread="ingest_seq")
    return (
        found.withColumn(
            "method",
            F.when(shared, "shared_key")
            .when(F.col("agent_id").isNotNull(), "agent_token")
            .otherwise("unauthorized"),
        )
        .withColumn("agent_id", F.when(~shared, F.col("agent_id")))
        .withColumn("bound_host_id", F.when(~shared, F.col("bound_host_id")))
    )


def hash_tokens(presented: Column) -> Column:
    """Hash of a presented credential; a missing or blank one stays null."""
    return F.when(~is_blank(presented), token_hash(presented))


def attribute_events(events: DataFrame) -> DataFrame:
    """The credential's host replaces the claimed one; ``host_mismatch`` flags a different claim."""
    claimed = F.col("claimed_host_id") if "claimed_host_id" in events.columns else F.col("host_id")
    bound = F.col("bound_host_id")
    return events.withColumn(
        "host_mismatch", F.coalesce(bound.isNotNull() & (claimed != bound), F.lit(False))
    ).withColumn("host_id", F.coalesce(bound, F.col("host_id")))


def limit_requests(
    requests: DataFrame, *, max_requests: int = 100, window_ms: int = 60_000, state: DataFrame | None = None, **split
) -> DataFrame:
    """Requests with ``anchor``, the start of their window in milliseconds, and ``place``, their number in it.

    ``state`` is what earlier batches left (``limiter_state``): a window that is still open goes on with the requests it has
    already counted.
    """
    timed = requests.withColumn("at_ms", F.unix_millis(F.col("at").cast("timestamp")))
    place = Window.partitionBy("client", "anchor").orderBy("at_ms", "seq")
    if state is None:
        marked = mark_anchors(timed, "client", "at_ms", tie="seq", gap=window_ms, **split)
        return marked.withColumn("place", F.row_number().over(place).cast("long"))
    open_windows = state.select("client", F.col("started_ms").alias("anchor_before"))
    seeded = with_anchors_before(timed, open_windows, "client", "at_ms", spread="seq")
    marked = mark_anchors(seeded, "client", "at_ms", tie="seq", gap=window_ms, forced="stored", **split)
    marked = lookup(marked.where(~F.col("stored")), state.select("client", "used"), "client", spread="seq")
    before = F.when(F.col("anchor") == F.col("anchor_before"), F.col("used")).otherwise(0)
    return marked.withColumn("place", F.row_number().over(place) + before)


def limiter_state(
    limited: DataFrame, state: DataFrame | None = None, *, max_requests: int = 100, window_ms: int = 60_000
) -> DataFrame:
    """Per client the start of its newest window (``started_ms``) and the requests ``used`` in it, after a batch.

    Windows that had ended by the newest request are left out, so the state does not grow with all clients ever seen.
    """
    counted = limited.groupBy("client", "anchor").agg(F.max("place").alias("place"))
    newest = counted.groupBy("client").agg(F.max("anchor").alias("started_ms"), F.max_by("place", "anchor").alias("place"))
    after = newest.select("client", "started_ms", F.least(F.col("place"), F.lit(max_requests)).cast("long").alias("used"))
    if state is not None:
        after = after.unionByName(state.select("client", "started_ms", "used").join(after, "client", "left_anti"))
    last = limited.agg(F.max("at_ms")).scalar()
    return after.where(last.isNull() | (F.col("started_ms") + window_ms > last))


def rate_limit_decisions(
    requests: DataFrame,
    *,
    max_requests: int = 100,
    window_ms: int = 60_000,
    state: DataFrame | None = None,
    **split,
) -> DataFrame:
    """Add ``window_started_at`` and ``allowed``.

    A client's window starts at its first request and again at the first request at least
    ``window_ms`` later; requests past the maximum are refused and do not extend the window.
    Requests need ``client``, ``at`` and the unique order ``seq``.  ``state`` is the limiter state left by earlier batches.
    """
    limited = limit_requests(requests, max_requests=max_requests, window_ms=window_ms, state=state, **split)
    return limited.select(
        *requests.columns,
        F.timestamp_millis("anchor").alias("window_started_at"),
        (F.col("place") <= max_requests).alias("allowed"),
    )


def body_refusal() -> Column:
    """What kind of refusal the ``reason`` of parsing and validation is; null without one."""
    body_reason = F.col("reason")
    return F.when(body_reason.isin(TOO_LARGE, INVALID_JSON), body_reason).when(
        body_reason.isNotNull(), F.lit("validation")
    )


def admission_reason(joined: DataFrame) -> DataFrame:
    """Add the one refusal reason of a submission, in the cheapest-first order of the service.

    ``joined`` has ``http_method``, ``method``, ``allowed`` (null where the limiter was never
    asked), ``content_type`` and the ``reason`` of parsing and validation.
    """
    content = F.lower(F.coalesce("content_type", F.lit("")))
    before_body = first_reason(
        (
            F.upper(F.coalesce("http_method", F.lit(""))) != "POST",
            "method_not_allowed",
        ),
        (F.col("method") == "unauthorized", "unauthorized"),
        (~F.col("allowed"), "rate_limited"),
        (~content.startswith("application/json"), "content_type"),
    )
    return joined.withColumn("reason", F.coalesce(before_body, body_refusal()))


def admit(
    submissions: DataFrame,
    credentials: DataFrame,
    *,
    shared_hash: str | None = None,
    shared_enabled: bool = True,
    max_requests: int = 100,
    window_ms: int = 60_000,
) -> DataFrame:
    """All admission checks over raw submissions: adds method, allowed, j and reason.

    Only authorised POST requests reach the rate limiter.  Submissions need ``ingest_seq``,
    ``value``, ``client``, ``received_at``, ``http_method``, ``content_type``, ``presented_hash``.
    """
    authorised = authorize_events(
        submissions, credentials, shared_hash=shared_hash, shared_enabled=shared_enabled
    )
    limited = limit_requests(asked_requests(authorised), max_requests=max_requests, window_ms=window_ms)
    return admission_reason(admitted_bodies(authorised, limited, max_requests=max_requests))


def asked_requests(authorised: DataFrame) -> DataFrame:
    """What reaches the rate limiter: authorised POST requests as (client, at, seq)."""
    return authorised.where(
        (F.upper("http_method") == "POST") & (F.col("method") != "unauthorized")
    ).select("client", F.col("received_at").alias("at"), F.col("ingest_seq").alias("seq"))


def admitted_bodies(authorised: DataFrame, limited: DataFrame, *, max_requests: int) -> DataFrame:
    """Parsed and validated submissions with ``allowed``, null where the limiter was never asked."""
    decisions = limited.select(F.col("seq").alias("ingest_seq"), (F.col("place") <= max_requests).alias("allowed"))
    return validate_events(parse_events(authorised.join(decisions, "ingest_seq", "left")))


def first_arrivals(events: DataFrame) -> DataFrame:
    """``ingest_seq`` of the first arrival of every event id (copies collapse before the shuffle)."""
    return (
        events.where(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(F.min("ingest_seq").alias("ingest_seq"))
    )


def dedupe_events(events: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """Add ``is_new``: the first arrival of an id that is not in ``stored``.

    The flag joins back on the unique ``ingest_seq``, so an id with very many copies never gathers
    in one task.  Rows without an id are always new.
    """
    firsts = first_arrivals(events)
    if stored is not None:
        # The history is only reduced to the ids asked for; a small batch never shuffles it.
        asked = broadcast_if_small(firsts.select("event_id"))
        known = stored.select("event_id").join(asked, "event_id", "left_semi").distinct()
        firsts = firsts.join(known, "event_id", "left_anti")
    flags = firsts.select("ingest_seq", F.lit(True).alias("first"))
    is_new = F.col("first").isNotNull() | F.col("event_id").isNull()
    return events.join(flags, "ingest_seq", "left").withColumn("is_new", is_new).drop("first")


def new_events(events: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """Only the first arrivals."""
    return dedupe_events(events, stored=stored).where("is_new").drop("is_new")


def ingest_outcomes(joined: DataFrame) -> DataFrame:
    """Counts by outcome (received, duplicate, rejected), refusal reason and credential method.

    ``joined`` has ``reason``, ``method`` and ``is_new``.
    """
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("is_new"), "received")
        .otherwise("duplicate")
    )
    return (
        joined.select(outcome.alias("outcome"), "reason", "method")
        .groupBy("outcome", "reason", "method")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def processing_duration(requests: DataFrame) -> DataFrame:
    """Handling seconds and request count per route."""
    return requests.groupBy("path").agg(
        F.sum("seconds").alias("total_seconds"), F.count(F.lit(1)).alias("n")
    )
