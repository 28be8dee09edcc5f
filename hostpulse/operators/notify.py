"""Notifications: which transitions are delivered, the outbox, and what became of the attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.functions import micros
from hostpulse.operators.anchors import NEVER, mark_anchors, newest_anchors, with_anchors_before

# Fixed value: the event type of a reminder; the others are "alert." and the transition.
REMINDER = "alert.reminder"


def mark_reminders(
    occurrences: DataFrame,
    deliveries: DataFrame,
    *,
    cooldown_s: int = 900,
    order: str | tuple[str, ...] = "ingest_seq",
    state: DataFrame | None = None,
    **split,
) -> DataFrame:
    """Occurrences and delivered attempts of each alert in time order, marked where a reminder goes out.

    ``state`` (alert_key, anchor_before: the newest delivery or reminder in microseconds) is what earlier batches left.
    """
    log = deliveries.where(F.col("delivery_status") == "DELIVERED").select(
        "alert_key",
        F.col("attempted_at").alias("at"),
        F.lit(True).alias("delivered"),
    )
    merged = (
        occurrences.withColumn("delivered", F.lit(False))
        .unionByName(log, allowMissingColumns=True)
        .withColumn("at_us", micros(F.col("at")))
    )
    forced = "delivered"
    if state is not None:
        first = order if isinstance(order, str) else order[0]
        merged = with_anchors_before(merged, state, "alert_key", "at_us", spread=first)
        merged, forced = merged.withColumn("known", F.col("stored") | F.col("delivered")), "known"
        merged = merged.withColumn("known", F.coalesce("known", "stored"))
    return mark_anchors(
        merged,
        "alert_key",
        "at_us",
        tie=order,
        gap=cooldown_s * 1_000_000,
        entry=NEVER,
        forced=forced,
        **split,
    )


def _due(marked: DataFrame, columns: list[str]) -> DataFrame:
    """The occurrences among marked rows, with ``due``."""
    return marked.where(F.coalesce(~F.col("delivered"), F.lit(False))).select(*columns, F.col("is_anchor").alias("due"))


def reminder_state(marked: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per alert its newest delivery or reminder after a batch."""
    return newest_anchors(marked, state, "alert_key")


def reminder_due(
    occurrences: DataFrame,
    deliveries: DataFrame,
    *,
    cooldown_s: int = 900,
    order: str | tuple[str, ...] = "ingest_seq",
    state: DataFrame | None = None,
    **split,
) -> DataFrame:
    """Whether each occurrence (alert_key, at and the ``order`` columns) is due for a reminder.

    Due when the cooldown has passed since the later of the last delivered attempt and the last
    reminder; never before anything was delivered; never when the cooldown is not positive.
    """
    if cooldown_s <= 0:
        return occurrences.withColumn("due", F.lit(False))
    marked = mark_reminders(occurrences, deliveries, cooldown_s=cooldown_s, order=order, state=state, **split)
    return _due(marked, occurrences.columns)


_ORDER = ("ingest_seq", "sub_seq")


def fold_reminders(
    transitions: DataFrame, deliveries: DataFrame, *, cooldown_s: int = 900, state: DataFrame | None = None, **split
) -> DataFrame:
    """Marked occurrences of a batch of transitions: what ``policy_of`` and ``reminder_state`` read; a job that needs both writes it once."""
    occurrences = transitions.where(F.col("transition") == "OCCURRENCE")
    return mark_reminders(occurrences, deliveries, cooldown_s=cooldown_s, order=_ORDER, state=state, **split)


def policy_of(transitions: DataFrame, due: DataFrame) -> DataFrame:
    """Transitions with ``event_type`` and ``decision``; ``due`` has the occurrences with their flag."""
    reminders = due.withColumn("event_type", F.when(F.col("due"), REMINDER)).drop("due")
    changes = transitions.where(F.col("transition") != "OCCURRENCE").withColumn(
        "event_type", F.concat(F.lit("alert."), F.lower("transition"))
    )
    decision = F.when(F.col("event_type").isNotNull(), "DELIVER").otherwise("SUPPRESSED")
    return changes.unionByName(reminders).withColumn("decision", decision)


def notification_policy(
    transitions: DataFrame,
    deliveries: DataFrame,
    *,
    cooldown_s: int = 900,
    marked: DataFrame | None = None,
    **split,
) -> DataFrame:
    """Add ``event_type`` and ``decision`` (DELIVER or SUPPRESSED) to every transition.

    ``marked`` are the reminders of these transitions where ``fold_reminders`` has already been written.
    """
    occurrences = transitions.where(F.col("transition") == "OCCURRENCE")
    if cooldown_s <= 0:
        return policy_of(transitions, occurrences.withColumn("due", F.lit(False)))
    if marked is None:
        marked = fold_reminders(transitions, deliveries, cooldown_s=cooldown_s, **split)
    return policy_of(transitions, _due(marked, occurrences.columns))


def notification_outbox(
    policy: DataFrame,
    *,
    schema_version: str = "notification.v1",
    service: str = "analytics",
    channel: str = "webhook",
) -> DataFrame:
    """The versioned JSON envelope of every notification to send.

    ``schema_version``, ``service`` and ``channel`` are the constants the receivers were told.
    """
    # Fixed value: instants are ISO-8601 in UTC with no, three or six fraction digits.
    def instant(name: str):
        whole = F.date_format(F.col(name).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(F.col(name).cast("timestamp"), "SSSSSS")
        digits = (
            F.when(fraction == "000000", F.lit(""))
            .when(fraction.endswith("000"), F.concat(F.lit("."), F.substring(fraction, 1, 3)))
            .otherwise(F.concat(F.lit("."), fraction))
        )
        return F.concat(whole, digits, F.lit("Z"))

    envelope = F.struct(
        F.lit(schema_version).alias("schema_version"),
        "event_type",
        instant("at").alias("occurred_at"),
        F.struct(F.lit(service).alias("service"), F.lit(channel).alias("channel")).alias("source"),
        F.struct(
            "alert_key",
            "alert_type",
            "status",
            "message",
            instant("first_seen").alias("first_seen"),
            instant("last_seen").alias("last_seen"),
            "occurrence_count",
        ).alias("alert"),
    )
    return policy.where(F.col("decision") == "DELIVER").select(
        "alert_key",
        "event_type",
        F.col("at").alias("occurred_at"),
        F.to_json(envelope).alias("payload"),
    )


def classify_attempts(attempts: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Delivery status per attempt, kept up to the first attempt that ends the notification.

    ``attempts`` has ``notification_id``, ``attempt_number``, ``http_status`` (null: no response).
    A 2xx delivers; a 4xx other than 429 fails for good; anything else is tried again.
    """
    status = F.col("http_status")
    delivered = F.coalesce(status.between(200, 299), F.lit(False))
    refused = F.coalesce(status.between(400, 499) & (status != 429), F.lit(False))
    no_response = F.lit("Webhook request failed")
    if "error" in attempts.columns:
        no_response = F.concat_ws(": ", no_response, F.col("error"))
    error = F.when(status.isNull(), no_response).otherwise(
        F.concat(F.lit("Webhook returned HTTP "), status.cast("string"))
    )
    earlier = (
        Window.partitionBy("notification_id")
        .orderBy("attempt_number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        attempts.where(F.col("attempt_number") <= max_attempts)
        .withColumn("delivery_status", F.when(delivered, "DELIVERED").otherwise("FAILED"))
        .withColumn("error_message", F.when(~delivered, error))
        .withColumn(
            "terminal", delivered | refused | (F.col("attempt_number") == max_attempts)
        )
        .withColumn("ended", F.coalesce(F.max("terminal").over(earlier), F.lit(False)))
        .where(~F.col("ended"))
        .drop("ended")
    )


def delivery_history(deliveries: DataFrame, key: str, *, limit: int = 50) -> DataFrame:
    """Attempts of one alert, newest first."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    return deliveries.where(F.col("alert_key") == key).orderBy(F.desc("id")).limit(limit)


def last_delivered(deliveries: DataFrame) -> DataFrame:
    """Time of the newest delivered attempt per alert, newest by insert order."""
    return (
        deliveries.where(F.col("delivery_status") == "DELIVERED")
        .groupBy("alert_key")
        .agg(F.max_by("attempted_at", "id").alias("attempted_at"))
    )


def notification_outcomes(policy: DataFrame, attempts: DataFrame) -> DataFrame:
    """Counts of delivered and failed attempts and of suppressed reminders."""
    suppressed = policy.where(F.col("decision") == "SUPPRESSED").select(
        F.lit("SUPPRESSED").alias("status")
    )
    tried = attempts.select(F.col("delivery_status").alias("status"))
    return suppressed.unionByName(tried).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
