"""The credentials table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import micros
from hostpulse.operators.anchors import mark_anchors

MICROS_PER_MINUTE = 60_000_000


def list_credentials(credentials: DataFrame) -> DataFrame:
    """Newest first; the hash is never shown."""
    return credentials.drop("token_hash").orderBy(F.desc("created_at"), "id")


def revoke_credentials(
    credentials: DataFrame, log: DataFrame, *, now: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """Credentials after the revocations up to ``now``, and the requests that changed nothing.

    ``log`` has ``id`` and ``at``.  The first request revokes; an unknown or already revoked
    credential makes it a no-op.  The row itself is kept.
    """
    until = now if isinstance(now, Column) else F.lit(now)
    asked = log.where(F.col("at") <= until)
    first = asked.groupBy("id").agg(F.min("at").alias("asked_at"))
    revoked = (
        credentials.join(first, "id", "left")
        .withColumn("revoked_at", F.coalesce("revoked_at", "asked_at"))
        .select(*credentials.columns)
    )
    open_ids = credentials.where(F.col("revoked_at").isNull()).select("id")
    effective = first.join(open_ids, "id", "left_semi").select("id", F.col("asked_at").alias("at"))
    return revoked, asked.join(effective, ["id", "at"], "left_anti")


def credential_last_used(
    credentials: DataFrame, uses: DataFrame, *, throttle_minutes: int = 5, **split
) -> DataFrame:
    """Credentials with ``last_used_at`` moved by the uses (id, at).

    A use is recorded when none is recorded yet or the recorded one is more than the throttle older.
    """
    known = credentials.select("id", F.col("last_used_at").alias("at")).where(
        F.col("at").isNotNull()
    )
    rows = (
        known.withColumn("recorded", F.lit(True))
        .unionByName(uses.select("id", "at").withColumn("recorded", F.lit(False)))
        .withColumn("at_us", micros(F.col("at")))
        .drop("at")
        # Several uses at one instant are one use.
        .groupBy("id", "at_us")
        .agg(F.max("recorded").alias("recorded"))
    )
    anchors = mark_anchors(
        rows,
        "id",
        "at_us",
        tie="at_us",
        # Strictly more than the throttle, in microseconds.
        gap=throttle_minutes * MICROS_PER_MINUTE + 1,
        forced="recorded",
        **split,
    ).where("is_anchor")
    last = anchors.groupBy("id").agg(F.timestamp_micros(F.max("at_us")).alias("used_at"))
    stored_type = credentials.schema["last_used_at"].dataType
    return (
        credentials.join(last, "id", "left")
        .withColumn("last_used_at", F.col("used_at").cast(stored_type))
        .select(*credentials.columns)
    )
