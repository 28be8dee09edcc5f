"""Alert lifecycle: the fold of the signal log, written with running counts only.

Per alert key, in (ingest_seq, sub_seq) order, three running numbers describe the whole state:
``opened`` counts the breaches so far, ``closed`` and ``seen`` are that count at the newest CLEAR or
RESOLVE and at the newest ACK.  The alert is active when ``opened > closed`` (a breach came after the
last close) and acknowledged when also ``seen > closed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.operators.hot_keys import TARGET_ROWS, earlier_chunks, split_hot

ALERT_COLUMNS = (
    "alert_key",
    "alert_type",
    "host_id",
    "message",
    "status",
    "first_seen",
    "last_seen",
    "occurrence_count",
)

_IS_BREACH = "kind = 'BREACH'"
_IS_CLOSE = "kind IN ('CLEAR', 'RESOLVE')"
_IS_ACK = "kind = 'ACK'"


def _running(partition: list[str]) -> Window:
    return Window.partitionBy(*partition).orderBy("ingest_seq", "sub_seq")


def _first_breach() -> Column:
    return F.when(F.expr(_IS_BREACH), F.struct("at", "alert_type", "host_id"))


def _last_breach() -> Column:
    return F.when(F.expr(_IS_BREACH), F.struct("at", "message"))


def _lifecycle_seeds(only_hot: DataFrame) -> DataFrame:
    """For each chunk of a hot alert key the running numbers with which it starts."""
    chunk = ["alert_key", "chunk"]
    order = F.struct("ingest_seq", "sub_seq")
    breach = F.expr(_IS_BREACH)
    per_chunk = (
        only_hot.withColumn("n", F.sum(breach.cast("long")).over(_running(chunk)))
        .groupBy(*chunk)
        .agg(
            F.max("n").alias("breaches"),
            F.max(F.when(F.expr(_IS_CLOSE), F.col("n"))).alias("closed"),
            F.max(F.when(F.expr(_IS_ACK), F.col("n"))).alias("seen"),
            F.min_by(_first_breach(), F.when(breach, order)).alias("first"),
            F.max_by(_last_breach(), F.when(breach, order)).alias("last"),
        )
    )
    before = earlier_chunks("alert_key")
    return (
        per_chunk.withColumn("opened", F.coalesce(F.sum("breaches").over(before), F.lit(0)))
        .withColumn("closed", F.max(F.col("opened") + F.col("closed")).over(before))
        .withColumn("seen", F.max(F.col("opened") + F.col("seen")).over(before))
        .withColumn("first", F.first("first", ignorenulls=True).over(before))
        .withColumn("last", F.last("last", ignorenulls=True).over(before))
        .where(F.col("opened") > 0)
        .select(
            *chunk,
            F.struct("opened", "closed", "seen", "first", "last").alias("seed"),
        )
    )


_SEED = "struct<opened:bigint,closed:bigint,seen:bigint,first:{first},last:{last}>"


def _no_seed(signals: DataFrame) -> Column:
    kinds = {name: signals.schema[name].dataType.simpleString() for name in signals.columns}
    first = f"struct<at:{kinds['at']},alert_type:string,host_id:string>"
    last = f"struct<at:{kinds['at']},message:string>"
    return F.lit(None).cast(_SEED.format(first=first, last=last))


def fold_signals(
    signals: DataFrame, *, state: DataFrame | None = None, target: int | None = TARGET_ROWS
) -> DataFrame:
    """Signals with the running numbers through and before each row, seed rows still inside.

    Two window steps over one exchange and one sort.  ``transitions_of`` and ``state_of`` read the
    result; a job that needs both writes it once.
    """
    every, only_hot = split_hot(signals, "alert_key", "ingest_seq", target=target)
    seeds = None if only_hot is None else _lifecycle_seeds(only_hot)
    if state is not None:
        # The stored state is the seed of every chunk; chunk seeds add this batch to it.
        chunks = every.select("alert_key", "chunk").distinct()
        stored = state.select(
            "alert_key", F.struct("opened", "closed", "seen", "first", "last").alias("seed")
        )
        base = chunks.join(stored, "alert_key")
        seeds = base if seeds is None else _combine(base, seeds)
    seeded = every.withColumn("seed", _no_seed(signals))
    if seeds is not None:
        seeded = seeded.unionByName(seeds, allowMissingColumns=True)

    order = Window.partitionBy("alert_key", "chunk").orderBy(
        F.asc_nulls_first("ingest_seq"), "sub_seq"
    )
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    breach = F.coalesce(F.expr(_IS_BREACH), F.lit(False))
    step = F.coalesce("seed.opened", breach.cast("long"))
    close = F.coalesce("seed.closed", F.when(F.expr(_IS_CLOSE), F.col("opened")))
    ack = F.coalesce("seed.seen", F.when(F.expr(_IS_ACK), F.col("opened")))
    first = F.coalesce("seed.first", _first_breach())
    last = F.coalesce("seed.last", _last_breach())

    def highest(column: Column, frame: Window) -> Column:
        # No close or ACK matters before the first breach, so unseeded numbers start at zero.
        return F.coalesce(F.max(column).over(frame), F.lit(0))

    return seeded.select(
        "*",
        F.sum(step).over(through).alias("opened"),
        F.first(first, ignorenulls=True).over(through).alias("first"),
        F.last(last, ignorenulls=True).over(through).alias("last"),
    ).select(
        "*",
        highest(close, through).alias("closed"),
        highest(ack, through).alias("seen"),
        highest(close, before).alias("closed_before"),
        highest(ack, before).alias("seen_before"),
    )


def _combine(base: DataFrame, chunk_seeds: DataFrame) -> DataFrame:
    """Stored state plus what earlier chunks of this batch add to it."""
    added = chunk_seeds.withColumnRenamed("seed", "added")
    joined = base.join(added, ["alert_key", "chunk"], "full_outer")
    opened = F.coalesce("seed.opened", F.lit(0)).cast("long")

    def newest(name: str) -> Column:
        return F.coalesce(opened + F.col(f"added.{name}"), F.col(f"seed.{name}"))

    return joined.select(
        "alert_key",
        "chunk",
        F.struct(
            (opened + F.coalesce("added.opened", F.lit(0))).alias("opened"),
            newest("closed").alias("closed"),
            newest("seen").alias("seen"),
            F.coalesce("seed.first", "added.first").alias("first"),
            F.coalesce("added.last", "seed.last").alias("last"),
        ).alias("seed"),
    )


def transitions_of(folded: DataFrame) -> DataFrame:
    """What each signal changed; signals that change nothing give no row."""
    breach, close, ack = F.expr(_IS_BREACH), F.expr(_IS_CLOSE), F.expr(_IS_ACK)
    before = F.col("opened") - F.when(breach, 1).otherwise(0)
    rows = folded.where(F.col("seed").isNull()).withColumn("opened_before", before)
    active = F.col("opened_before") > F.col("closed_before")
    acked = F.col("seen_before") > F.col("closed_before")
    transition = (
        F.when(breach & active, "OCCURRENCE")
        .when(breach & (F.col("opened_before") > 0), "REOPENED")
        .when(breach, "OPENED")
        .when(close & active, "RESOLVED")
        .when(ack & active & ~acked, "ACKNOWLEDGED")
    )
    status = (
        F.when(F.col("transition") == "RESOLVED", "RESOLVED")
        .when(F.col("transition") == "ACKNOWLEDGED", "ACKNOWLEDGED")
        .when((F.col("transition") == "OCCURRENCE") & acked, "ACKNOWLEDGED")
        .otherwise("OPEN")
    )
    last_seen = F.when(F.col("transition") == "ACKNOWLEDGED", F.col("last.at")).otherwise(
        F.col("at")
    )
    return (
        rows.withColumn("transition", transition)
        .where(F.col("transition").isNotNull())
        .select(
            "alert_key",
            F.col("first.alert_type").alias("alert_type"),
            F.col("first.host_id").alias("host_id"),
            "ingest_seq",
            "sub_seq",
            "at",
            "transition",
            status.alias("status"),
            F.col("first.at").alias("first_seen"),
            last_seen.alias("last_seen"),
            F.col("opened").alias("occurrence_count"),
            F.col("last.message").alias("message"),
        )
    )


def alert_transitions(
    signals: DataFrame, *, state: DataFrame | None = None, target: int | None = TARGET_ROWS
) -> DataFrame:
    """What each signal changed.

    ``occurrence_count`` counts breaches over the key's whole life, ``first_seen``, ``alert_type``
    and ``host_id`` stay those of the first breach, an ACK moves nothing but the status, and a
    breach keeps an acknowledgement.  ``state`` is the alert state left by earlier batches.
    """
    return transitions_of(fold_signals(signals, state=state, target=target))


def state_of(folded: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per alert key the running numbers after a fold that started from ``state``."""
    kept = ("opened", "closed", "seen", "first", "last")
    place = F.struct("opened", "chunk", F.coalesce("ingest_seq", F.lit(-1)), "sub_seq")
    latest = folded.groupBy("alert_key").agg(
        F.max("opened").alias("opened"),
        F.max("closed").alias("closed"),
        F.max("seen").alias("seen"),
        F.max_by("first", place).alias("first"),
        F.max_by("last", place).alias("last"),
    )
    if state is None:
        return latest.where(F.col("opened") > 0)
    untouched = state.select("alert_key", *kept).join(latest, "alert_key", "left_anti")
    return latest.where(F.col("opened") > 0).unionByName(untouched)


def alert_state(
    signals: DataFrame, *, state: DataFrame | None = None, target: int | None = TARGET_ROWS
) -> DataFrame:
    """Per alert key the running numbers after a batch: what ``alert_transitions(state=...)`` needs."""
    return state_of(fold_signals(signals, state=state, target=target), state)


def current_alerts(
    transitions: DataFrame, *, order: tuple[str, ...] = ("ingest_seq", "sub_seq")
) -> DataFrame:
    """The newest state of every alert by ``order``; one aggregate, copies collapse before the shuffle."""
    state = F.struct(*[c for c in ALERT_COLUMNS if c != "alert_key"])
    return (
        transitions.groupBy("alert_key")
        .agg(F.max_by(state, F.struct(*order)).alias("state"))
        .select("alert_key", "state.*")
    )


def find_alerts(
    alerts: DataFrame, *, status: str | None = None, type: str | None = None
) -> DataFrame:
    """Alerts of one status, or all that are not resolved; newest activity first."""
    if status is None:
        chosen = alerts.where(F.col("status") != "RESOLVED")
    else:
        chosen = alerts.where(F.col("status") == status.upper())
    if type is not None:
        chosen = chosen.where(F.lower("alert_type") == type.lower())
    return chosen.orderBy(F.desc("last_seen"), "alert_key")


def alert_by_key(alerts: DataFrame, key: str) -> DataFrame:
    return alerts.where(F.col("alert_key") == key)


def host_alerts(alerts: DataFrame, host_id: str) -> DataFrame:
    """Active alerts of one host."""
    return find_alerts(alerts.where(F.col("host_id") == host_id))


def active_alert_count(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status") != "RESOLVED").agg(F.count(F.lit(1)).alias("n"))


def _actions(actions: DataFrame, kind: str) -> DataFrame:
    """Operator actions (alert_key, ingest_seq, at) as rows of the signal log."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return actions.select(
        "alert_key",
        text.alias("alert_type"),
        text.alias("host_id"),
        "ingest_seq",
        F.lit(0).alias("sub_seq"),
        "at",
        F.lit(kind).alias("kind"),
        number.alias("value"),
        number.alias("threshold"),
        text.alias("message"),
    )


def acknowledge_alerts(actions: DataFrame) -> DataFrame:
    return _actions(actions, "ACK")


def resolve_alerts(actions: DataFrame) -> DataFrame:
    return _actions(actions, "RESOLVE")


def ineffective_actions(actions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Operator actions that changed nothing (unknown key, wrong state)."""
    changed = transitions.select("alert_key", "ingest_seq")
    return actions.join(changed, ["alert_key", "ingest_seq"], "left_anti")
