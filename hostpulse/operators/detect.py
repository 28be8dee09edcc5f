"""Detection: rolling windows per host and the signals they raise.

Windows are counted in events and follow *arrival* order (``ingest_seq``), so a late event joins the
end of its host's window.  A repeated delivery does not enter the window but evaluates it again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse import schemas as S
from hostpulse.functions import (
    alert_key,
    blank_to_null,
    micros,
    percent_message,
    repeated_error_rule,
)
from hostpulse.operators.hot_keys import TARGET_ROWS, earlier_chunks, split_hot
from hostpulse.operators.rules import RuleLog, with_effective_rules

SIGNAL_COLUMNS = (
    "alert_key",
    "alert_type",
    "host_id",
    "ingest_seq",
    "sub_seq",
    "at",
    "kind",
    "value",
    "threshold",
    "message",
)
# The alert key prefixes.
CPU_KEY, RAM_KEY, DISK_KEY, SILENT_KEY = "cpu-high", "ram-high", "disk-high", "agent-silent"

# What a window keeps of an event; other texts than error messages are not shuffled.
MEMBER = ("event_timestamp", "error", "cpu_usage", "ram_usage", "disk_usage", "disk_path")


def _members(deliveries: DataFrame) -> DataFrame:
    """Deliveries reduced to the window columns."""
    error = F.when(F.col("level").isin(*S.ERROR_LEVELS), F.col("message"))
    return deliveries.withColumn("error", error).select(
        "host_id", "ingest_seq", "is_new", *MEMBER
    )


def window_tails(new_rows: DataFrame, keys: list[str], *, size: int) -> DataFrame:
    """Per group the last ``size`` events in arrival order as an array, oldest first.

    The row limit applies before the shuffle, so a group sends ``size`` rows per input partition.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("ingest_seq"))
    return (
        new_rows.withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= size)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("ingest_seq", *MEMBER))).alias("tail"))
    )


def _window_seeds(only_hot: DataFrame, size: int) -> DataFrame:
    """For each chunk of a hot host: the events before it that its first windows reach back to.

    Also ``offset``: how many events came before those.
    """
    per_chunk = only_hot.groupBy("host_id", "chunk").agg(
        F.sum(F.col("is_new").cast("long")).alias("n")
    )
    # A repeat before the chunk's first new event evaluates a window that lies wholly before it.
    tails = window_tails(only_hot.where("is_new"), ["host_id", "chunk"], size=size)
    # Chunks of repeats only have no tail; numbering the others lets one range frame skip them.
    filled = Window.partitionBy("host_id").orderBy("chunk")
    reach = Window.partitionBy("host_id").orderBy("filled").rangeBetween(-(size - 1), 0)
    state = (
        per_chunk.join(tails, ["host_id", "chunk"], "left")
        .withColumn("filled", F.sum(F.when(F.col("tail").isNotNull(), 1).otherwise(0)).over(filled))
        .withColumn("known", F.flatten(F.collect_list("tail").over(reach)))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier_chunks("host_id")), F.lit(0)))
    )
    known = F.sort_array(F.lag("known").over(filled))
    last = F.when(F.size(known) > size, F.slice(known, -size, size)).otherwise(known)
    return (
        state.withColumn("known", last)
        .where(F.size("known") > 0)
        .select(
            "host_id",
            "chunk",
            (F.col("before") - F.size("known")).alias("offset"),
            F.inline("known"),
        )
    )


def _stored_seeds(tails: DataFrame) -> DataFrame:
    """Seeds from a stored window state (host_id, seen, tail) of earlier batches."""
    return tails.select(
        "host_id",
        (F.col("seen") - F.size("tail")).alias("offset"),
        F.inline("tail"),
    )


def evaluations(
    deliveries: DataFrame,
    *,
    window: int = S.WINDOW,
    tails: DataFrame | None = None,
    target: int | None = TARGET_ROWS,
) -> DataFrame:
    """One row per accepted delivery whose host has a window: position, means, newest reading.

    ``deliveries`` has ``is_new`` (see ``dedupe_events``); ``pos`` counts the host's new events so
    far and ``now`` is the newest window event's own time.  ``errors`` lists the window's error
    messages.  ``tails`` is the window state left by earlier batches.  All frames share one exchange
    on (host_id, chunk); a hot host is split and its chunks start from seed rows.
    """
    rows = _members(deliveries).select(
        "*", F.lit(None).cast("long").alias("offset"), F.lit(False).alias("seed")
    )
    if tails is not None:
        rows = rows.unionByName(
            _stored_seeds(tails).select("*", F.lit(True).alias("is_new"), F.lit(True).alias("seed"))
        )
    every, only_hot = split_hot(rows, "host_id", "ingest_seq", target=target)
    seeded = every
    if only_hot is not None:
        seeds = _window_seeds(only_hot, window)
        if tails is not None:
            # A stored tail already counts into its chunk; only its own offset comes on top.
            stored = only_hot.groupBy("host_id").agg(F.max("offset").alias("base"))
            seeds = (
                seeds.join(stored, "host_id", "left")
                .withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0)))
                .drop("base")
            )
        seeded = every.unionByName(
            seeds.select("*", F.lit(True).alias("is_new"), F.lit(True).alias("seed"))
        )

    # Two window steps over one exchange: the new events by themselves, so that frames count rows and no repeat stands
    # in one; then every delivery takes the newest of them that arrived before it.
    keys = ["host_id", "chunk"]
    new_only = Window.partitionBy(*keys, "is_new").orderBy("ingest_seq")
    last_events, so_far = new_only.rowsBetween(-(window - 1), 0), new_only.rowsBetween(Window.unboundedPreceding, 0)
    arrival = Window.partitionBy(*keys).orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, 0)
    frame = F.struct(
        # Seeds are the oldest rows of their chunk, so every other row sees their offset.
        (F.coalesce(F.max("offset").over(so_far), F.lit(0)) + F.row_number().over(new_only)).alias("pos"),
        F.avg("cpu_usage").over(last_events).alias("avg_cpu"),
        F.avg("ram_usage").over(last_events).alias("avg_ram"),
        F.count(F.lit(1)).over(last_events).alias("size"),
        F.collect_list("error").over(last_events).alias("errors"),
        F.col("event_timestamp").alias("now"),
        "disk_usage",
        "disk_path",
    )
    framed = seeded.repartition(*keys).select("ingest_seq", *keys, "is_new", "seed", frame.alias("frame"))
    newest = F.last(F.when(F.col("is_new"), F.col("frame")), ignorenulls=True).over(arrival)
    return (
        framed.select("ingest_seq", "host_id", "is_new", "seed", newest.alias("frame"))
        .where(~F.col("seed") & F.col("frame").isNotNull())
        .select(
            "ingest_seq",
            "host_id",
            "frame.pos",
            "is_new",
            "frame.now",
            "frame.avg_cpu",
            "frame.avg_ram",
            "frame.size",
            "frame.disk_usage",
            "frame.disk_path",
            "frame.errors",
        )
    )


def host_windows(
    new_events: DataFrame, *, window: int = S.WINDOW, target: int | None = TARGET_ROWS
) -> DataFrame:
    """At each arrival the means and size of the host's last events; short windows use what exists."""
    return (
        evaluations(new_events.withColumn("is_new", F.lit(True)), window=window, target=target)
        .withColumnRenamed("now", "event_timestamp")
        .drop("is_new", "errors")
    )


def _evaluated(
    evals: DataFrame, rules: DataFrame | RuleLog, types: tuple[str, ...], defaults: dict[str, float] | None
) -> DataFrame:
    return with_effective_rules(
        evals, rules, spread="ingest_seq", defaults=defaults, rule_types=types
    )


def _level_signal(key: str, rule_type: str, sub_seq: int, value: Column, resource: Column) -> Column:
    """Struct of a threshold rule's signal: BREACH at or above an enabled threshold, else CLEAR."""
    rule = F.col(f"rule_{rule_type}")
    breach = rule["enabled"] & (value >= rule["threshold"])
    return F.struct(
        alert_key(key, F.col("host_id")).alias("alert_key"),
        F.lit(rule_type).alias("alert_type"),
        F.lit(sub_seq).alias("sub_seq"),
        F.when(breach, "BREACH").otherwise("CLEAR").alias("kind"),
        value.alias("value"),
        rule["threshold"].alias("threshold"),
        F.when(breach, percent_message(resource, value, rule["threshold"])).alias("message"),
    )


def _cpu_signal() -> Column:
    return _level_signal(CPU_KEY, S.HIGH_CPU, 1, F.col("avg_cpu"), F.lit("CPU average"))


def _ram_signal() -> Column:
    return _level_signal(RAM_KEY, S.HIGH_RAM, 2, F.col("avg_ram"), F.lit("RAM average"))


def _disk_signal() -> Column:
    """The newest reading alone decides; an unknown reading says nothing, not even CLEAR."""
    mount = F.coalesce(blank_to_null(F.col("disk_path")), F.lit("disk"))
    signal = _level_signal(DISK_KEY, S.HIGH_DISK, 3, F.col("disk_usage"), mount)
    return F.when(F.col("disk_usage").isNotNull(), signal)


def _recovery_signal() -> Column:
    return F.struct(
        alert_key(SILENT_KEY, F.col("host_id")).alias("alert_key"),
        F.lit(S.AGENT_SILENT).alias("alert_type"),
        F.lit(0).alias("sub_seq"),
        F.lit("CLEAR").alias("kind"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(None).cast("string").alias("message"),
    )


def _repeat_signals() -> Column:
    """Array of BREACH structs, one per message repeated often enough in the window.

    The window holds at most ``window`` messages, so the array work is bounded.  A repeat never
    clears by itself, and a disabled rule says nothing.
    """
    rule = F.col(f"rule_{S.REPEATED_ERROR}")
    distinct = F.array_sort(F.array_distinct("errors"))
    counted = F.transform(
        distinct,
        lambda text, i: F.struct(
            text.alias("text"),
            F.size(F.filter("errors", lambda other: other == text)).alias("times"),
            i.alias("i"),
        ),
    )
    often = F.filter(counted, lambda m: m["times"] >= rule["threshold"])
    signals = F.transform(
        often,
        lambda m: F.struct(
            alert_key(repeated_error_rule(m["text"]), F.col("host_id")).alias("alert_key"),
            F.lit(S.REPEATED_ERROR).alias("alert_type"),
            (m["i"] + 4).cast("int").alias("sub_seq"),
            F.lit("BREACH").alias("kind"),
            m["times"].cast("double").alias("value"),
            rule["threshold"].alias("threshold"),
            # Fixed value: the form of a repeated error's text.
            F.concat(
                m["text"], F.lit(" occurred "), m["times"].cast("string"), F.lit(" times")
            ).alias("message"),
        ),
    )
    return F.when(rule["enabled"], signals).otherwise(F.slice(signals, 1, 0))


def _emit(evaluated: DataFrame, signals: Column) -> DataFrame:
    exploded = evaluated.select(
        "host_id", "ingest_seq", F.col("now").alias("at"), F.inline(signals)
    )
    return exploded.select(*SIGNAL_COLUMNS)


def threshold_signals(
    evals: DataFrame, rules: DataFrame | RuleLog, *, defaults: dict[str, float] | None = None
) -> DataFrame:
    """CPU and RAM: every evaluation breaches or clears; a disabled rule clears."""
    evaluated = _evaluated(evals, rules, (S.HIGH_CPU, S.HIGH_RAM), defaults)
    return _emit(evaluated, F.array(_cpu_signal(), _ram_signal()))


def disk_signals(
    evals: DataFrame, rules: DataFrame | RuleLog, *, defaults: dict[str, float] | None = None
) -> DataFrame:
    known = evals.where(F.col("disk_usage").isNotNull())
    return _emit(_evaluated(known, rules, (S.HIGH_DISK,), defaults), F.array(_disk_signal()))


def repeated_error_signals(
    evals: DataFrame, rules: DataFrame | RuleLog, *, defaults: dict[str, float] | None = None
) -> DataFrame:
    """A BREACH per message and evaluation while enough copies are in the window."""
    some = evals.where(F.size("errors") > 0)
    return _emit(_evaluated(some, rules, (S.REPEATED_ERROR,), defaults), _repeat_signals())


def silence_recovery_signals(evals: DataFrame) -> DataFrame:
    """A host that reports is no longer silent."""
    return _emit(evals, F.array(_recovery_signal()))


def delivery_signals(
    evals: DataFrame, rules: DataFrame | RuleLog, *, defaults: dict[str, float] | None = None
) -> DataFrame:
    """All signals of every delivery in their fixed order, from one pass over the evaluations."""
    types = (S.HIGH_CPU, S.HIGH_RAM, S.HIGH_DISK, S.REPEATED_ERROR)
    levels = F.filter(
        F.array(_recovery_signal(), _cpu_signal(), _ram_signal(), _disk_signal()),
        lambda signal: signal.isNotNull(),
    )
    return _emit(_evaluated(evals, rules, types, defaults), F.concat(levels, _repeat_signals()))


def silence_signals(
    rollup: DataFrame,
    rules: DataFrame,
    *,
    now: datetime | Column,
    sweep_seq: int | Column,
    sub_seq: int = 1_000_000,
    forget_hours: int = S.FORGET_HOURS,
    defaults: dict[str, float] | None = None,
) -> DataFrame:
    """One sweep over the listed hosts (``host_rollup``): BREACH when silent, CLEAR when disabled.

    A host gone longer than the forget window gives nothing, not even CLEAR.  ``sweep_seq`` is the
    largest ``ingest_seq`` received by the time of the sweep.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    seq = sweep_seq if isinstance(sweep_seq, Column) else F.lit(sweep_seq)
    gap = micros(at) - micros(F.col("last_seen"))
    minutes = F.expr("cast(gap div 60000000 as bigint)")
    listed = with_effective_rules(
        rollup, rules, spread="host_id", defaults=defaults, rule_types=(S.AGENT_SILENT,)
    )
    rule = F.col(f"rule_{S.AGENT_SILENT}")
    limit = rule["threshold"].cast("long")
    forgotten = F.col("gap") > F.lit(forget_hours * 3_600_000_000)
    silent = ~forgotten & (F.col("minutes") >= limit)
    kind = F.when(~rule["enabled"], "CLEAR").when(silent, "BREACH")
    # Fixed value: the form of a silence alert's text.
    text = F.format_string("no events for %d minutes (threshold %d)", F.col("minutes"), limit)
    return (
        listed.withColumn("gap", gap)
        .withColumn("minutes", minutes)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            alert_key(SILENT_KEY, F.col("host_id")).alias("alert_key"),
            F.lit(S.AGENT_SILENT).alias("alert_type"),
            "host_id",
            seq.cast("long").alias("ingest_seq"),
            F.lit(sub_seq).alias("sub_seq"),
            at.alias("at"),
            "kind",
            F.when(F.col("kind") == "BREACH", F.col("minutes").cast("double")).alias("value"),
            rule["threshold"].alias("threshold"),
            F.when(F.col("kind") == "BREACH", text).alias("message"),
        )
    )


def silent_agents(sweep: DataFrame) -> DataFrame:
    """How many hosts each sweep found silent."""
    silent = F.count(F.when(F.col("kind") == "BREACH", True))
    return sweep.groupBy(F.col("at").alias("now")).agg(silent.alias("n"))


def signals(*parts: DataFrame) -> DataFrame:
    """The signal log: delivery signals, sweeps and operator actions together."""
    log = parts[0].select(*SIGNAL_COLUMNS)
    for part in parts[1:]:
        log = log.unionByName(part.select(*SIGNAL_COLUMNS))
    return log


def window_state(
    deliveries: DataFrame, *, window: int = S.WINDOW, tails: DataFrame | None = None
) -> DataFrame:
    """The state (host_id, seen, tail) after a batch: what ``evaluations(tails=...)`` starts from."""
    fresh = _members(deliveries).where("is_new").drop("is_new")
    counts = fresh.groupBy("host_id").agg(F.count(F.lit(1)).alias("seen"))
    if tails is not None:
        fresh = fresh.unionByName(tails.select("host_id", F.inline("tail")))
        counts = (
            counts.unionByName(tails.select("host_id", "seen"))
            .groupBy("host_id")
            .agg(F.sum("seen").alias("seen"))
        )
    return counts.join(window_tails(fresh, ["host_id"], size=window), "host_id")
