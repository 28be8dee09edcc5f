"""The fleet as a stream: raw submissions in, telemetry, refusals, alert transitions and notifications out.

Each micro-batch runs the batch operators with the state the batches before left behind: the last
window of every host, the running numbers of every alert, the open windows of the rate limiter, the newest reminder of
every alert, when each host was last seen.  A batch is thus one more chunk of the
same ordered work (see ``operators.hot_keys``), and a hot host is split inside a batch as it is in a
batch job.

A batch writes folders named after its version, and one snapshot at the end makes them all count (``sources.versions``).  A
batch that a snapshot already holds is skipped, one that broke off replaces what it left.  So a restart from the
checkpoint gives every result exactly once, and no reader sees half a batch.  Nothing is dropped for
being late: windows follow arrival order and need no watermark.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hostpulse import schemas as S
from hostpulse.operators import credentials as C
from hostpulse.operators import detect as D
from hostpulse.operators import id_index as X
from hostpulse.operators import ingest as I
from hostpulse.operators import lifecycle as L
from hostpulse.operators import notify as N
from hostpulse.operators.hot_keys import TARGET_ROWS
from hostpulse.sources.raw import number_batch
from hostpulse.sources.tables import by_day, delete_folder, prune_table, read_deliveries
from hostpulse.sources.versions import Snapshot, Versions

# Batches and sweeps of one fleet run on the driver one after the other.
_TURNS: defaultdict[str, threading.RLock] = defaultdict(threading.RLock)
# Sweeps come after all signals of the newest delivery, in their own order.
_SWEEP_SUB_SEQ = 1_000_000
# The sweep that ends a batch; later ones have higher numbers.
_ENDING_SWEEP = 1


@dataclass(frozen=True)
class Fleet:
    """The folders of one fleet below ``root``, and how its events are judged.

    ``rules`` is read again in every batch, so a rule change counts from the next event.  With
    ``credentials`` submissions must authorise and are attributed to the credential's host; with ``max_requests`` they also pass
    the checks of an HTTP request and the rate limiter, whose windows go on from batch to batch.

    A batch looks for its event ids among all stored ids.  Where copies of an event always carry the
    same event time (agents resend the stored payload), ``same_time_copies`` compares ids of one day only.

    ``deliveries`` is the log of delivery attempts that the sender of the outbox appends to; reminders are due
    ``cooldown_s`` after the newest one in it or the newest reminder.  With ``retention_days`` a batch with a clock also
    removes older telemetry and delivery attempts, once a day.
    """

    root: str
    rules: str | None = None
    credentials: str | None = None
    shared_hash: str | None = None
    window: int = S.WINDOW
    defaults: dict[str, float] | None = None
    same_time_copies: bool = False
    max_requests: int | None = None
    window_ms: int = 60_000
    deliveries: str | None = None
    cooldown_s: int = 900
    retention_days: int = 0
    id_buckets: int = X.BUCKETS

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def version(self, batch_id: int, sweep: int = 0) -> str:
        return f"{batch_id:012d}-{sweep:06d}"

    def versions(self, spark: SparkSession) -> Versions:
        return Versions(spark, self.root)

    def read_rules(self, spark: SparkSession) -> DataFrame:
        if self.rules is None:
            return spark.createDataFrame([], S.RULES)
        return spark.read.schema(S.RULES).parquet(self.rules)

    def read_credentials(self, spark: SparkSession) -> DataFrame:
        """The credentials with their last use as the stream has seen it."""
        known = spark.read.schema(S.CREDENTIALS).parquet(self.credentials)
        used = self.versions(spark).state("credentials")
        if used is None:
            return known
        newer = F.greatest("last_used_at", "used_at").alias("last_used_at")  # a null is less than any time
        joined = known.join(used.select("id", F.col("last_used_at").alias("used_at")), "id", "left")
        return joined.select(*(newer if c == "last_used_at" else c for c in known.columns))

    def telemetry(self, spark: SparkSession) -> DataFrame:
        """All stored events."""
        return self.versions(spark).table("telemetry")

    def transitions(self, spark: SparkSession) -> DataFrame:
        return self.versions(spark).table("transitions")

    def rejected(self, spark: SparkSession) -> DataFrame:
        return self.versions(spark).table("rejected")

    def outbox(self, spark: SparkSession) -> DataFrame:
        """Every notification to send."""
        return self.versions(spark).table("outbox")

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """Counts by outcome, refusal reason and credential method since the start, from the counts of each batch."""
        counts = self.versions(spark).table("counts")
        return counts.groupBy("outcome", "reason", "method").agg(F.sum("n").alias("n"))

    def alerts(self, spark: SparkSession) -> DataFrame:
        return L.current_alerts(self.transitions(spark))

    def finished(self, spark: SparkSession) -> str:
        """The newest complete version; empty before the first."""
        return self.versions(spark).newest().version


def stream_new_events(events: DataFrame, *, delay: str = "30 days") -> DataFrame:
    """First arrivals of a stream by keyed state that forgets an id ``delay`` after its event time.

    For streams whose copies never share a micro-batch; ``start_fleet`` also orders copies inside a
    batch and remembers ids as long as their events are stored.
    """
    timed = events.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    return timed.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


class _Turn:
    """The work on one version: what it writes is gathered and committed at its end."""

    def __init__(self, spark: SparkSession, fleet: Fleet, store: Versions, before: Snapshot, version: str):
        self.spark, self.fleet, self.store, self.before, self.version = spark, fleet, store, before, version
        self.tables: dict[str, T.StructType] = {}
        self.states: dict[str, T.StructType] = {}
        self.numbers: dict[str, int] = {}
        self.scratch: list[str] = []

    def table(self, name: str, df: DataFrame, *, partition: list[str] | None = None) -> DataFrame:
        self.tables[name] = df.schema
        return self.store.write(df, name, self.version, partition=partition)

    def state(self, name: str, df: DataFrame) -> DataFrame:
        self.states[name] = df.schema
        return self.store.write(df, f"state/{name}", self.version)

    def work(self, name: str, df: DataFrame) -> DataFrame:
        """A stage that is removed when the version is committed."""
        self.scratch.append(self.store.folder(f"work/{name}", self.version))
        return self.store.write(df, f"work/{name}", self.version)

    def known(self, name: str) -> DataFrame | None:
        return self.store.state(name, self.before)

    def finish(self) -> Snapshot:
        after = self.store.commit(self.version, self.before, tables=self.tables, states=self.states, numbers=self.numbers)
        for folder in self.scratch:
            delete_folder(self.spark, folder)
        # the filters of merged ids are written with them
        return self.store.compact(after, {"ids": self.merge_ids, "blooms": lambda rows, name: None, "telemetry": self.merge_events})

    def merge_events(self, rows: DataFrame, name: str) -> None:
        self.store.write(by_day(rows), "telemetry", name, partition=["event_date"])

    def merge_ids(self, rows: DataFrame, name: str) -> None:
        X.write_ids(rows, self.store.folder("ids", name), self.store.folder("blooms", name), buckets=self.fleet.id_buckets)


def _split_target(rows: DataFrame) -> int | None:
    """No key of a table with few rows can be hot; the count comes from the file footers."""
    return TARGET_ROWS if rows.count() > TARGET_ROWS else None


def _admit(turn: _Turn, numbered: DataFrame) -> DataFrame:
    """Checked submissions with ``method``, ``refusal`` and, in full, ``reason``; both are null on the acceptable ones."""
    fleet = turn.fleet
    if fleet.credentials is not None:
        known = turn.spark.read.schema(S.CREDENTIALS).parquet(fleet.credentials)
        numbered = I.authorize_events(numbered, known, shared_hash=fleet.shared_hash)
    else:
        numbered = numbered.withColumn("method", F.lit(None).cast("string"))
    if fleet.max_requests is None:
        checked = I.validate_events(I.parse_events(numbered))
        refused = F.when(F.col("method") == "unauthorized", "unauthorized")
        return checked.withColumn("refusal", F.coalesce(refused, I.body_refusal())).withColumn("reason", F.coalesce(refused, F.col("reason")))
    authorised = turn.work("authorised", numbered.withColumn("method", F.coalesce("method", F.lit("open"))))
    limits = {"max_requests": fleet.max_requests, "window_ms": fleet.window_ms}
    asked = I.asked_requests(authorised)
    limited = turn.work("limited", I.limit_requests(asked, state=turn.known("limiter"), target=_split_target(asked), **limits))
    turn.state("limiter", I.limiter_state(limited, turn.known("limiter"), **limits))
    bodies = I.admitted_bodies(authorised, limited, max_requests=fleet.max_requests).withColumn("detail", F.col("reason"))
    admitted = I.admission_reason(bodies).withColumn("refusal", F.col("reason"))
    return admitted.withColumn("reason", F.when(F.col("refusal") == "validation", F.col("detail")).otherwise(F.col("refusal"))).drop("detail")


def _stored(turn: _Turn, events: DataFrame) -> DataFrame | None:
    """Stored ids among which those of the batch may be, from the files whose filters let one through."""
    folders = turn.before.tables.get("ids", [])
    if not folders:
        return None
    store, buckets = turn.store, turn.fleet.id_buckets
    blooms = turn.spark.read.schema(X.BLOOMS).parquet(*(store.folder("blooms", f) for f in folders))
    return X.stored_ids(events, folders, blooms, buckets=buckets)


def _deduped(turn: _Turn, events: DataFrame) -> DataFrame:
    stored = _stored(turn, events)
    if stored is not None and turn.fleet.same_time_copies:
        dated = events.select("event_id", F.to_date("event_timestamp").alias("event_date")).distinct()
        stored = stored.join(dated, ["event_id", "event_date"], "left_semi")
    return I.dedupe_events(events, stored=stored)


def _judge(turn: _Turn, log: DataFrame) -> None:
    """Fold a signal log into transitions, the next alert state and the outbox."""
    folded = turn.work("folded", L.fold_signals(log, state=turn.known("alerts"), target=_split_target(log)))
    transitions = turn.table("transitions", L.transitions_of(folded))
    turn.state("alerts", L.state_of(folded, turn.known("alerts")))
    _notify(turn, transitions)


def _notify(turn: _Turn, transitions: DataFrame) -> None:
    """Decide on every transition; the delivery attempts logged since the last turn count first."""
    fleet, spark = turn.fleet, turn.spark
    seen = turn.before.numbers.get("delivery_id", -1)
    log = spark.createDataFrame([], S.DELIVERIES)
    if fleet.deliveries is not None:
        log = read_deliveries(spark, fleet.deliveries)
        newest = log.where(F.col("id") > seen).agg(F.max("id")).first()[0]
        log = log.where((F.col("id") > seen) & (F.col("id") <= (seen if newest is None else newest)))
        turn.numbers["delivery_id"] = seen if newest is None else newest
    marked = None
    if fleet.cooldown_s > 0:
        state = turn.known("reminders")
        marked = N.fold_reminders(transitions, log, cooldown_s=fleet.cooldown_s, state=state, target=_split_target(transitions))
        marked = turn.work("reminders", marked)
        turn.state("reminders", N.reminder_state(marked, state))
    policy = N.notification_policy(transitions, log, cooldown_s=fleet.cooldown_s, marked=marked)
    policy = turn.work("policy", policy)
    turn.table("outbox", N.notification_outbox(policy))
    turn.table("decisions", policy.groupBy("decision").agg(F.count(F.lit(1)).alias("n")))


def _hosts_after(known: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """When each host was last seen, those that fall silent first in front."""
    seen = fresh.where(F.col("host_id").isNotNull()).select("host_id", F.col("event_timestamp").alias("last_seen"))
    if known is not None:
        seen = seen.unionByName(known)
    return seen.groupBy("host_id").agg(F.max("last_seen").alias("last_seen")).sortWithinPartitions("last_seen")


def process_batch(
    fleet: Fleet, batch: DataFrame, batch_id: int, *, now: datetime | Column | None = None
) -> None:
    """One micro-batch from raw submissions to notifications; with ``now`` a silence sweep ends it.

    A batch that is finished is not done again, nor is its sweep.
    """
    spark = batch.sparkSession
    with _TURNS[fleet.root]:
        store = fleet.versions(spark)
        before = store.newest()
        if not before.holds(fleet.version(batch_id)):
            before = _ingest(_Turn(spark, fleet, store, before, fleet.version(batch_id)), batch)
        if now is not None:
            ending = fleet.version(batch_id, _ENDING_SWEEP)
            if not before.holds(ending):
                _sweep(_Turn(spark, fleet, store, before, ending), now)
            prune_fleet(spark, fleet, now=now)


def _ingest(turn: _Turn, batch: DataFrame) -> Snapshot:
    fleet = turn.fleet
    newest = turn.before.numbers.get("ingest_seq", -1)
    raw = turn.work("checked", _admit(turn, number_batch(batch, newest)).drop("j"))
    refused = raw.where(F.col("reason").isNotNull())
    turn.table("rejected", refused.select("ingest_seq", "value", "received_at", "reason"))

    bound = ("bound_host_id",) if fleet.credentials is not None else ()
    parsed = raw.where(F.col("reason").isNull()).withColumn("j", F.try_parse_json("value"))
    events = I.normalize_events(parsed, keep=(*bound, "method"))
    if bound:
        events = I.attribute_events(events).drop("host_mismatch", "bound_host_id")
    deliveries = turn.work("deliveries", _deduped(turn, events.drop("claimed_host_id")))
    counted = refused.select(F.col("refusal").alias("reason"), "method").withColumn("is_new", F.lit(False))
    counted = counted.unionByName(deliveries.select(F.lit(None).cast("string").alias("reason"), "method", "is_new"))
    turn.table("counts", I.ingest_outcomes(counted))

    fresh = deliveries.where("is_new").drop("is_new", "method")
    dated = fresh.withColumn("event_date", F.to_date("event_timestamp"))
    turn.table("telemetry", by_day(dated), partition=["event_date"])
    turn.merge_ids(dated.select("event_id", "event_date"), turn.version)
    turn.tables |= {"ids": X.IDS, "blooms": T.StructType.fromDDL(X.BLOOMS)}
    turn.state("hosts", _hosts_after(turn.known("hosts"), fresh))

    tails = turn.known("windows")
    evals = D.evaluations(deliveries, window=fleet.window, tails=tails, target=_split_target(deliveries))
    log = D.delivery_signals(evals, fleet.read_rules(turn.spark), defaults=fleet.defaults)
    _judge(turn, turn.work("signals", log))
    turn.state("windows", D.window_state(deliveries, window=fleet.window, tails=tails))
    if fleet.credentials is not None:
        _use_credentials(turn, raw)
    # the last number received, copies and refusals included: sweeps and later batches come after it
    last = raw.agg(F.max("ingest_seq")).first()[0]
    turn.numbers["ingest_seq"] = newest if last is None else last
    return turn.finish()


def _use_credentials(turn: _Turn, raw: DataFrame) -> None:
    """Move the last use of the credentials that accepted submissions presented."""
    uses = raw.where(F.col("reason").isNull() & F.col("agent_id").isNotNull())
    uses = uses.select(F.col("agent_id").alias("id"), F.col("received_at").alias("at"))
    known = turn.fleet.read_credentials(turn.spark)
    moved = C.credential_last_used(known, uses, target=_split_target(raw))
    turn.state("credentials", moved.where(F.col("last_used_at").isNotNull()).select("id", "last_used_at"))


def start_fleet(
    raw: DataFrame,
    fleet: Fleet,
    *,
    once: bool = False,
    every: str = "10 seconds",
    clock: Callable[[], datetime] | None = None,
) -> StreamingQuery:
    """Start the stream over ``read_raw_events(..., streaming=True)`` or ``replay_queue``.

    ``once`` works off what is there and stops.  With a ``clock`` every micro-batch ends with a silence sweep at its
    time; when no events come at all, call ``sweep_once`` beside the stream.
    """
    writer = (
        raw.writeStream.queryName("fleet")
        .option("checkpointLocation", fleet.path("checkpoint"))
        .foreachBatch(
            lambda batch, batch_id: process_batch(
                fleet, batch, batch_id, now=None if clock is None else F.lit(clock())
            )
        )
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def _sweep(turn: _Turn, now: datetime | Column) -> DataFrame:
    """A sweep over the hosts' last-seen state; no event is read."""
    if "ingest_seq" not in turn.before.numbers:
        raise ValueError("nothing has been ingested yet")
    number = turn.before.numbers.get("sweeps", 0) + 1
    signals = D.silence_signals(
        turn.known("hosts"),
        turn.fleet.read_rules(turn.spark),
        now=now,
        sweep_seq=turn.before.numbers["ingest_seq"],
        sub_seq=_SWEEP_SUB_SEQ + number,
        defaults=turn.fleet.defaults,
    )
    turn.numbers["sweeps"] = number
    log = turn.table("sweeps", signals)
    _judge(turn, log)
    turn.finish()
    return log


def sweep_once(spark: SparkSession, fleet: Fleet, *, now: datetime | Column) -> DataFrame:
    """One silence sweep over all hosts with stored events; waits for a micro-batch that is running.

    Returns the sweep's signals.  A sweep is a further version after the newest batch, and the next batch
    starts from its state.
    """
    with _TURNS[fleet.root]:
        store = fleet.versions(spark)
        before = store.newest()
        if not before.version:
            raise ValueError("nothing has been ingested yet")
        batch_id, last = (int(part) for part in before.version.split("-"))
        version = fleet.version(batch_id, max(last, _ENDING_SWEEP) + 1)
        return _sweep(_Turn(spark, fleet, store, before, version), now)


def prune_fleet(spark: SparkSession, fleet: Fleet, *, now: datetime | Column, force: bool = False) -> int:
    """Retention on the fleet's telemetry and on its delivery log, at most once a day; returns how many rows went.

    Runs between turns, so no batch reads a table that is being rewritten.
    """
    if fleet.retention_days <= 0:
        return 0
    with _TURNS[fleet.root]:
        at = now if isinstance(now, Column) else F.lit(now)
        day = spark.range(1).select(F.unix_date(at.cast("date"))).first()[0]
        store = fleet.versions(spark)
        before = store.newest()
        if not before.version or (not force and before.numbers.get("pruned_day") == day):
            return 0
        folders = before.tables.get("telemetry", [])
        gone = prune_table(
            spark, fleet.path("telemetry"), schema=S.TELEMETRY, time_col="event_timestamp", now=now, days=fleet.retention_days, versions=folders
        )
        if fleet.deliveries is not None:
            gone += prune_table(spark, fleet.deliveries, schema=S.DELIVERIES, time_col="attempted_at", now=now, days=fleet.retention_days)
        store.note(before, {"pruned_day": day})
        return gone
