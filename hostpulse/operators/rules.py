"""Alert rules: validation, upserts and the host-over-fleet-over-default precedence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse import schemas as S
from hostpulse.functions import first_reason, is_blank, utf16_length
from hostpulse.operators.asof import as_of
from hostpulse.operators.lookup import lookup

# Refusal reasons for a rule change.
UNKNOWN_TYPE = "rule_type must be one of " + ", ".join(S.RULE_TYPES)
BLANK_HOST = "host_id must not be blank; omit it for a fleet-wide rule"
LONG_HOST = f"host_id must contain at most {S.MAX_ID_LENGTH} characters"
RESERVED_HOST = 'host_id "*" is reserved for fleet-wide rules; omit host_id instead'
NOT_FINITE = "threshold must be a finite number"
BAD_SILENCE = (
    f"an AGENT_SILENT threshold must be a whole number of minutes from 1 to {S.MAX_SILENCE_MINUTES}"
)
BAD_REPEATS = (
    "a REPEATED_ERROR threshold must be a whole number from 1 to {0}: the rule sees only the "
    "last {0} events, so a larger threshold could never fire"
)
BAD_PERCENTAGE = "a {} threshold must be a percentage between 0 and 100"


def scope_reason() -> Column:
    """Why the (rule_type, host_id) pair cannot name a rule; null when it can."""
    host = F.col("host_id")
    known = F.coalesce(F.col("rule_type").isin(*S.RULE_TYPES), F.lit(False))
    return first_reason(
        (~known, UNKNOWN_TYPE),
        (is_blank(host), BLANK_HOST),
        (utf16_length(host) > S.MAX_ID_LENGTH, LONG_HOST),
        (host == S.FLEET_SCOPE, RESERVED_HOST),
    )


def _threshold_reason(window: int) -> Column:
    rule, threshold = F.col("rule_type"), F.col("threshold")
    infinite = F.abs(threshold) == F.lit(float("inf"))
    broken = threshold != F.rint(threshold)
    per_type = (
        F.when(
            rule == S.AGENT_SILENT,
            F.when(broken | ~threshold.between(1, S.MAX_SILENCE_MINUTES), BAD_SILENCE),
        )
        .when(
            rule == S.REPEATED_ERROR,
            F.when(broken | ~threshold.between(1, window), BAD_REPEATS.format(window)),
        )
        .otherwise(
            F.when(
                ~threshold.between(0, 100),
                F.format_string(BAD_PERCENTAGE.replace("{}", "%s"), rule),
            )
        )
    )
    not_finite = threshold.isNull() | F.isnan(threshold) | infinite
    return F.when(not_finite, NOT_FINITE).otherwise(per_type)


def validate_rules(requests: DataFrame, *, window: int = S.WINDOW) -> DataFrame:
    """Add ``reason``: the first broken rule of a change request, null when it is acceptable."""
    return requests.withColumn("reason", F.coalesce(scope_reason(), _threshold_reason(window)))


def _scope() -> Column:
    return F.coalesce(F.col("host_id"), F.lit(S.FLEET_SCOPE))


def upsert_rules(log: DataFrame, *, window: int = S.WINDOW) -> DataFrame:
    """The rules in force after a change log; the last accepted change per (type, scope) wins.

    ``log`` has ``version`` (unique, the order of changes), ``rule_type``, ``host_id``,
    ``threshold``, ``enabled``, ``updated_at`` and optionally ``deleted``.  A deletion needs only a
    valid scope.  One aggregate: copies of a key collapse before the shuffle.
    """
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in log.columns else F.lit(False)
    reason = F.coalesce(scope_reason(), F.when(~deleted, _threshold_reason(window)))
    last = F.struct(
        F.col("threshold").cast("double").alias("threshold"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        "updated_at",
        deleted.alias("deleted"),
    )
    # Refused changes have no version and so never win; no filter repeats the long condition.
    return (
        log.withColumn("accepted_version", F.when(reason.isNull(), F.col("version")))
        .groupBy("rule_type", _scope().alias("scope"))
        .agg(F.max_by(last, "accepted_version").alias("last"))
        .where(~F.col("last.deleted"))
        .select("rule_type", "scope", "last.threshold", "last.enabled", "last.updated_at")
    )


def delete_rules(rules: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The remaining rules, and per requested (rule_type, host_id) whether a rule existed."""
    asked = keys.select("rule_type", _scope().alias("scope")).distinct()
    remaining = rules.join(asked, ["rule_type", "scope"], "left_anti")
    found = rules.select("rule_type", "scope", F.lit(True).alias("found"))
    existed = asked.join(found, ["rule_type", "scope"], "left").select(
        "rule_type",
        F.nullif("scope", F.lit(S.FLEET_SCOPE)).alias("host_id"),
        F.coalesce("found", F.lit(False)).alias("existed"),
    )
    return remaining, existed


def list_rules(rules: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Stored rules by type and scope, with the name to show for the host.

    ``hosts`` (host_id, hostname) supplies names; without it the host id is shown.
    """
    host = F.nullif("scope", F.lit(S.FLEET_SCOPE))
    listed = rules.withColumn("host_id", host)
    if hosts is None:
        listed = listed.withColumn("hostname", F.lit(None).cast("string"))
    else:
        listed = listed.join(hosts.select("host_id", "hostname"), "host_id", "left")
    # Fixed value: how a fleet-wide rule is labelled.
    name = F.coalesce("hostname", "host_id", F.lit("All machines"))
    return listed.orderBy("rule_type", "scope").select(
        "rule_type", "host_id", name.alias("display_name"), "threshold", "enabled", "updated_at"
    )


def default_rules(rules: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """The configured defaults as rows (rule_type, threshold)."""
    values = {**S.DEFAULT_THRESHOLDS, **(defaults or {})}
    entries = [F.struct(F.lit(t).alias("rule_type"), F.lit(float(values[t])).alias("threshold"))
               for t in S.RULE_TYPES]
    spark = rules.sparkSession
    return spark.range(1).select(F.inline(F.array(*entries)))


def rules_by_host(
    rules: DataFrame, *, rule_types: tuple[str, ...] = S.RULE_TYPES
) -> DataFrame:
    """One row per host with own rules: a struct (threshold, enabled) or null per rule type."""
    value = F.struct("threshold", "enabled")
    columns = [
        F.first(F.when(F.col("rule_type") == t, value), ignorenulls=True).alias(f"host_{t}")
        for t in rule_types
    ]
    return (
        rules.where(F.col("scope") != S.FLEET_SCOPE)
        .groupBy(F.col("scope").alias("host_id"))
        .agg(*columns)
    )


@dataclass(frozen=True)
class RuleLog:
    """The change log of the rules instead of their last state: every row is judged by the rules in force when it came.

    ``log`` is what ``upsert_rules`` takes, with ``order``: the arrival number after which a change counts, in the numbers of the rows that
    are judged.  ``slice_rows`` is how many rows share a task for the fleet-wide rules, which are one key for all rows.
    """

    log: DataFrame
    order: str = "ingest_seq"
    window: int = S.WINDOW
    slice_rows: int = 200_000

    def accepted(self) -> DataFrame:
        """(scope, rule_type, order, rule): the rule after each accepted change, its threshold null where it was deleted."""
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in self.log.columns else F.lit(False)
        reason = F.coalesce(scope_reason(), F.when(~deleted, _threshold_reason(self.window)))
        rule = F.struct(
            F.when(~deleted, F.col("threshold").cast("double")).alias("threshold"),
            F.coalesce("enabled", F.lit(True)).alias("enabled"),
        )
        made = self.log.select(_scope().alias("scope"), "rule_type", self.order, rule.alias("rule"), reason.alias("reason"))
        return made.where(F.col("reason").isNull()).drop("reason")


def _with_rules_as_of(
    rows: DataFrame, changes: RuleLog, *, defaults: dict[str, float] | None, rule_types: tuple[str, ...]
) -> DataFrame:
    """``with_effective_rules`` by two as-of joins, one over all rows and one on the host."""
    values = {**S.DEFAULT_THRESHOLDS, **(defaults or {})}
    accepted = changes.accepted().where(F.col("rule_type").isin(*rule_types))
    of_type = lambda t: F.when(F.col("rule_type") == t, F.col("rule"))
    order = changes.order
    general = accepted.where(F.col("scope") == S.FLEET_SCOPE)
    # The fleet's rules first: what follows on the rows then runs in the many tasks of the hosts, not in the slices of one key.
    joined = as_of(
        rows.withColumn("scope", F.lit(S.FLEET_SCOPE)), general, "scope", order,
        {f"fleet_{t}": of_type(t) for t in rule_types}, target=changes.slice_rows,
    )
    own = accepted.where(F.col("scope") != S.FLEET_SCOPE).withColumnRenamed("scope", "host_id")
    joined = as_of(joined, own, "host_id", order, {f"host_{t}": of_type(t) for t in rule_types})
    for t in rule_types:
        default = F.struct(F.lit(float(values[t])).alias("threshold"), F.lit(True).alias("enabled"), F.lit("default").alias("source"))
        own_rule, fleet_rule = F.col(f"host_{t}"), F.col(f"fleet_{t}")
        joined = joined.withColumn(
            f"rule_{t}",
            F.when(own_rule["threshold"].isNotNull(), _tier(own_rule, "host"))
            .when(fleet_rule["threshold"].isNotNull(), _tier(fleet_rule, "fleet"))
            .otherwise(default),
        )
    return joined.drop("scope", *(f"{tier}_{t}" for t in rule_types for tier in ("host", "fleet")))


def with_effective_rules(
    rows: DataFrame,
    rules: DataFrame | RuleLog,
    *,
    spread: str,
    defaults: dict[str, float] | None = None,
    rule_types: tuple[str, ...] = S.RULE_TYPES,
) -> DataFrame:
    """Add per rule type a struct ``rule_<TYPE>`` (threshold, enabled, source) for the row's host.

    The most specific tier wins as a whole: a disabled host rule still beats a fleet rule.  Host
    rules come from a size-checked lookup, the fleet rules (one per type) are one scalar subquery.
    With a ``RuleLog`` the rules are those of each row's own time.
    """
    if isinstance(rules, RuleLog):
        return _with_rules_as_of(rows, rules, defaults=defaults, rule_types=rule_types)
    values = {**S.DEFAULT_THRESHOLDS, **(defaults or {})}
    joined = lookup(
        rows, rules_by_host(rules, rule_types=rule_types), "host_id", spread=spread
    )
    fleet = rules.where(F.col("scope") == S.FLEET_SCOPE).agg(
        F.map_from_entries(
            F.collect_list(F.struct("rule_type", F.struct("threshold", "enabled")))
        )
    )
    joined = joined.withColumn("fleet_rules", fleet.scalar())
    for rule_type in rule_types:
        own = F.col(f"host_{rule_type}")
        general = F.col("fleet_rules")[rule_type]
        joined = joined.withColumn(
            f"rule_{rule_type}",
            F.when(own.isNotNull(), _tier(own, "host"))
            .when(general.isNotNull(), _tier(general, "fleet"))
            .otherwise(
                F.struct(
                    F.lit(float(values[rule_type])).alias("threshold"),
                    F.lit(True).alias("enabled"),
                    F.lit("default").alias("source"),
                )
            ),
        )
    return joined.drop("fleet_rules", *[f"host_{t}" for t in rule_types])


def _tier(rule: Column, source: str) -> Column:
    return F.struct(
        rule["threshold"].alias("threshold"),
        rule["enabled"].alias("enabled"),
        F.lit(source).alias("source"),
    )


def effective_rules_as_of(
    rows: DataFrame,
    changes: RuleLog,
    *,
    defaults: dict[str, float] | None = None,
    rule_types: tuple[str, ...] = S.RULE_TYPES,
) -> DataFrame:
    """Per row (host_id and the order of arrival) and rule type the threshold that applied when it came, and its tier."""
    applied = _with_rules_as_of(rows.select("host_id", changes.order), changes, defaults=defaults, rule_types=rule_types)
    each = [F.struct(F.lit(t).alias("rule_type"), F.col(f"rule_{t}").alias("rule")) for t in rule_types]
    return applied.select("host_id", changes.order, F.inline(F.array(*each))).select(
        "host_id", changes.order, "rule_type", "rule.threshold", "rule.enabled", "rule.source"
    )


def effective_rules(
    hosts: DataFrame,
    rules: DataFrame,
    *,
    defaults: dict[str, float] | None = None,
    rule_types: tuple[str, ...] = S.RULE_TYPES,
) -> DataFrame:
    """Per host and rule type the threshold that applies and the tier it comes from."""
    applied = with_effective_rules(
        hosts.select("host_id"), rules, spread="host_id", defaults=defaults, rule_types=rule_types
    )
    each = [
        F.struct(F.lit(t).alias("rule_type"), F.col(f"rule_{t}").alias("rule")) for t in rule_types
    ]
    return applied.select("host_id", F.inline(F.array(*each))).select(
        "host_id", "rule_type", "rule.threshold", "rule.enabled", "rule.source"
    )


def unreachable_rules(
    rules: DataFrame, *, window: int = S.WINDOW, defaults: dict[str, float] | None = None
) -> DataFrame:
    """Repeat rules, stored or default, whose threshold exceeds the window and so never fire."""
    stored = rules.select("rule_type", "scope", "threshold")
    configured = default_rules(rules, defaults).select(
        "rule_type", F.lit("default").alias("scope"), "threshold"
    )
    return stored.unionByName(configured).where(
        (F.col("rule_type") == S.REPEATED_ERROR) & (F.col("threshold") > window)
    )
