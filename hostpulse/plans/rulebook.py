"""Registered rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.operators import rules as R
from hostpulse.plans import fixtures
from hostpulse.plans.checks import check
from hostpulse.plans.registry import query


def requests(spark, sf):
    return fixtures.load(spark, sf, "rule_requests")


@query(
    "validate_rules",
    check("""
SELECT version, rule_type, host_id, coalesce(scope_reason, threshold_reason) AS reason
FROM rule_reasons"""),
)
def _(spark, sf):
    return R.validate_rules(requests(spark, sf)).select(
        "version", "rule_type", "host_id", "reason"
    )


@query(
    "upsert_rules", check("SELECT rule_type, scope, threshold, enabled, updated_at FROM live_rules")
)
def _(spark, sf):
    return R.upsert_rules(requests(spark, sf))


_DELETIONS = """
SELECT DISTINCT rule_type, coalesce(host_id, '*') AS scope FROM rule_requests
WHERE rule_type LIKE 'HIGH_R%' OR host_id IS NULL"""


def _deletions(spark, sf):
    log = requests(spark, sf)
    return log.where(F.col("rule_type").startswith("HIGH_R") | F.col("host_id").isNull())


@query(
    "delete_rules",
    check(f"""
SELECT d.rule_type, nullif(d.scope, '*') AS host_id, r.scope IS NOT NULL AS existed
FROM ({_DELETIONS}) AS d LEFT JOIN live_rules r ON r.rule_type = d.rule_type AND r.scope = d.scope
"""),
)
def _(spark, sf):
    return R.delete_rules(fixtures.rules(spark, sf), _deletions(spark, sf))[1]


@query(
    "delete_rules_remaining",
    check(f"""
SELECT rule_type, scope, threshold, enabled, updated_at FROM live_rules
WHERE (rule_type, scope) NOT IN ({_DELETIONS})"""),
)
def _(spark, sf):
    return R.delete_rules(fixtures.rules(spark, sf), _deletions(spark, sf))[0]


@query(
    "list_rules",
    check("""
SELECT r.rule_type, nullif(r.scope, '*') AS host_id,
  coalesce(h.hostname, nullif(r.scope, '*'), 'All machines') AS display_name, r.threshold, r.enabled,
  r.updated_at FROM live_rules r LEFT JOIN rollup h ON h.host_id = r.scope"""),
)
def _(spark, sf):
    from hostpulse.operators.queries import host_rollup

    hosts = host_rollup(fixtures.load(spark, sf, "telemetry"), limit=None)
    return R.list_rules(fixtures.rules(spark, sf), hosts)


@query(
    "effective_rules",
    check("SELECT host_id, rule_type, threshold, enabled, source FROM effective"),
)
def _(spark, sf):
    hosts = fixtures.load(spark, sf, "telemetry").select("host_id").distinct()
    return R.effective_rules(hosts, fixtures.rules(spark, sf))


def rule_log(spark, sf):
    """All change requests; each counts for the events that arrive after the one it stands for."""
    return R.RuleLog(requests(spark, sf).withColumn("ingest_seq", F.col("version") * 10 + 1))


@query(
    "effective_rules_asof",
    check("SELECT host_id, ingest_seq, rule_type, threshold, enabled, source FROM effective_asof"),
)
def _(spark, sf):
    from hostpulse.plans.detection import evaluated

    return R.effective_rules_as_of(evaluated(spark, sf), rule_log(spark, sf))


@query(
    "unreachable_rules",
    check("""
SELECT rule_type, scope, threshold FROM live_rules
WHERE rule_type = 'REPEATED_ERROR' AND threshold > 3
UNION ALL SELECT rule_type, 'default', threshold FROM rule_defaults
WHERE rule_type = 'REPEATED_ERROR' AND threshold > 3"""),
)
def _(spark, sf):
    return R.unreachable_rules(fixtures.rules(spark, sf), window=3)
