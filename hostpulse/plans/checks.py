"""Common table expressions of the checking SQL (DuckDB), each written for clarity, not speed."""

from __future__ import annotations

import re

from hostpulse.operators import rules as R
from hostpulse.plans import fixtures

NOW = f"TIMESTAMP '{fixtures.NOW_TEXT}'"

CTES = {"numbered": f"SELECT *, {fixtures.DUCK_K} AS k FROM events", **fixtures.TEXTS}



def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CTES["rule_reasons"] = f"""
SELECT *, CASE
  WHEN rule_type NOT IN ('HIGH_CPU','HIGH_RAM','HIGH_DISK','REPEATED_ERROR','AGENT_SILENT')
    THEN {quoted(R.UNKNOWN_TYPE)}
  WHEN trim(host_id) = '' THEN {quoted(R.BLANK_HOST)}
  WHEN length(host_id) > 128 THEN {quoted(R.LONG_HOST)}
  WHEN host_id = '*' THEN {quoted(R.RESERVED_HOST)}
  END AS scope_reason,
  CASE WHEN isnan(threshold) THEN {quoted(R.NOT_FINITE)}
  WHEN rule_type = 'AGENT_SILENT' AND (threshold <> floor(threshold) OR threshold < 1
    OR threshold > 10080) THEN {quoted(R.BAD_SILENCE)}
  WHEN rule_type = 'REPEATED_ERROR' AND (threshold <> floor(threshold) OR threshold < 1
    OR threshold > 5) THEN {quoted(R.BAD_REPEATS.format(5))}
  WHEN rule_type LIKE 'HIGH%' AND (threshold < 0 OR threshold > 100)
    THEN replace({quoted(R.BAD_PERCENTAGE)}, '{{}}', rule_type)
  END AS threshold_reason
FROM rule_requests
"""
CTES["live_rules"] = """
SELECT rule_type, scope, threshold, enabled, updated_at FROM (
  SELECT rule_type, coalesce(host_id, '*') AS scope, threshold, coalesce(enabled, true) AS enabled,
    deleted, updated_at, row_number() OVER (PARTITION BY rule_type, coalesce(host_id, '*')
      ORDER BY version DESC) AS rn
  FROM rule_reasons WHERE scope_reason IS NULL AND (deleted OR threshold_reason IS NULL)
) AS ranked WHERE rn = 1 AND NOT deleted
"""
CTES["rule_defaults"] = """
SELECT * FROM (VALUES (1, 'HIGH_CPU', CAST(85 AS DOUBLE)), (2, 'HIGH_RAM', CAST(80 AS DOUBLE)),
  (3, 'HIGH_DISK', CAST(90 AS DOUBLE)), (4, 'REPEATED_ERROR', CAST(5 AS DOUBLE)),
  (5, 'AGENT_SILENT', CAST(10 AS DOUBLE))) AS d(place, rule_type, threshold)
"""
CTES["host_names"] = "SELECT DISTINCT host_id FROM telemetry"
CTES["effective"] = """
SELECT h.host_id, d.rule_type,
  CASE WHEN o.scope IS NOT NULL THEN o.threshold WHEN f.scope IS NOT NULL THEN f.threshold
       ELSE d.threshold END AS threshold,
  CASE WHEN o.scope IS NOT NULL THEN o.enabled WHEN f.scope IS NOT NULL THEN f.enabled
       ELSE true END AS enabled,
  CASE WHEN o.scope IS NOT NULL THEN 'host' WHEN f.scope IS NOT NULL THEN 'fleet'
       ELSE 'default' END AS source
FROM host_names h CROSS JOIN rule_defaults d
LEFT JOIN live_rules o ON o.rule_type = d.rule_type AND o.scope = h.host_id
LEFT JOIN live_rules f ON f.rule_type = d.rule_type AND f.scope = '*'
"""
CTES["flagged"] = """
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_seq) = 1 AS is_new
FROM deliveries
"""
CTES["windows"] = """
SELECT ingest_seq, host_id, event_timestamp, level, message, disk_usage, disk_path,
  row_number() OVER (PARTITION BY host_id ORDER BY ingest_seq) AS pos,
  avg(cpu_usage) OVER last_five AS avg_cpu, avg(ram_usage) OVER last_five AS avg_ram,
  count(*) OVER last_five AS size
FROM flagged WHERE is_new
WINDOW last_five AS (PARTITION BY host_id ORDER BY ingest_seq ROWS BETWEEN 4 PRECEDING
  AND CURRENT ROW)
"""
CTES["evals"] = """
SELECT p.ingest_seq, p.host_id, p.is_new, w.pos, w.event_timestamp AS now, w.avg_cpu, w.avg_ram,
  w.size, w.disk_usage, w.disk_path
FROM (SELECT ingest_seq, host_id, is_new, sum(CASE WHEN is_new THEN 1 ELSE 0 END)
    OVER (PARTITION BY host_id ORDER BY ingest_seq) AS pos FROM flagged) AS p
JOIN windows w ON w.host_id = p.host_id AND w.pos = p.pos
"""
_LEVEL = """
SELECT '{key}@' || e.host_id AS alert_key, '{type}' AS alert_type, e.host_id, e.ingest_seq,
  {sub} AS sub_seq, e.now AS at,
  CASE WHEN r.enabled AND {value} >= r.threshold THEN 'BREACH' ELSE 'CLEAR' END AS kind,
  {value} AS value, r.threshold
FROM evals e JOIN effective r ON r.host_id = e.host_id AND r.rule_type = '{type}'
WHERE {value} IS NOT NULL
"""
CTES["cpu_signals"] = _LEVEL.format(key="cpu-high", type="HIGH_CPU", sub=1, value="e.avg_cpu")
CTES["ram_signals"] = _LEVEL.format(key="ram-high", type="HIGH_RAM", sub=2, value="e.avg_ram")
CTES["disk_level_signals"] = _LEVEL.format(
    key="disk-high", type="HIGH_DISK", sub=3, value="e.disk_usage"
)
CTES["repeat_counts"] = """
SELECT e.host_id, e.ingest_seq, e.now, w.message, count(*) AS times
FROM evals e JOIN windows w ON w.host_id = e.host_id AND w.pos BETWEEN e.pos - 4 AND e.pos
WHERE w.level IN ('ERROR', 'CRITICAL') GROUP BY e.host_id, e.ingest_seq, e.now, w.message
"""
CTES["repeat_signals"] = """
SELECT 'repeated-error-' || sha256(c.message) || '@' || c.host_id AS alert_key,
  'REPEATED_ERROR' AS alert_type, c.host_id, c.ingest_seq,
  CAST(3 + row_number() OVER (PARTITION BY c.host_id, c.ingest_seq ORDER BY c.message) AS INTEGER)
    AS sub_seq, c.now AS at, 'BREACH' AS kind, CAST(c.times AS DOUBLE) AS value, r.threshold
FROM repeat_counts c
JOIN effective r ON r.host_id = c.host_id AND r.rule_type = 'REPEATED_ERROR'
QUALIFY r.enabled AND c.times >= r.threshold
"""
CTES["recovery_signals"] = """
SELECT 'agent-silent@' || host_id AS alert_key, 'AGENT_SILENT' AS alert_type, host_id, ingest_seq,
  0 AS sub_seq, now AS at, 'CLEAR' AS kind, CAST(NULL AS DOUBLE) AS value,
  CAST(NULL AS DOUBLE) AS threshold FROM evals
"""
CTES["action_signals"] = """
SELECT alert_key, CAST(NULL AS VARCHAR) AS alert_type, CAST(NULL AS VARCHAR) AS host_id, ingest_seq,
  0 AS sub_seq, at, kind, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold
FROM actions
"""
CTES["rollup"] = """
SELECT t.host_id, max(t.hostname) AS hostname, count(*) AS event_count,
  min(t.event_timestamp) AS first_seen, max(t.event_timestamp) AS last_seen
FROM telemetry t GROUP BY t.host_id
"""
CTES["newest_rows"] = """
SELECT host_id, agent_version, queue_depth, disk_usage, disk_path FROM (
  SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY event_timestamp DESC, ingest_seq DESC)
    AS rn FROM telemetry) AS ranked WHERE rn = 1
"""
CTES["hosts_all"] = """
SELECT r.host_id, r.hostname, r.event_count, r.first_seen, r.last_seen, n.agent_version,
  n.queue_depth, n.disk_usage, n.disk_path
FROM rollup r JOIN newest_rows n ON n.host_id = r.host_id
"""
CTES["silence"] = f"""
SELECT 'agent-silent@' || h.host_id AS alert_key, 'AGENT_SILENT' AS alert_type, h.host_id,
  (SELECT max(ingest_seq) FROM flagged) AS ingest_seq, 1000000 AS sub_seq, {NOW} AS at,
  CASE WHEN NOT r.enabled THEN 'CLEAR' ELSE 'BREACH' END AS kind,
  CASE WHEN r.enabled THEN CAST(epoch_us({NOW}) - epoch_us(h.last_seen) AS BIGINT) // 60000000 END
    AS value, r.threshold
FROM hosts_all h
JOIN effective r ON r.host_id = h.host_id AND r.rule_type = 'AGENT_SILENT'
WHERE NOT r.enabled OR (epoch_us({NOW}) - epoch_us(h.last_seen) <= 168 * 3600000000
  AND (epoch_us({NOW}) - epoch_us(h.last_seen)) // 60000000 >= CAST(r.threshold AS BIGINT))
"""
CTES["silence_signals_sql"] = """
SELECT alert_key, alert_type, host_id, ingest_seq, sub_seq, at, kind, CAST(value AS DOUBLE) AS value,
  threshold FROM silence
"""
_SIGNAL_PARTS = (
    "cpu_signals",
    "ram_signals",
    "disk_level_signals",
    "repeat_signals",
    "recovery_signals",
    "action_signals",
    "silence_signals_sql",
)
CTES["all_signals"] = "\nUNION ALL BY NAME\n".join(f"SELECT * FROM {p}" for p in _SIGNAL_PARTS)
# The lifecycle by islands: the kind before (ACKs aside) tells whether the alert is active.
CTES["fold_1"] = """
SELECT *, last_value(CASE WHEN kind <> 'ACK' THEN kind END IGNORE NULLS) OVER earlier = 'BREACH'
    AS was_breach,
  count(CASE WHEN kind = 'BREACH' THEN 1 END) OVER so_far AS breaches
FROM all_signals
WINDOW earlier AS (PARTITION BY alert_key ORDER BY ingest_seq, sub_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  so_far AS (PARTITION BY alert_key ORDER BY ingest_seq, sub_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
CTES["fold_2"] = """
SELECT *, coalesce(was_breach, false) AS active,
  count(CASE WHEN kind = 'BREACH' AND NOT coalesce(was_breach, false) THEN 1 END) OVER (
    PARTITION BY alert_key ORDER BY ingest_seq, sub_seq) AS open_no
FROM fold_1
"""
CTES["fold_3"] = """
SELECT *, coalesce(bool_or(kind = 'ACK' AND active) OVER (PARTITION BY alert_key, open_no
    ORDER BY ingest_seq, sub_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS acked,
  first_value(CASE WHEN kind = 'BREACH' THEN at END IGNORE NULLS) OVER life AS first_at,
  first_value(CASE WHEN kind = 'BREACH' THEN alert_type END IGNORE NULLS) OVER life AS first_type,
  first_value(CASE WHEN kind = 'BREACH' THEN host_id END IGNORE NULLS) OVER life AS first_host,
  last_value(CASE WHEN kind = 'BREACH' THEN at END IGNORE NULLS) OVER life AS breach_at
FROM fold_2
WINDOW life AS (PARTITION BY alert_key ORDER BY ingest_seq, sub_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
CTES["transitions"] = """
SELECT alert_key, first_type AS alert_type, first_host AS host_id, ingest_seq, sub_seq, at,
  CASE WHEN kind = 'BREACH' AND active THEN 'OCCURRENCE'
       WHEN kind = 'BREACH' AND breaches > 1 THEN 'REOPENED'
       WHEN kind = 'BREACH' THEN 'OPENED'
       WHEN kind IN ('CLEAR', 'RESOLVE') THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS transition,
  CASE WHEN kind IN ('CLEAR', 'RESOLVE') THEN 'RESOLVED'
       WHEN kind = 'ACK' OR (active AND acked) THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status,
  first_at AS first_seen, CASE WHEN kind = 'ACK' THEN breach_at ELSE at END AS last_seen,
  breaches AS occurrence_count
FROM fold_3
WHERE kind = 'BREACH' OR (kind IN ('CLEAR', 'RESOLVE') AND active)
  OR (kind = 'ACK' AND active AND NOT acked)
"""
CTES["alerts"] = """
SELECT alert_key, alert_type, host_id, status, first_seen, last_seen, occurrence_count FROM (
  SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY ingest_seq DESC, sub_seq DESC) AS rn
  FROM transitions) AS ranked WHERE rn = 1
"""

# The rules as of each event: a change counts for what arrives after it.
CTES["rule_changes"] = """
SELECT rule_type, coalesce(host_id, '*') AS scope, version * 10 + 1 AS changed,
  CASE WHEN NOT deleted THEN threshold END AS threshold, coalesce(enabled, true) AS enabled
FROM rule_reasons WHERE scope_reason IS NULL AND (deleted OR threshold_reason IS NULL)
"""
CTES["effective_asof"] = """
SELECT e.host_id, e.ingest_seq, e.rule_type,
  CASE WHEN o.threshold IS NOT NULL THEN o.threshold WHEN f.threshold IS NOT NULL THEN f.threshold
       ELSE e.threshold END AS threshold,
  CASE WHEN o.threshold IS NOT NULL THEN o.enabled WHEN f.threshold IS NOT NULL THEN f.enabled
       ELSE true END AS enabled,
  CASE WHEN o.threshold IS NOT NULL THEN 'host' WHEN f.threshold IS NOT NULL THEN 'fleet'
       ELSE 'default' END AS source
FROM (SELECT v.host_id, v.ingest_seq, d.rule_type, d.threshold FROM evals v CROSS JOIN rule_defaults d) AS e
ASOF LEFT JOIN rule_changes o
  ON o.rule_type = e.rule_type AND o.scope = e.host_id AND e.ingest_seq > o.changed
ASOF LEFT JOIN (SELECT * FROM rule_changes WHERE scope = '*') AS f
  ON f.rule_type = e.rule_type AND e.ingest_seq > f.changed
"""


def _as_of(name: str, *replaced: str) -> None:
    """The expression ``name`` again, over the as-of variants of those it reads."""
    text = CTES[name].replace("effective r ON r.host_id = ", "effective_asof r ON r.ingest_seq = ")
    text = re.sub(r"(r\.ingest_seq = [ce])\.host_id", r"\1.ingest_seq", text)
    for other in replaced:
        text = re.sub(rf"\b{other}\b", f"{other}_asof", text)
    CTES[f"{name}_asof"] = text


_JUDGED = ("cpu_signals", "ram_signals", "disk_level_signals", "repeat_signals")
for _name in _JUDGED:
    _as_of(_name)
CTES["delivery_signals_asof"] = "\nUNION ALL BY NAME\n".join(
    f"SELECT * FROM {p}" for p in (*(f"{n}_asof" for n in _JUDGED), "recovery_signals")
)
CTES["all_signals_asof"] = "SELECT * FROM delivery_signals_asof"
for _name, _reads in (("fold_1", "all_signals"), ("fold_2", "fold_1"), ("fold_3", "fold_2"), ("transitions", "fold_3")):
    _as_of(_name, _reads)

_WORD = re.compile(r"[a-z_0-9]+")
_KEYWORD = re.compile(r"\bat\b(?! most)")


def check(select: str, *, extra: str = "") -> str:
    """``select`` with every common table expression it (indirectly) mentions in front.

    ``extra`` is the text of further, possibly recursive, expressions.  ``at`` is a keyword there.
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in CTES and word not in needed and word not in pending:
                pending.add(word)
                visit(CTES[word])
                needed.append(word)

    pending: set[str] = set()
    visit(select + " " + extra)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in needed]
    if extra:
        parts.append(extra.strip())
    start = "WITH RECURSIVE " if extra else "WITH "
    return _KEYWORD.sub('"at"', start + ",\n".join(parts) + "\n" + select.strip())
