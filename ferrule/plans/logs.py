"""Queries on the call log, telemetry and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions.text import short_count
from ferrule.operators import calllog
from ferrule.sources.tables import table


def call_log_rollup(spark, folder):
    return calllog.rollup(table(spark, folder, "call_log"))


def token_seconds(spark, folder):
    return calllog.token_seconds(table(spark, folder, "call_log"))


def telemetry_groups(spark, folder):
    return calllog.telemetry(table(spark, folder, "records"))


def idle_sessions(spark, folder):
    """Sessions of each workspace's calls, cut by ten idle minutes."""
    return calllog.idle_sessions(table(spark, folder, "call_log"), "workspace", "received_at")


def user_sessions(spark, folder):
    return calllog.idle_sessions(table(spark, folder, "events"), "user_id", "ts", 86_400)


def reminders(spark, folder):
    """Searches of users that bring a reminder; a purchase resets the count."""
    e = table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return calllog.reminders(e, "user_id", "o", "event_type", "view", "purchase").select("user_id", "event_id", "n")


def repeated_actions(spark, folder):
    e = table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return calllog.repeats(e, "user_id", "o", "event_type").select("user_id", "event_id", "event_type")


def overlapping_calls(spark, folder):
    return calllog.overlapping_calls(table(spark, folder, "call_log"))


def phase_latency(spark, folder):
    """Calls, failures, median and nearest-rank p95 of ms by phase, and tokens for people."""
    c = table(spark, folder, "call_log")
    g = c.groupBy("phase").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.percentile("ms", 0.5).alias("median_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").cast("long").alias("p95_ms"), F.sum("input_tokens").alias("tokens"))
    return g.withColumn("tokens_short", short_count("tokens"))


QUERIES = {f.__name__: f for f in (call_log_rollup, token_seconds, telemetry_groups, idle_sessions, user_sessions, reminders, repeated_actions, overlapping_calls, phase_latency)}

_SESSIONS = """WITH e AS (SELECT {0}, {1}, CASE WHEN lag({1}) OVER w IS NULL OR epoch_us({1}) - epoch_us(lag({1}) OVER w) > CAST({2} AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS new FROM {3} WHERE {1} IS NOT NULL WINDOW w AS (PARTITION BY {0} ORDER BY {1})),
 s AS (SELECT *, sum(new) OVER (PARTITION BY {0} ORDER BY {1} RANGE UNBOUNDED PRECEDING) AS session FROM e)
 SELECT {0}, CAST(session AS INTEGER) AS session, min({1}) AS started, max({1}) AS ended, count(*) AS events FROM s GROUP BY {0}, session"""
_DAY = r"""CASE WHEN regexp_matches(trim("at"), '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$') THEN strftime(CAST(timezone('UTC', TRY_CAST(replace(replace(upper(trim("at")), 'T', ' '), 'Z', '+00:00') AS TIMESTAMPTZ)) AS DATE), '%Y-%m-%d') END"""
ORACLE = {
    "call_log_rollup": f"""WITH c AS (SELECT {_DAY} AS day, phase, coalesce(workspace, '(unknown)') AS workspace, ok, input_tokens, output_tokens FROM call_log),
      u AS (SELECT 'total' AS scope, NULL::VARCHAR AS key, ok, input_tokens, output_tokens FROM c UNION ALL SELECT 'day', day, ok, input_tokens, output_tokens FROM c
        UNION ALL SELECT 'phase', phase, ok, input_tokens, output_tokens FROM c UNION ALL SELECT 'workspace', workspace, ok, input_tokens, output_tokens FROM c)
      SELECT scope, key, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
        round(sum(coalesce(input_tokens, 0)) * 0.042 / 1e6, 9) AS usd FROM u GROUP BY scope, key""",
    "token_seconds": "SELECT date_trunc('second', received_at) AS second, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS tokens FROM call_log WHERE received_at IS NOT NULL GROUP BY 1",
    "telemetry_groups": """WITH o AS (SELECT lower(trim(client.name)) AS client, condition.requested AS requested, taskKind, status, timing.totalWallNs AS wall, calls.agentToolCalls AS tools FROM records QUALIFY row_number() OVER (PARTITION BY runId, recordId ORDER BY receivedAt) = 1)
      SELECT client, requested, taskKind, count(*) AS attempted, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status <> 'succeeded') AS failed, count(wall) FILTER (status = 'succeeded') AS observed,
        quantile_cont(CAST(wall AS DOUBLE), 0.5) FILTER (status = 'succeeded') AS median, quantile_disc(wall, 0.95) FILTER (status = 'succeeded') AS p95, CASE WHEN count(tools) = count(*) THEN CAST(sum(tools) AS BIGINT) END AS tool_calls FROM o GROUP BY ALL""",
    "idle_sessions": _SESSIONS.format("workspace", "received_at", 600, "call_log"),
    "user_sessions": _SESSIONS.format("user_id", "ts", 86_400, "events"),
    "reminders": """WITH e AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events),
      f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, r ORDER BY ts, event_id) AS n FROM e WHERE event_type = 'view') SELECT * FROM f WHERE n % 4 = 1""",
    "repeated_actions": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p = event_type",
    "overlapping_calls": """WITH c AS (SELECT entry_id, workspace, min(epoch_us(received_at) - ms * 1000) AS s, min(epoch_us(received_at)) AS e FROM call_log WHERE received_at IS NOT NULL AND ms IS NOT NULL AND workspace IS NOT NULL GROUP BY ALL)
      SELECT a.entry_id, count(DISTINCT b.entry_id) AS others FROM c a JOIN c b ON a.workspace = b.workspace AND a.entry_id <> b.entry_id AND a.s < b.e AND b.s < a.e GROUP BY 1""",
    "phase_latency": """SELECT phase, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, quantile_cont(CAST(ms AS DOUBLE), 0.5) AS median_ms, quantile_disc(ms, 0.95) AS p95_ms, CAST(sum(input_tokens) AS BIGINT) AS tokens,
      CASE WHEN sum(input_tokens) >= 1e6 THEN printf('%.1f', sum(input_tokens) / 1e6) || 'M' WHEN sum(input_tokens) >= 1e3 THEN printf('%.0f', sum(input_tokens) / 1e3) || 'k' ELSE printf('%.0f', sum(input_tokens)) END AS tokens_short FROM call_log GROUP BY phase""",
}
