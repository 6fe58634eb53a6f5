"""Queries on trailing totals (problem 1)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ferrule.operators.rolling import calls_once, disagreeing_reports, trailing_totals
from ferrule.sources.tables import table

LAST_DAY = (date(2026, 8, 31) - date(1970, 1, 1)).days


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    calls = calls_once(table(spark, folder, "call_log"))
    return trailing_totals(calls, "workspace", "day", {"input_tokens": "input_tokens"}, (7, 30), LAST_DAY, {"avg_ms": "ms"})


def p1_trailing_totals(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    return _totals(spark, folder).select("workspace", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), "period_days", "calls", "input_tokens", F.round("avg_ms", 6).alias("avg_ms"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return disagreeing_reports(table(spark, folder, "usage_reports"), _totals(spark, folder))


_ONCE = r"""
WITH lines AS (
  SELECT entry_id, received_at, regexp_replace(workspace, '/+$', '') AS workspace, ms, input_tokens,
         CASE WHEN regexp_matches(trim("at"), '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$')
              THEN CAST(timezone('UTC', TRY_CAST(replace(replace(upper(trim("at")), 'T', ' '), 'Z', '+00:00') AS TIMESTAMPTZ)) AS DATE) END AS day
  FROM call_log),
once AS (
  SELECT workspace, day, ms, input_tokens
  FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY received_at) AS rn FROM lines)
  WHERE rn = 1 AND day <= DATE '2026-08-31'),
daily AS (
  SELECT workspace, day, count(*) AS n, sum(coalesce(input_tokens, 0)) AS tok, sum(ms) AS ms, count(ms) AS nms
  FROM once GROUP BY 1, 2),
grid AS (
  SELECT workspace, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), TIMESTAMP '2026-08-31', INTERVAL 1 DAY)) AS DATE) AS day
  FROM daily GROUP BY 1),
periods AS (SELECT unnest([7, 30]) AS period_days),
totals AS (
  SELECT g.workspace, g.day, p.period_days, coalesce(sum(d.n), 0) AS calls, coalesce(sum(d.tok), 0) AS input_tokens,
         CASE WHEN sum(d.nms) > 0 THEN sum(d.ms) / sum(d.nms) END AS avg_ms
  FROM grid g CROSS JOIN periods p
  LEFT JOIN daily d ON d.workspace IS NOT DISTINCT FROM g.workspace AND d.day <= g.day AND d.day > g.day - p.period_days
  GROUP BY 1, 2, 3)
"""

QUERIES = {"p1_found": p1_found, "p1_trailing_totals": p1_trailing_totals}
ORACLE = {
    "p1_found": _ONCE + """
SELECT DISTINCT r.workspace, strftime(r.day, '%Y-%m-%d') AS day, r.period_days
FROM usage_reports r LEFT JOIN totals t
  ON t.workspace = regexp_replace(r.workspace, '/+$', '') AND t.day = r.day AND t.period_days = r.period_days
WHERE coalesce(r.calls, -1) <> coalesce(t.calls, 0) OR coalesce(r.input_tokens, -1) <> coalesce(t.input_tokens, 0)
   OR (r.avg_ms IS NULL) <> (t.avg_ms IS NULL) OR coalesce(abs(r.avg_ms - t.avg_ms) > 0.01 * abs(t.avg_ms), false)
""",
    "p1_trailing_totals": _ONCE + """
SELECT workspace, day, period_days, CAST(calls AS BIGINT) AS calls, CAST(input_tokens AS BIGINT) AS input_tokens, round(avg_ms, 6) AS avg_ms
FROM totals
""",
}
