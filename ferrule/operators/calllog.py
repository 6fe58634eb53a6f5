"""Call-log and telemetry analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.rolling import utc_day

USD_PER_MILLION = 0.042


def rollup(calls: DataFrame) -> DataFrame:
    """Totals in all, by day, by phase and by workspace in one pass: scope, key, calls, failed, input_tokens,
    output_tokens, usd. Lines without a valid time have the day null; a null workspace is (unknown)."""
    c = calls.select(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), utc_day("at")), "yyyy-MM-dd").alias("day"), "phase", F.coalesce("workspace", F.lit("(unknown)")).alias("workspace"), "ok", "input_tokens", "output_tokens")
    g = c.groupingSets([[], ["day"], ["phase"], ["workspace"]], "day", "phase", "workspace").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )
    scope = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "day").when(F.col("gid") == 5, "phase").otherwise("workspace")
    key = F.when(F.col("gid") == 3, F.col("day")).when(F.col("gid") == 5, F.col("phase")).when(F.col("gid") == 6, F.col("workspace"))
    return g.select(scope.alias("scope"), key.alias("key"), "calls", "failed", "input_tokens", "output_tokens", F.round(F.col("input_tokens") * USD_PER_MILLION / 1e6, 9).alias("usd"))


def token_seconds(calls: DataFrame) -> DataFrame:
    """second, tokens: input tokens asked for in each second of `received_at` (tumbling windows)."""
    return calls.where("received_at IS NOT NULL").groupBy(F.date_trunc("second", "received_at").alias("second")).agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("tokens"))


def idle_sessions(events: DataFrame, key: str, ts: str, idle_seconds: int = 600) -> DataFrame:
    """key, session INT from 1, started, ended, events: a session ends after strictly more than the idle time."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = events.where(F.col(ts).isNotNull()).select(key, ts, F.when(gap.isNull() | (gap > idle_seconds * 1_000_000), 1).otherwise(0).alias("new"))
    s = new.withColumn("session", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    return s.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events"))


def reminders(events: DataFrame, key: str, order: str, kind: str, search: str, own: str) -> DataFrame:
    """The searches at which a reminder fires: the 1st, 5th, 9th ... since the last use of the own tool."""
    w = Window.partitionBy(key).orderBy(order)
    e = events.withColumn("__reset", F.sum(F.when(F.col(kind) == own, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(key, "__reset").orderBy(order))
    return e.where(F.col(kind) == search).withColumn("n", n).where(F.col("n") % 4 == 1).drop("__reset")


def repeats(events: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows whose text equals the one before of the same key."""
    return events.withColumn("__p", F.lag(text).over(Window.partitionBy(key).orderBy(order))).where(F.col("__p") == F.col(text)).drop("__p")


def overlapping_calls(calls: DataFrame, group: str = "workspace", within: int = 0, bucket_seconds: int = 60) -> DataFrame:
    """entry_id, others: calls of one workspace (or other group) that ran at the same time, by start and duration, or
    `within` so many seconds.

    A call is entered under every minute it touches, so only neighbours in time meet."""
    end = F.unix_micros(F.col("received_at").cast("timestamp"))
    c = calls.where("received_at IS NOT NULL AND ms IS NOT NULL").where(F.col(group).isNotNull()).select("entry_id", F.col(group).alias("g"), (end - F.col("ms") * 1000).alias("s"), end.alias("e")).groupBy("entry_id", "g").agg(F.min("s").alias("s"), (F.min("e") + within * 1_000_000).alias("e"))
    width = bucket_seconds * 1_000_000
    b = c.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    o = b.select("g", "b", F.col("entry_id").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"))
    hit = b.join(o, ["g", "b"]).where((F.col("entry_id") != F.col("other")) & (F.col("s") < F.col("oe")) & (F.col("os") < F.col("e")))
    return hit.groupBy("entry_id").agg(F.count_distinct("other").alias("others"))


def telemetry(records: DataFrame) -> DataFrame:
    """By client, condition and task: attempted, succeeded, failed, observed, median, p95 (nearest rank), and
    the sum of tool calls where every record has one, else null."""
    r = records.select("runId", "recordId", "receivedAt", F.lower(F.trim("client.name")).alias("client"), F.col("condition.requested").alias("requested"), "taskKind", "status", F.col("timing.totalWallNs").alias("wall"), F.col("calls.agentToolCalls").cast("long").alias("tools"))
    once = r.groupBy("runId", "recordId").agg(F.min(F.struct("receivedAt", "client", "requested", "taskKind", "status", "wall", "tools")).alias("x")).select("x.*")
    ok = F.col("status") == "succeeded"
    wall = F.when(ok, F.col("wall"))
    return once.groupBy("client", "requested", "taskKind").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count(wall).alias("observed"),
        F.percentile(wall, 0.5).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN status = 'succeeded' THEN wall END)").cast("long").alias("p95"),
        F.when(F.count("tools") == F.count(F.lit(1)), F.sum("tools")).alias("tool_calls"),
    )
