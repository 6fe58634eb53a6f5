"""Stateful streams: session memory, and incremental refresh of derived tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MEMORY_BYTES, MEMORY_CALLS, IDLE_SECONDS = 120_000, 10, 600


def remembered(answers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Which answers of a session were sent before: session, ts, item, size, repeat.

    answers: session, ts (TIMESTAMP), item, size, a stream or a table with one call a row. An item is a repeat
    while at most 120,000 bytes and less than ten calls lie between; more than 600 idle seconds forget all.
    Idle time is event time; state is one map a session, dropped when the watermark passes its idle time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        total, calls, last, items, at_bytes, at_calls = state.get if state.exists else (0, 0, 0, [], [], [])
        seen = dict(zip(items, zip(at_bytes, at_calls)))
        repeat = []
        for r in rows.itertuples(index=False):
            now = int(r.ts.timestamp() * 1_000_000)
            if last and now - last > IDLE_SECONDS * 1_000_000:
                total, calls, seen = 0, 0, {}
            calls, last = calls + 1, now
            before = seen.get(r.item)
            known = before is not None and total - before[0] <= MEMORY_BYTES and calls - before[1] < MEMORY_CALLS
            repeat.append(known)
            if not known:
                total += int(r.size)
                seen[r.item] = (total, calls)
        seen = {k: v for k, v in seen.items() if total - v[0] <= MEMORY_BYTES and calls - v[1] < MEMORY_CALLS}
        state.update((total, calls, last, list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + IDLE_SECONDS * 1000 + 1)
        yield rows.assign(session=key[0], repeat=repeat)[["session", "ts", "item", "size", "repeat"]]

    return answers.select("session", "ts", "item", "size").withWatermark("ts", late).groupBy("session").applyInPandasWithState(
        step, "session string, ts timestamp, item string, size long, repeat boolean",
        "total long, calls long, last long, items array<string>, at_bytes array<long>, at_calls array<long>", "append", GroupStateTimeout.EventTimeTimeout,
    )


def refresh_into(folder: str, derive: Callable[[DataFrame], DataFrame], order: str = "modified") -> Callable[[DataFrame, int], None]:
    """For foreachBatch on a stream of file versions (path, text, digest and `order`, a time or a sequence number):
    derives the last version of each path, by `order`, and writes it as the batch's part, with a line for each path
    that came, so that `latest` sees the last version of a path, even one that derives no rows. A null text is a
    deleted file. A batch that runs again writes the same part again."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("text", "digest"), F.struct(F.col(order), F.col("digest"))).alias("v")).select("path", "v.*")
        last.select("path", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/versions/part-{number:08d}")
        derive(last.where("text IS NOT NULL")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/part-{number:08d}")

    return write


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Of what `refresh_into` wrote the rows of each path's last version."""
    top = spark.read.parquet(f"{folder}/versions/*").groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/rows/*").join(top, ["path", "batch"], "left_semi")


def token_windows(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tokens asked for in each second of a stream with `received_at`, late rows up to the watermark."""
    c = calls.withColumn("ts", F.col("received_at").cast("timestamp")).withWatermark("ts", late)
    return c.groupBy(F.window("ts", "1 second").alias("w")).agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("tokens")).select(F.col("w.start").alias("second"), "tokens")
