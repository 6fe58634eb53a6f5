"""Totals and averages over trailing periods, days without activity included.

The plan has three steps. Rows are added up by entity and day inside Spark (partial aggregation, so an
entity that holds a third of all rows costs one row a day and task). The daily rows are cut into tiles of
days; a row also goes to the later tiles whose windows still reach it (their halo). Within a task the
(tile, entity) runs are packed into dense numpy blocks, at most `block` runs at a time, and each period is
one product with a banded 0/1 matrix. No task holds more than one block, whatever the number of entities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: RFC 3339: date, time and an offset; fractions allowed.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def utc_day(at: str | Column) -> Column:
    """Days since 1970-01-01 (INT) of the UTC day of an RFC 3339 text; null where it is no valid time."""
    at = F.col(at) if isinstance(at, str) else at
    stamp = F.try_to_timestamp(F.upper(F.trim(at)))
    return F.when(F.trim(at).rlike(RFC3339), F.floor(F.unix_micros(stamp) / F.lit(86_400_000_000)).cast("int"))


def band(days: int, halo: int, period: int) -> np.ndarray:
    """Operator [halo + days, days]: column j sums the `period` days that end with day j of the tile."""
    row, col = np.arange(halo + days)[:, None], np.arange(days)[None, :] + halo
    return ((row <= col) & (row > col - period)).astype(np.float64)


def _exact_product(block: np.ndarray, operator: np.ndarray) -> np.ndarray:
    """Integer product: in float64 (BLAS) where every partial sum is exact there, in int64 beyond."""
    if np.abs(block).sum(axis=1, dtype=np.float64).max(initial=0.0) < 2.0**52:
        return np.rint(block.astype(np.float64) @ operator).astype(np.int64)
    return block @ operator.astype(np.int64)


def trailing_totals(
    rows: DataFrame,
    entity: str,
    day: str,
    sums: dict[str, str],
    periods: tuple[int, ...] = (7, 30),
    last_day: int | None = None,
    averages: dict[str, str] | None = None,
    tile_days: int = 64,
    block: int = 512,
) -> DataFrame:
    """One row per (entity, day, period) from the entity's first day to `last_day`.

    rows      any table; other columns are ignored, so clashing names do no harm.
    day       INT days since 1970-01-01; rows whose day is null, or after `last_day`, count nowhere.
    sums      {output: LONG column}; null counts 0. Every output also exists for idle days (0).
    averages  {output: LONG column}; the mean over the period's non-null values, null if there are none.
    last_day  default: the last day of the data.
    Returns entity, day INT, period_days INT, calls LONG (number of rows), the sums (LONG), the averages
    (DOUBLE). A null entity is an entity of its own. Repeated rows count as often as they occur. An empty
    table gives an empty result. Sums beyond 2**52 are kept exact in 64-bit integers.
    """
    averages = averages or {}
    names = ["__n", *[f"__s{i}" for i in range(len(sums))]]
    aggs = [F.count(F.lit(1)).alias("__n"), *[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(f"__s{i}") for i, c in enumerate(sums.values())]]
    for i, c in enumerate(averages.values()):
        names += [f"__a{i}", f"__c{i}"]
        aggs += [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"__a{i}"), F.count(F.col(c)).alias(f"__c{i}")]
    clean = rows.where(F.col(day).isNotNull())
    if last_day is None:
        last_day = clean.agg(F.max(day)).first()[0]
        last_day = 0 if last_day is None else int(last_day)
    daily = clean.where(F.col(day) <= F.lit(last_day)).groupBy(F.col(entity).alias("__e"), F.col(day).alias("__d")).agg(*aggs)
    halo = max(periods) - 1
    tile = lambda c: F.floor(c / F.lit(tile_days)).cast("int")
    last_tile = last_day // tile_days
    # Tiles that see a day: its own and the following ones whose halo holds it.
    seen = daily.withColumn("__t", F.explode(F.sequence(tile(F.col("__d")), F.least(tile(F.col("__d") + F.lit(halo)), F.lit(last_tile)))))
    # Every tile from the entity's first day on exists, with or without activity.
    first = daily.groupBy("__e").agg(F.min("__d").alias("__d"))
    zero = [F.lit(0).cast("long").alias(n) for n in names]
    frame = first.select("__e", F.col("__d"), *zero, F.explode(F.sequence(tile(F.col("__d")), F.lit(last_tile))).alias("__t"), F.lit(True).alias("__first"))
    packed = seen.withColumn("__first", F.lit(False)).select("__e", "__d", *names, "__t", "__first").unionByName(frame)
    packed = packed.repartition("__t", "__e").sortWithinPartitions("__t", "__e", "__d")

    out_fields = [T.StructField("__e", rows.schema[entity].dataType), T.StructField("day", T.IntegerType()), T.StructField("period_days", T.IntegerType()), T.StructField("calls", T.LongType())]
    out_fields += [T.StructField(n, T.LongType()) for n in sums] + [T.StructField(n, T.DoubleType()) for n in averages]
    bands = {p: band(tile_days, halo, p) for p in periods}
    n_sums, n_avgs, sum_names, avg_names = len(sums), len(averages), list(sums), list(averages)

    def solve(ents: np.ndarray, tiles: np.ndarray, run: np.ndarray, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """One block: runs (tile, entity) x days."""
        count = len(ents)
        start = tiles * tile_days - halo
        days = part["__d"].to_numpy(np.int64)
        is_first = part["__first"].to_numpy(bool)
        first_day = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(first_day, run[is_first], days[is_first])
        at = days - start[run]
        use = ~is_first & (at >= 0) & (at < tile_days + halo)
        dense = {}
        for n in names:
            cell = np.zeros((count, tile_days + halo), np.int64)
            np.add.at(cell, (run[use], at[use]), part[n].to_numpy(np.int64)[use])
            dense[n] = cell
        day_of = tiles[:, None] * tile_days + np.arange(tile_days)[None, :]
        keep = (day_of >= first_day[:, None]) & (day_of <= last_day)
        who = np.repeat(np.arange(count), tile_days).reshape(count, tile_days)[keep]
        for p, operator in bands.items():
            got = {n: _exact_product(dense[n], operator)[keep] for n in names}
            out = {"__e": ents[who], "day": day_of[keep].astype(np.int32), "period_days": np.full(len(who), p, np.int32), "calls": got["__n"]}
            out |= {sum_names[i]: got[f"__s{i}"] for i in range(n_sums)}
            for i in range(n_avgs):
                total, c = got[f"__a{i}"].astype(np.float64), got[f"__c{i}"]
                out[avg_names[i]] = pd.Series(np.where(c > 0, total / np.maximum(c, 1), np.nan)).astype(object).where(c > 0, None)
            yield pd.DataFrame(out)

    def tiles_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest):
                ent, t = rest["__e"], rest["__t"].to_numpy()
                prev = ent.shift()
                same = (ent == prev) | (ent.isna() & prev.isna())
                new = ~same.to_numpy(bool) | np.r_[True, t[1:] != t[:-1]]
                new[0] = True
                starts = np.flatnonzero(new)
                if len(starts) <= block:  # the last run may go on in the next batch
                    break
                cut = starts[block]
                part, run = rest.iloc[:cut], np.cumsum(new[:cut]) - 1
                yield from solve(ent.to_numpy(object)[starts[:block]], t[starts[:block]].astype(np.int64), run, part)
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            ent, t = rest["__e"], rest["__t"].to_numpy()
            prev = ent.shift()
            new = ~((ent == prev) | (ent.isna() & prev.isna())).to_numpy(bool) | np.r_[True, t[1:] != t[:-1]]
            new[0] = True
            starts = np.flatnonzero(new)
            yield from solve(ent.to_numpy(object)[starts], t[starts].astype(np.int64), np.cumsum(new) - 1, rest)

    # The tile-first order of the sort keeps a block's runs on the same days.
    return packed.mapInPandas(tiles_of, T.StructType(out_fields)).withColumnRenamed("__e", entity)


def calls_once(calls: DataFrame) -> DataFrame:
    """call_log lines counted once: entry_id LONG, workspace, day INT, ms, input_tokens.

    A repeated entry_id keeps its earliest received line; lines without an entry_id count each. Lines whose
    `at` is no valid time stay with a null day. A trailing slash of workspace is dropped.
    """
    line = F.struct(F.col("received_at"), utc_day("at").alias("day"), F.regexp_replace("workspace", "/+$", "").alias("workspace"), F.col("ms").cast("long").alias("ms"), F.col("input_tokens").cast("long").alias("input_tokens"))
    slim = calls.select("entry_id", line.alias("line"))
    # The random key of rows without an id spreads them; only real ids are gathered.
    once = slim.where(F.col("entry_id").isNotNull()).groupBy("entry_id").agg(F.min("line").alias("line"))
    return once.unionByName(slim.where(F.col("entry_id").isNull())).select("entry_id", "line.workspace", "line.day", "line.ms", "line.input_tokens")


def disagreeing_reports(reports: DataFrame, totals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows of usage_reports that the totals do not confirm: workspace, day (YYYY-MM-DD), period_days.

    A report on a workspace or day without totals is compared with zero calls. Nulls in a report's numbers
    disagree unless both averages are null. Repeated disagreeing rows are given once.
    """
    # Only the reported (day, period) cells of reported workspaces are wanted; the reports are the small side.
    t = totals.select(F.col("workspace").alias("tw"), F.col("day").alias("td"), F.col("period_days").alias("tp"), F.col("calls").alias("tc"), F.col("input_tokens").alias("ti"), F.col("avg_ms").alias("ta"))
    r = reports.select("workspace", "day", "period_days", "calls", "input_tokens", "avg_ms").withColumn("d", F.datediff(F.col("day"), F.lit("1970-01-01").cast("date")))
    j = r.join(t, (F.regexp_replace(r["workspace"], "/+$", "") == t["tw"]) & (r["d"] == t["td"]) & (r["period_days"] == t["tp"]), "left")
    off = (F.coalesce("calls", F.lit(-1)) != F.coalesce("tc", F.lit(0))) | (F.coalesce("input_tokens", F.lit(-1)) != F.coalesce("ti", F.lit(0)))
    off = off | (F.col("avg_ms").isNull() != F.col("ta").isNull()) | F.coalesce(F.abs(F.col("avg_ms") - F.col("ta")) > F.lit(tolerance) * F.abs("ta"), F.lit(False))
    return j.where(off).select("workspace", F.date_format("day", "yyyy-MM-dd").alias("day"), "period_days").distinct()
