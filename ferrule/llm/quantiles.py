"""Percentiles of very large columns by relative-rank compactors that merge.

A sketch is a tower of buffers. A full buffer sorts itself, keeps its upper part and passes every other
value of the lower part on with double weight; how far the compaction reaches follows the buffer's own
counter, so the top values are hardly ever touched. The rank error at percentile q is thus in proportion to
1 - q: the tail that latencies are judged by is the part kept best. As published for these compactors, with
sections of `k` values the standard error of a rank is at most about 0.13 / k of (1 - q) n; with k = 32,
0.4 % of the values above. Up to 6 k values a group are kept as they are, and the answer is exact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = 3  # of a buffer at first


class TailSketch:
    """Relative-error sketch of DOUBLE values, precise at the upper tail. Coins are drawn from the state, so
    equal inputs in equal order give equal sketches."""

    def __init__(self, k: int = 32):
        self.k, self.n = k, 0
        self.levels: list[list] = []  # [buffer, compactions so far, sections, size of a section]

    def _level(self, h: int) -> list:
        while len(self.levels) <= h:
            self.levels.append([np.zeros(0), 0, SECTIONS, self.k])
        return self.levels[h]

    def add(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.float64)
        values = values[~np.isnan(values)]
        self.n += len(values)
        level = self._level(0)
        for i in range(0, len(values), 4096):
            level[0] = np.concatenate([level[0], values[i : i + 4096]])
            self._compress()

    def merge(self, other: TailSketch) -> None:
        self.n += other.n
        for h, (buffer, state, sections, size) in enumerate(other.levels):
            mine = self._level(h)
            mine[0] = np.concatenate([mine[0], buffer])
            mine[1] |= state
            if sections > mine[2]:
                mine[2], mine[3] = sections, size
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            while len(level[0]) >= 2 * level[2] * level[3]:
                buffer, state, sections, size = level
                trailing = (~state & (state + 1)).bit_length() - 1  # ones at the end of the counter
                keep = sections * size + max(0, sections - 1 - trailing) * size  # never less than the upper half
                low = len(buffer) - keep
                low -= low & 1
                buffer = np.sort(buffer)
                coin = (state * 0x9E3779B97F4A7C15 + h * 0xBF58476D1CE4E5B9 + len(buffer)) >> 13 & 1
                up = self._level(h + 1)
                up[0] = np.concatenate([up[0], buffer[coin:low:2]])
                level[0], level[1] = buffer[low:], state + 1
                if level[1] >= 1 << (sections - 1) and size > 8:  # more and smaller sections as it grows
                    level[2], level[3] = 2 * sections, max(8, int(round(size / 2**0.5)) & ~1)
            h += 1

    def quantiles(self, ranks: list[float]) -> list[float | None]:
        """The smallest value such that at least the share q of the values is not above it."""
        if not self.n:
            return [None] * len(ranks)
        values = np.concatenate([x[0] for x in self.levels])
        weights = np.concatenate([np.full(len(x[0]), 2.0**h) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        sums = np.cumsum(weights[order])
        at = [np.searchsorted(sums, q * sums[-1] * (1 - 1e-12)) for q in ranks]
        return [float(values[order][min(i, len(values) - 1)]) for i in at]

    def dump(self) -> bytes:
        head = struct.pack("<qii", self.n, self.k, len(self.levels))
        return head + b"".join(struct.pack("<iqii", len(b), s, c, z) + b.astype("<f8").tobytes() for b, s, c, z in self.levels)

    @classmethod
    def load(cls, data: bytes) -> TailSketch:
        n, k, count = struct.unpack_from("<qii", data)
        out, at = cls(k), 16
        out.n = n
        for _ in range(count):
            size, state, sections, width = struct.unpack_from("<iqii", data, at)
            at += 20
            out.levels.append([np.frombuffer(data, "<f8", size, at).copy(), state, sections, width])
            at += 8 * size
        return out


def _keyed(batch: pd.DataFrame, keys: list[str]):
    """(key, rows) of each run of equal keys, nulls being equal."""
    ids = np.zeros(len(batch), np.int64)
    for k in keys:
        code, _ = pd.factorize(batch[k], use_na_sentinel=True)
        ids = np.unique(ids * (len(batch) + 2) + code + 1, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    for a, b in zip(edges, [*edges[1:], len(order)]):
        at = order[a:b]
        yield tuple(None if pd.isna(v) else v for v in (batch[k].iloc[at[0]] for k in keys)), at


def sketch(df: DataFrame, keys: list[str], value: str, k: int = 32, most_open: int = 20_000) -> DataFrame:
    """Partial sketches: the keys and `sketch` BINARY, some for each key and task, to store or to merge.

    Null values count nowhere. A task keeps at most `most_open` sketches open and gives them out beyond
    that. Key columns may be null; other columns are ignored.
    """
    schema = T.StructType([df.schema[c] for c in keys] + [T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[tuple, TailSketch] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*key, s.dump()) for key, s in done.items()], columns=schema.names)

        for batch in batches:
            values = batch["__v"].to_numpy(np.float64)
            for key, at in _keyed(batch, keys):
                done.setdefault(key, TailSketch(k)).add(values[at])
            if len(done) > most_open:
                yield out()
                done.clear()
        if done:
            yield out()

    return df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")).mapInPandas(run, schema)


def merge_sketches(sketches: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """One sketch for each key. A task merges the sketches of a key one after the other, so its memory holds
    one sketch, whatever their number; with `salts` > 1 a key's sketches first merge in so many parts."""
    schema = T.StructType([sketches.schema[c] for c in keys] + [T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, None
        for batch in batches:
            rows = []
            for r in batch[[*keys, "sketch"]].itertuples(index=False):
                now = tuple(None if pd.isna(v) else v for v in r[:-1])
                if open_ is not None and now == key:
                    open_.merge(TailSketch.load(r[-1]))
                    continue
                if open_ is not None:
                    rows.append((*key, open_.dump()))
                key, open_ = now, TailSketch.load(r[-1])
            yield pd.DataFrame(rows, columns=schema.names)
        if open_ is not None:
            yield pd.DataFrame([(*key, open_.dump())], columns=schema.names)

    if salts > 1:
        salted = sketches.select(*keys, "sketch", F.pmod(F.xxhash64("sketch"), F.lit(salts)).alias("__salt"))
        sketches = merge_sketches(salted, [*keys, "__salt"], 1)
    sort = [*keys, F.xxhash64("sketch")]  # a fixed order, so that a task that runs again gives the same
    return sketches.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*sort).mapInPandas(run, schema)


def percentiles(merged: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """The keys, n LONG and one DOUBLE column for each of {name: rank}."""
    schema = T.StructType([merged.schema[c] for c in keys] + [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ranks])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch[[*keys, "sketch"]].itertuples(index=False):
                s = TailSketch.load(r[-1])
                rows.append((*r[:-1], s.n, *s.quantiles(list(ranks.values()))))
            yield pd.DataFrame(rows, columns=schema.names)

    return merged.mapInPandas(run, schema)


def records_once(records: DataFrame) -> DataFrame:
    """Succeeded records counted once by (runId, recordId): runId, client_name, requested, day, wall.

    Client names are compared in lower case without outer blanks. Of repeated records the earliest received
    stays. Records without a time stay with a null `wall`, which no sketch counts.
    """
    line = F.struct(
        F.col("receivedAt"),
        F.lower(F.trim("client.name")).alias("client_name"),
        F.col("condition.requested").alias("requested"),
        F.to_date("receivedAt").alias("day"),
        F.col("status"),
        F.col("timing.totalWallNs").alias("wall"),
    )
    once = records.select("runId", "recordId", line.alias("line")).groupBy("runId", "recordId").agg(F.min("line").alias("line"))
    return once.where(F.col("line.status") == "succeeded").select("runId", "line.client_name", "line.requested", "line.day", "line.wall")


def wrong_p95(summary: DataFrame, records: DataFrame, tolerance: float = 0.05, k: int = 32) -> DataFrame:
    """Rows of `summary` whose latencyNs.p95 is off by more than `tolerance` from their records' p95.

    Columns run_id, client_name, requested. Rows without counted records are no cases; a null p95 beside
    counted records is one. Keys compare null-safe.
    """
    keys = ["runId", "client_name", "requested"]
    p95 = percentiles(merge_sketches(sketch(records_once(records), keys, "wall", k), keys), keys, {"p95": 0.95})
    p95 = p95.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("p95").alias("__p95"))
    s = summary.select(F.col("runId").alias("run_id"), F.col("client.name").alias("client_name"), F.col("condition.requested").alias("requested"), F.col("latencyNs.p95").cast("double").alias("given"))
    on = F.col("run_id").eqNullSafe(F.col("__runId")) & F.lower(F.trim("client_name")).eqNullSafe(F.col("__client_name")) & F.col("requested").eqNullSafe(F.col("__requested"))
    off = F.coalesce(F.abs(F.col("given") - F.col("__p95")) > F.lit(tolerance) * F.col("__p95"), F.lit(True))
    return s.join(p95, on).where(off).select("run_id", "client_name", "requested").distinct()
