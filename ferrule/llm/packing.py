"""Filling containers of fixed capacity by minimum bin slack.

Items of one size are interchangeable, so what is packed is the histogram of sizes: at most `capacity`
numbers, however many items there are. For each container a subset-sum over the available sizes, held in
the bits of one integer, finds the fullest feasible combination around the largest item left; it is taken
as often as its sizes last. Each combination uses up a size, so there are about as many of them as sizes.
The items are then numbered within their size, in salted parts, and look up the container of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import materialize


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Sizes (with multiplicities within `counts`) whose sum is the largest that fits into `room`."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if 0 < s <= room and counts[s] > 0), reverse=True):
        steps.append((size, reach))
        left, part = min(counts[size], room // size), 1
        while left > 0:  # 1, 2, 4 ... copies and the rest make every multiplicity
            take = min(part, left)
            reach |= (reach << (take * size)) & full
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for size, earlier in reversed(steps):
        n = 0
        while not earlier >> total & 1:
            total, n = total - size, n + 1
        if n:
            chosen[size] = n
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of containers filled with it), until every item of the histogram is placed."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be between 1 and the capacity")
    plan = []
    while counts:
        seed = max(counts)
        rest = counts | {seed: counts[seed] - 1}
        chosen = fullest(rest, capacity - seed)
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[s] // n for s, n in chosen.items())
        plan.append((chosen, times))
        for s, n in chosen.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
    return plan


def _lookup(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By size: first number, copies a container, first container, offset of the first copy in it."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for chosen, times in plan:
        offset = 0
        for size in sorted(chosen, reverse=True):
            rows.setdefault(size, []).append((used.get(size, 0), chosen[size], first, offset))
            used[size] = used.get(size, 0) + chosen[size] * times
            offset += size * chosen[size]
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()}


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048, part: int = 200_000) -> DataFrame:
    """Places every item; columns key, piece INT, start LONG, size INT, container LONG, offset INT.

    An item longer than the capacity is divided into pieces of `capacity` and a rest (`start` is the place
    of the piece in its item); no other item is. `offset` is the place in the container; the sizes of a
    container never exceed the capacity. Items of size null or 0 take no room: they are listed once with
    piece 0 and a null container and offset. Repeated rows are items of their own. The order of rows does
    not matter: equal sizes are numbered by (key, piece). An empty table gives an empty result.
    """
    cap = F.lit(capacity)
    given = items.select(F.col(key).alias("__k"), F.col(size).cast("long").alias("__n"))
    # One branch for all rows: the sizes come from a Python stage that must not run twice.
    numbers = F.when(F.col("__n") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / cap))).otherwise(F.array(F.lit(0).cast("long")))
    parts = given.select("__k", "__n", F.explode(numbers).alias("__piece"))
    parts = parts.select("__k", "__piece", F.when(F.col("__n").isNotNull(), F.least(cap.cast("long"), F.col("__n") - F.col("__piece") * cap)).cast("int").alias("__size"))
    parts = materialize(parts, "sizes")
    placed, none = parts.where("__size > 0"), parts.where("__size IS NULL OR __size <= 0")

    counts = {int(r[0]): int(r[1]) for r in placed.groupBy("__size").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    # A size is numbered in parts of about `part` items, so the commonest one is not one task.
    salts = items.sparkSession.createDataFrame([(s, -(-n // part)) for s, n in counts.items()], "__size int, __salts int")
    placed = placed.join(F.broadcast(salts), "__size").withColumn("__salt", F.pmod(F.xxhash64("__k", "__piece"), F.col("__salts")).cast("int")).drop("__salts")
    cells = placed.groupBy("__size", "__salt").agg(F.count(F.lit(1)).alias("__c"))
    lookup = items.sparkSession.sparkContext.broadcast(_lookup(minimum_slack(counts, capacity)))  # so many ranges as sizes, times a small factor

    before = F.sum("__c").over(Window.partitionBy("__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as parts
    offsets = cells.select("__size", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__size", "__salt").orderBy("__k", "__piece")) - 1
    numbered = placed.withColumn("__no", number).join(offsets, ["__size", "__salt"]).select("__k", "__piece", "__size", (F.col("__no") + F.col("__before")).alias("__no"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lookup.value
        for b in batches:
            sizes, no = b["__size"].to_numpy(np.int64), b["__no"].to_numpy(np.int64)
            container, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                start, copies, first, base = table[int(s)]
                k = np.searchsorted(start, no[at], "right") - 1
                rank = no[at] - start[k]
                container[at], offset[at] = first[k] + rank // copies[k], base[k] + rank % copies[k] * s
            yield b.drop(columns="__no").assign(container=container, offset=offset)

    key_type = items.schema[key].dataType.simpleString()
    done = numbered.mapInPandas(place, f"__k {key_type}, __piece long, __size int, container long, offset int")
    done = done.unionByName(none.select("__k", "__piece", "__size", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("offset")))
    return done.select(F.col("__k").alias(key), F.col("__piece").cast("int").alias("piece"), (F.col("__piece") * cap).alias("start"), F.col("__size").alias("size"), "container", "offset")
