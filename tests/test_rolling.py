import random
from collections import defaultdict

import numpy as np
import pytest

from ferrule.operators.rolling import _exact_product, band, calls_once, disagreeing_reports, trailing_totals, utc_day

SCHEMA = "ws string, day int, tokens long, ms long, calls string"


def brute(rows, periods, last):
    daily = defaultdict(list)
    for ws, day, tok, ms, _ in rows:
        if day is not None and day <= last:
            daily[ws, day].append((tok or 0, ms))
    out = {}
    for ws in {w for w, _ in daily}:
        for day in range(min(d for w, d in daily if w == ws), last + 1):
            for p in periods:
                got = [x for d in range(day - p + 1, day + 1) for x in daily.get((ws, d), [])]
                ms = [m for _, m in got if m is not None]
                out[ws, day, p] = (len(got), sum(t for t, _ in got), sum(ms) / len(ms) if ms else None)
    return out


@pytest.mark.parametrize("tile_days,block", [(64, 512), (8, 3), (5, 1)])
def test_against_brute_force(spark, tile_days, block):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([None, *range(100, 180)]), rng.choice([None, 1, 7]), rng.choice([None, 3, 10]), "x") for _ in range(400)]
    rows += rows[:20]
    got = trailing_totals(spark.createDataFrame(rows, SCHEMA), "ws", "day", {"tokens": "tokens"}, (7, 30), 190, {"avg": "ms"}, tile_days, block).collect()
    assert len({(r[0], r[1], r[2]) for r in got}) == len(got)
    want = brute(rows, (7, 30), 190)
    assert {(r["ws"], r["day"], r["period_days"]) for r in got} == set(want)
    for r in got:
        n, tok, avg = want[r["ws"], r["day"], r["period_days"]]
        assert (r["calls"], r["tokens"]) == (n, tok)
        assert r["avg"] is None if avg is None else abs(r["avg"] - avg) < 1e-9


def test_empty_and_negative_days(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trailing_totals(empty, "ws", "day", {"t": "tokens"}).collect() == []
    one = spark.createDataFrame([("a", -3, 5, None, "x")], SCHEMA)
    got = trailing_totals(one, "ws", "day", {"t": "tokens"}, (2,), 0).orderBy("day").collect()
    assert [(r["day"], r["t"]) for r in got] == [(-3, 5), (-2, 5), (-1, 0), (0, 0)]


def test_sums_stay_exact_beyond_floats():
    block = np.array([[2**60 + 1, 3, 0]], dtype=np.int64)
    assert _exact_product(block, band(1, 2, 3))[0, 0] == 2**60 + 4


def test_days_of_rfc3339(spark):
    at = ["2026-03-01T00:30:00+02:00", "2026-03-01 10:00:00z", "2026-03-01t10:00:00.5Z", "2026-02-30T10:00:00Z", "1760000000", " ", None, "2026-03-01T10:00:00"]
    got = spark.createDataFrame([(a,) for a in at], "at string").select(utc_day("at").alias("d")).collect()
    assert [r[0] for r in got] == [20512, 20513, 20513, None, None, None, None, None]


def test_lines_count_once_and_reports_disagree(spark):
    lines = [(1, "2026-08-30T10:00:00Z", "w/", 10, 5, "2026-08-30 10:00:01"), (1, "2026-08-30T10:00:00Z", "w/", 10, 5, "2026-08-30 10:00:09"), (None, "2026-08-31T10:00:00Z", "w", 30, None, "2026-08-31 10:00:00")]
    calls = spark.createDataFrame(lines, "entry_id long, at string, workspace string, ms long, input_tokens long, received_at string")
    totals = trailing_totals(calls_once(calls), "workspace", "day", {"input_tokens": "input_tokens"}, (7, 30), 20696, {"avg_ms": "ms"})
    reports = [("w", "2026-08-31", 7, 2, 5, 20.1), ("w", "2026-08-31", 30, 3, 5, 20.0), ("w/", "2026-08-30", 7, 1, 5, 11.0), ("idle", "2026-08-30", 7, 0, 0, None), ("w", "2026-08-31", 30, 3, 5, 20.0)]
    given = spark.createDataFrame(reports, "workspace string, day string, period_days int, calls long, input_tokens long, avg_ms double").selectExpr("workspace", "cast(day as date) day", "period_days", "calls", "input_tokens", "avg_ms")
    assert {tuple(r) for r in disagreeing_reports(given, totals).collect()} == {("w", "2026-08-31", 30), ("w/", "2026-08-30", 7)}
