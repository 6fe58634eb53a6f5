"""Bounded re-ranking requests, judged orders, and offline scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X


def valid_items(items: DataFrame, limit_units: int = 200) -> DataFrame:
    """Items with violation STRING, null where they are valid: blank_id, long_id, duplicate_id, blank_text."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"[\s\x{00a0}\x{feff}]+", "")) == "", F.lit(True))
    return items.select("*", F.when(blank("id"), "blank_id").when(X.utf16_length("id") > limit_units, "long_id").when(n > 1, "duplicate_id").when(blank("text"), "blank_text").alias("violation"))


def cut_to_budget(items: DataFrame, group: str, order: str, text: str, envelope: int, budget: int) -> DataFrame:
    """The longest prefix of each group, in order, whose request fits: adds bytes and total. The text costs
    its length within a JSON string and two quotes."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sized = items.withColumn("bytes", X.escaped_length(text) + 2)
    return sized.withColumn("total", F.sum("bytes").over(w) + envelope).where(F.col("total") <= budget)


def answer_budget(questions: Column) -> tuple[Column, Column]:
    """results and bytes of an answer to so many questions: 3 and 16,000, for each further question 2 and 5,000
    more, 12 and 36,000 at most."""
    more = F.greatest(questions - 1, F.lit(0))
    return F.least(F.lit(12), 3 + 2 * more).cast("long").alias("results"), F.least(F.lit(36_000), 16_000 + 5_000 * more).cast("long").alias("bytes")


def judged_order(judged: DataFrame, group: str, score: str, index: str, threshold: float = 0.5, limit: int = 5) -> DataFrame:
    """Judged rows with place by (score descending, input index) and result: strictly above the threshold and
    among the first `limit`."""
    w = Window.partitionBy(group).orderBy(F.desc(score), index)
    j = judged.withColumn("place", F.row_number().over(w))
    return j.withColumn("result", (F.col(score) > threshold) & (F.col("place") <= limit))


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], out: str = "score") -> DataFrame:
    """Adds a score from a callable on batches; it must return numbers in [0, 1], else the job fails as a
    whole. The callable is sent to the tasks, so it may hold a client or a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = pd.Series(scorer(batch), index=batch.index, dtype="float64")
            if s.isna().any() or ((s < 0) | (s > 1)).any():
                raise ValueError("scores must be numbers between 0 and 1")
            yield batch.assign(**{out: s})

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` double")


def word_overlap(batch: pd.DataFrame) -> pd.Series:
    """A deterministic offline scorer on columns question and text: share of the question's words in the text."""
    import re

    def one(q: str | None, t: str | None) -> float:
        a, b = (set(re.findall(r"[a-z0-9]+", (x or "").lower())) for x in (q, t))
        return len(a & b) / len(a) if a else 0.0

    return pd.Series([one(q, t) for q, t in zip(batch["question"], batch["text"])], index=batch.index)
