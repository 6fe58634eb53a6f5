"""Retrieval measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_mrr(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 20)) -> DataFrame:
    """qid, gold, recall_at_k for each k, mrr: over questions with gold; ranked has qid, item, rank."""
    g = gold.select("qid", "item").distinct()
    j = g.join(ranked.groupBy("qid", "item").agg(F.min("rank").alias("rank")), ["qid", "item"], "left")
    aggs = [F.count(F.lit(1)).alias("gold")] + [(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_at_{k}") for k in ks]
    return j.groupBy("qid").agg(*aggs, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"))


def accuracy_at(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """qid, all_found: whether every gold item stands in the first k."""
    j = gold.select("qid", "item").distinct().join(ranked.where(F.col("rank") <= k).select("qid", "item").distinct().withColumn("hit", F.lit(True)), ["qid", "item"], "left")
    return j.groupBy("qid").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all_found"))


def range_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, top1, top5: whether a gold range (path, start_line, end_line) overlaps the first or first five."""
    g = gold.select("qid", "path", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))
    hit = (F.col("start_line") <= F.col("ge")) & (F.col("gs") <= F.col("end_line"))
    j = g.join(ranked.select("qid", "path", "start_line", "end_line", "rank"), ["qid", "path"], "left")
    return j.groupBy("qid").agg(F.coalesce(F.bool_or(hit & (F.col("rank") == 1)), F.lit(False)).alias("top1"), F.coalesce(F.bool_or(hit & (F.col("rank") <= 5)), F.lit(False)).alias("top5"))


def coverage(gold: DataFrame, excerpts: DataFrame, listed: DataFrame) -> DataFrame:
    """Gold ranges with their outcome: covered (within an excerpt), listed (its file is), or missed."""
    e = excerpts.select("qid", "path", F.col("start_line").alias("es"), F.col("end_line").alias("ee"))
    inside = gold.join(e, ["qid", "path"]).where((F.col("es") <= F.col("start_line")) & (F.col("end_line") <= F.col("ee"))).select(*gold.columns).distinct().withColumn("covered", F.lit(True))
    files = listed.select("qid", "path").distinct().withColumn("listed", F.lit(True))
    j = gold.join(inside, gold.columns, "left").join(files, ["qid", "path"], "left")
    return j.select(*gold.columns, F.when(F.col("covered"), "covered").when(F.col("listed"), "listed").otherwise("missed").alias("outcome"))


def split_of(ids: DataFrame, key: str) -> DataFrame:
    """key, split: dev if the first byte of the id's SHA-256 is even, else heldout."""
    return ids.select(key, F.when(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), 16, 10).cast("int") % 2 == 0, "dev").otherwise("heldout").alias("split"))


def id_hits(ranked: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """qid, top1, top5 of every case (qid): whether an expected id (qid, item) is the first, or among the first five,
    of its list (qid, item, rank). A case that expects nothing is right only with an empty list."""
    hit = ranked.join(expected.select("qid", "item").distinct().withColumn("good", F.lit(True)), ["qid", "item"], "left")
    got = hit.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good") & (F.col("rank") == 1)).alias("first"), F.count_if(F.col("good") & (F.col("rank") <= 5)).alias("five"))
    wants = expected.select("qid").distinct().withColumn("wants", F.lit(True))
    j = cases.select("qid").distinct().join(got, "qid", "left").join(wants, "qid", "left")
    none = F.col("wants").isNull()
    empty = F.coalesce("n", F.lit(0)) == 0
    return j.select("qid", F.when(none, empty).otherwise(F.coalesce("first", F.lit(0)) > 0).alias("top1"), F.when(none, empty).otherwise(F.coalesce("five", F.lit(0)) > 0).alias("top5"))


def mode_summary(runs: DataFrame) -> DataFrame:
    """By mode of runs (mode, failed, top1, top5, value): runs, errors, top1, top5 and the median of `value` over runs
    without an error. A failed run counts as a miss."""
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False)) & ~F.col("failed"))
    return runs.groupBy("mode").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("errors"), hit("top1").alias("top1"), hit("top5").alias("top5"), F.percentile(F.when(~F.col("failed"), F.col("value")), 0.5).alias("median")
    )


def means_with_errors(samples: DataFrame, group: str, values: list[str]) -> DataFrame:
    """The means of values over all samples of a group; a failed sample counts as zero in each, a null as well."""
    zero = lambda c: F.when(F.col("failed"), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), *[(F.sum(zero(c)) / F.count(F.lit(1))).alias(c) for c in values])
