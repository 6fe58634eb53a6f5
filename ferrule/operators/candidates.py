"""Judged candidates: merged lists, runners-up, what else there is, copies, and the next action."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import ranges

CONNECTED_SHARE, RUNNER_UP, RUNNERS_UP, OTHERS_FROM, OTHERS, COPY = 0.4, 0.35, 2, 0.2, 6, 0.9
KEY = ["qid", "path", "start_line", "end_line"]


def merged(candidates: DataFrame, share: float = CONNECTED_SHARE) -> DataFrame:
    """KEY, connected, score, place: each candidate once, those that came by a link only with `share` of their score,
    in the order of scores (none counts as 0), ties by path and lines."""
    c = candidates.groupBy(*KEY).agg(F.max(F.when(~F.coalesce("connected", F.lit(False)), F.col("score"))).alias("own"), F.max("score").alias("any"), F.min(F.coalesce("connected", F.lit(False))).alias("connected"))
    c = c.select(*KEY, "connected", F.when(F.col("connected"), F.col("any") * share).otherwise(F.col("own")).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.coalesce("score", F.lit(0.0)).desc(), *KEY[1:])
    return c.withColumn("place", F.row_number().over(w))


def runners_up(judged: DataFrame, least: float = RUNNER_UP, most: int = RUNNERS_UP) -> DataFrame:
    """Of judged rows (qid, score, place, result) those that are no results but score `least` at least, the first
    `most`."""
    w = Window.partitionBy("qid").orderBy("place")
    return judged.where(~F.col("result") & (F.col("score") >= least)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def others(judged: DataFrame, shown: DataFrame, least: float = OTHERS_FROM, most: int = OTHERS) -> DataFrame:
    """Of judged rows (KEY, score, place) the first `most` that overlap nothing shown for their question (KEY) and
    score `least` or are not judged."""
    fits = judged.where(F.col("score").isNull() | (F.col("score") >= least))
    free = ranges.overlapping(fits, shown, "left_anti", ["qid", "path"])
    w = Window.partitionBy("qid").orderBy("place")
    return free.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def region_per_file(ranked: DataFrame) -> DataFrame:
    """KEY, rank, place: of the regions of a file the best ranked one; places anew."""
    best = first_of_each(ranked, ["qid", "path"], ["rank", "start_line"])
    return best.select(*KEY, "rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "path")).alias("place"))


def joined_lists(first: DataFrame, then: DataFrame) -> DataFrame:
    """KEY, place: a list (KEY, place) and behind it what another one adds."""
    more = then.join(first.select(*KEY), KEY, "left_anti")
    both = first.select(*KEY, F.lit(0).alias("l"), "place").unionByName(more.select(*KEY, F.lit(1).alias("l"), "place"))
    return both.select(*KEY, F.row_number().over(Window.partitionBy("qid").orderBy("l", "place", *KEY[1:])).alias("place"))


def changed_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """qid of questions whose candidate sets (KEY) differ, so that asking again can change the answer."""
    a, b = old.select(*KEY).distinct(), new.select(*KEY).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("qid").distinct()


def distinct_evidence(actions: DataFrame, seen: DataFrame) -> DataFrame:
    """qid, label, evidence of actions (qid, label, order, and one row a chunk in KEY) without the chunks seen before
    and without actions that have nothing left or the chunks of an earlier one; `evidence` is the sorted set."""
    left = actions.join(seen.select(*KEY), KEY, "left_anti")
    sets = left.groupBy("qid", "label").agg(F.min("order").alias("order"), F.array_sort(F.collect_set(F.struct(*KEY[1:]))).alias("evidence"))  # the chunks of one action
    return first_of_each(sets, ["qid", "evidence"], ["order", "label"]).select("qid", "label", "evidence")


def chosen_actions(actions: DataFrame, finish: DataFrame) -> DataFrame:
    """qid, action: the most probable action (qid, action, p), the first of equals; null where finishing (qid, p) is at
    least as probable. A probability outside 0 to 1 is an error."""
    checked = actions.select("qid", "action", F.when(F.col("p").between(0, 1), F.col("p")).otherwise(F.raise_error(F.lit("probabilities must lie between 0 and 1")).cast("double")).alias("p"))
    best = checked.groupBy("qid").agg(F.min(F.struct((-F.col("p")).alias("m"), "action")).alias("b"))
    j = finish.select("qid", F.col("p").alias("stop")).join(best, "qid", "full_outer")
    return j.select("qid", F.when(-F.col("b.m") > F.coalesce("stop", F.lit(-1.0)), F.col("b.action")).alias("action"))


def copies(chunks: DataFrame, names: DataFrame, definers: int = 5, similarity: float = COPY) -> DataFrame:
    """name, chunk_a < chunk_b, similarity: chunks of two files that define the same name with nearly the same words,
    shared ones over those of the larger set, comment lines aside.

    chunks: chunk_id, path, text; names: chunk_id, path, name. Names of more than `definers` files are no copies but
    customs, so a name meets a few chunks only.
    """
    few = names.groupBy("name").agg(F.count_distinct("path").alias("n"), F.count_distinct("chunk_id").alias("m")).where((F.col("n") > 1) & (F.col("n") <= definers) & (F.col("m") <= 4 * definers)).select("name")
    at = names.select("name", "chunk_id", "path").distinct().join(few, "name")
    code = F.filter(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1), lambda line: ~F.ltrim(line).rlike(r"^(?://|/\*|\*|#(?!\[))"))
    sets = chunks.join(at.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.array_distinct(X.tokens(F.array_join(code, "\n"))).alias("words"))
    a = at.join(sets, "chunk_id")
    b = a.select("name", *[F.col(c).alias(f"{c}_b") for c in ("chunk_id", "path", "words")])
    pair = a.join(b, "name").where((F.col("chunk_id") < F.col("chunk_id_b")) & (F.col("path") != F.col("path_b")))
    share = F.size(F.array_intersect("words", "words_b")) / F.greatest(F.size("words"), F.size("words_b"), F.lit(1))
    return pair.select("name", F.col("chunk_id").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"), share.alias("similarity")).where(F.col("similarity") >= similarity)
