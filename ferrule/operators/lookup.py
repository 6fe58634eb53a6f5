"""Named definitions: lookup with fallbacks, the choice among several, and pins ahead of a shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X

COMMON, PINS = 5, 3


def lookup(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each wanted name (qid, name, order) with the definitions it means: level 0 by its exact or qualified name,
    level 1, where there is none, by its last part in any case. Null names mean nothing.

    definitions: name, qualified, path, start_line, end_line, exported. A qualified name (with . # or ::) means
    definitions of that qualified name or of one that ends with it.
    """
    w = wanted.where("name IS NOT NULL").select("qid", "name", "order", X.leaf_of("name").alias("leaf"), F.regexp_replace("name", "::|#", ".").alias("dotted"))
    d = definitions.withColumnRenamed("name", "defined")
    full = F.lower("leaf") == F.lower("dotted")
    meant = full | (F.col("qualified") == F.col("dotted")) | F.endswith(F.col("qualified"), F.concat(F.lit("."), F.col("dotted")))
    exact = w.join(d, F.col("leaf") == F.col("defined")).where(meant).withColumn("level", F.lit(0))
    rest = w.join(exact.select("qid", "name").distinct(), ["qid", "name"], "left_anti")
    near = rest.join(d, F.lower("leaf") == F.lower("defined")).withColumn("level", F.lit(1))
    return exact.unionByName(near.select(*exact.columns)).drop("dotted")


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """qid, name of wanted names without a definition."""
    return wanted.select("qid", "name").where("name IS NOT NULL").distinct().join(found.select("qid", "name").distinct(), ["qid", "name"], "left_anti")


def _holds(question: Column, word: Column) -> Column:
    """Whether a text holds a word, not within a longer one; false for an empty word."""
    padded = F.concat(F.lit(" "), F.regexp_replace(question, r"[^A-Za-z0-9_./-]+", " "), F.lit(" "))
    return (F.length(word) > 0) & F.contains(padded, F.concat(F.lit(" "), word, F.lit(" ")))


def pins(found: DataFrame, questions: DataFrame, most: int = PINS) -> DataFrame:
    """qid, name, place, path, start_line, end_line, others: the definition that each name of a question means, the
    first `most` by the order of names.

    Of several the first counts by: its container is named in the question, its file is, it is no test, it is
    exported, the shorter path, the path, the line. A name that five definitions or more outside tests have is
    pinned only where container or file is named, or where one of them alone stands at the top level. `others` counts
    the definitions passed over.
    """
    f = found.join(questions.select("qid", "question"), "qid")
    container = F.regexp_extract("qualified", r"([A-Za-z0-9_]+)\.[A-Za-z0-9_]+$", 1)
    base = F.substring_index("path", "/", -1)
    test = X.is_test_path("path")
    f = f.withColumn("inside", _holds(F.col("question"), container)).withColumn("at", _holds(F.col("question"), base) | _holds(F.col("question"), F.col("path"))).withColumn("test", test)
    group = Window.partitionBy("qid", "name")
    f = f.withColumn("plain", F.count_if(~F.col("test")).over(group)).withColumn("hinted", F.max(F.col("inside") | F.col("at")).over(group))
    top = (F.col("qualified") == F.col("leaf")) & ~F.col("test")
    f = f.withColumn("top", top).withColumn("tops", F.count_if(top).over(group)).withColumn("all", F.count(F.lit(1)).over(group))
    sole = ~F.col("hinted") & (F.col("tops") == 1)
    f = f.where((F.col("plain") < COMMON) | F.col("inside") | F.col("at") | sole & F.col("top"))
    order = group.orderBy(F.desc("inside"), F.desc("at"), "test", F.desc("exported"), F.length("path"), "path", "start_line")
    chosen = f.withColumn("n", F.row_number().over(order)).where("n = 1")
    # Two names may mean one definition; it is pinned once.
    once = Window.partitionBy("qid", "path", "start_line", "end_line").orderBy("order", "name")
    chosen = chosen.withColumn("again", F.row_number().over(once)).where("again = 1")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("order", "name"))
    return chosen.withColumn("place", place).where(F.col("place") <= most).select("qid", "name", "place", "path", "start_line", "end_line", (F.col("all") - 1).alias("others"))


def pinned_shortlist(pinned: DataFrame, shortlist: DataFrame, limit: int = 60) -> DataFrame:
    """qid, rank, path, start_line, end_line, pinned: pins first, then the shortlist (qid, rank, ...) without them, as
    long as the list has at most `limit` rows or as many as pins."""
    key = ["qid", "path", "start_line", "end_line"]
    p = pinned.select(*key, F.col("place").alias("o"), F.lit(True).alias("pinned"))
    s = shortlist.join(p.select(*key), key, "left_anti").select(*key, F.col("rank").alias("o"), F.lit(False).alias("pinned"))
    w = Window.partitionBy("qid").orderBy(F.desc("pinned"), "o", *key[1:])
    return p.unionByName(s).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= limit) | F.col("pinned")).select("qid", "rank", *key[1:], "pinned")
