"""Connected files: a one-hop graph of files that share distinctive names, or a stem between test and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import index
from ferrule.session import materialize, small_side

# Definitions that link files.
LINKED = r"(?m)^[ \t]*(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|export|default|public|private|protected|static|final|abstract|internal|open|sealed|data)[ \t]+)*(?:(?:fn|function\*?|def|fun|class|struct|enum|trait|interface|type|object|module)[ \t]+([A-Za-z_][A-Za-z0-9_]*)|func[ \t]+(?:\([^\n)]*\)[ \t]*)?([A-Za-z_][A-Za-z0-9_]*))"
MIN_NAME, MAX_DEFINERS, SLOTS, PAIR = 4, 5, 30, 1000.0


def definers(chunks: DataFrame) -> DataFrame:
    """path, name of definitions of names with four letters or more that at most five files define."""
    d = index.declared(chunks, ["path"], LINKED).select("path", "name").where(F.length("name") >= MIN_NAME).distinct()
    few = d.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MAX_DEFINERS)
    return d.join(few.select("name"), "name", "left_semi")


def mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """path, name: files that hold one of the names as an identifier."""
    ids = index.words_of(chunks).where((F.length("name") >= MIN_NAME) & ~F.col("name").rlike("^[0-9]"))
    return ids.join(small_side(names.select("name").distinct()), "name", "left_semi").select("path", "name").distinct()


def connected(chunks: DataFrame, seeds: DataFrame, limit: int = SLOTS, asked: DataFrame | None = None) -> DataFrame:
    """qid, path, score, rank of files linked to a question's seed files (qid, path, seed, weight).

    A shared name, defined on one side and mentioned on the other, counts once, for the first seed that has
    it: seed weight x ln(1 + files / mentioning files), x 3 for names that the question asks for, where `asked`
    (qid, name) is given, x 0.3 for names with a leading underscore. A test and its source of one stem add 1000. Seeds themselves are no results.
    """
    d = materialize(definers(chunks), "defines")
    m = materialize(mentions(chunks, d), "mentions")
    total = F.broadcast(chunks.select("path").distinct().agg(F.count(F.lit(1)).alias("total")))  # one row
    rarity = m.groupBy("name").agg(F.count(F.lit(1)).alias("in_files")).crossJoin(total)
    rarity = rarity.select("name", (F.log(1 + F.col("total") / F.col("in_files")) * F.when(F.col("name").startswith("_"), 0.3).otherwise(1.0)).alias("rare"))
    sides = lambda own, other: seeds.join(own, "path").select("qid", "seed", "weight", "name").distinct().join(other.withColumnRenamed("path", "file"), "name")
    shared = sides(d, m).unionByName(sides(m, d)).join(seeds.select("qid", F.col("path").alias("file")), ["qid", "file"], "left_anti")
    first = shared.groupBy("qid", "file", "name").agg(F.min_by("weight", "seed").alias("weight"))
    first = first.join(rarity, "name")
    if asked is not None:
        first = first.join(asked.select("qid", "name").distinct().withColumn("asked", F.lit(3.0)), ["qid", "name"], "left").withColumn("weight", F.col("weight") * F.coalesce("asked", F.lit(1.0)))
    by_name = first.groupBy("qid", "file").agg(F.sum(F.col("weight") * F.col("rare")).alias("score"))
    files = chunks.select("path").distinct().select(F.col("path").alias("file"), X.file_stem("path").alias("stem"), X.is_test_path("path").alias("test")).where(F.length("stem") >= 3)
    own = seeds.select("qid", "weight", X.file_stem("path").alias("stem"), X.is_test_path("path").alias("own_test"))
    pairs = own.join(files, "stem").where(F.col("test") != F.col("own_test")).join(seeds.select("qid", F.col("path").alias("file")), ["qid", "file"], "left_anti")
    pairs = pairs.groupBy("qid", "file").agg((F.sum("weight") * PAIR).alias("score"))
    all_ = by_name.unionByName(pairs).groupBy("qid", "file").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "file")
    return all_.select("qid", F.col("file").alias("path"), "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)
