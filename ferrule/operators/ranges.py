"""Joins on line ranges, and merging of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64  # lines: a range meets only the points of its own buckets, so no join is a nested loop


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (path, line) with the smallest span (path, name, start_line, end_line) around them, the first
    one on ties; points in no span get nulls."""
    s = spans.select("path", "name", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("b"))
    p = points.select("path", "line").distinct().withColumn("b", F.floor(F.col("line") / BUCKET))
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "name", "end_line")
    j = p.join(s, ["path", "b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy("path", "line").agg(F.min(best).alias("m"))
    return points.join(j, ["path", "line"], "left").select(*points.columns, F.col("m.name").alias("name"), F.col("m.start_line").alias("start_line"), F.col("m.end_line").alias("end_line"))


def overlapping(left: DataFrame, right: DataFrame, how: str = "left_semi", keys: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """Rows of left (the keys, start_line, end_line, ...) that overlap (left_semi) or don't (left_anti) a row of right.

    Ranges of right are merged first, then both sides meet in buckets of lines, so many ranges of one path are
    no nested loop. Left rows are told apart by their keys and lines."""
    r = merged(right.select(*keys, "start_line", "end_line").distinct(), keys)
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / BUCKET), F.floor(F.col(e) / BUCKET)))
    r = r.select(*keys, F.col("start_line").alias("rs"), F.col("end_line").alias("re")).withColumn("b", buckets("rs", "re"))
    at = left.select(*keys, "start_line", "end_line").where("start_line <= end_line").distinct().withColumn("b", buckets("start_line", "end_line"))
    hit = at.join(r, [*keys, "b"]).where("start_line <= re AND rs <= end_line").select(*keys, "start_line", "end_line").distinct()
    return left.join(hit, [*keys, "start_line", "end_line"], how)


def merged(ranges: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """The keys, start_line, end_line, parts: ranges that overlap or adjoin become one (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = ranges.withColumn("new", F.when(before.isNull() | (F.col("start_line") > before + gap), 1).otherwise(0))
    g = g.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("parts")).drop("island")


def nearest_ancestor(files: DataFrame, configs: DataFrame) -> DataFrame:
    """path and config: the config file (by its path) in the nearest folder above or beside a file, or null."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, i), "/")).alias("dir")))
    f = files.select("path", F.explode(dirs).alias("d")).select("path", "d.depth", "d.dir")
    c = configs.select(F.col("path").alias("config"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    best = f.join(c, "dir").groupBy("path").agg(F.min_by("config", F.struct(-F.col("depth"), F.col("config"))).alias("config"))
    return files.select("path").join(best, "path", "left")


def adjoining(strong: DataFrame, all_: DataFrame, lines: int = 60) -> DataFrame:
    """Neighbours of strong chunks: qid, rank, chunk_id of shorter chunks of the same file that begin within or
    right after a strong one and end beyond it, or end within or right before it and begin earlier."""
    s = strong.select("qid", "rank", "path", F.col("start_line").alias("ss"), F.col("end_line").alias("se"))
    a = all_.select("qid", "path", "chunk_id", "start_line", "end_line")
    after = F.col("start_line").between(F.col("ss"), F.col("se") + 1) & (F.col("end_line") > F.col("se"))
    before = F.col("end_line").between(F.col("ss") - 1, F.col("se")) & (F.col("start_line") < F.col("ss"))
    near = s.join(a, ["qid", "path"]).where((F.col("end_line") - F.col("start_line") < lines) & (after | before))
    return near.groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank"))
