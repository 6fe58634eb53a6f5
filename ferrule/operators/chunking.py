"""Texts to line-range chunks and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_plain(files: DataFrame, path: str = "path", text: str = "text", limit: int = 40, overlap: int = 5) -> DataFrame:
    """path, start_line, end_line, text: windows of `limit` lines that share `overlap` lines with the next.

    Lines end with CR, LF or both; one empty last line is dropped; an empty or null text has no chunk.
    """
    step = limit - overlap
    lines = F.split(F.regexp_replace(F.col(text), "\r\n|\r", "\n"), "\n", -1)
    f = files.select(F.col(path).alias("path"), lines.alias("l")).withColumn("l", F.when(F.element_at("l", -1) == "", F.slice("l", 1, F.size("l") - 1)).otherwise(F.col("l"))).where(F.size("l") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("l") - limit) / step)).cast("int")
    w = f.select("path", "l", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return w.select("path", (F.col("k") * step + 1).alias("start_line"), F.least(F.col("k") * step + limit, F.size("l")).alias("end_line"), F.array_join(F.slice("l", F.col("k") * step + 1, limit), "\n").alias("text"))


def chunk_lines(chunks: DataFrame, keys: list[str] = ["path"], text: str = "text") -> DataFrame:  # noqa: B006
    """The keys, line INT and line_text of every line of consistent chunks: start_line + i for the i-th line.

    A chunk whose number of lines is not end_line - start_line + 1 is left out; one empty last line is
    tolerated.
    """
    parts = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n", -1)
    c = chunks.select(*keys, "start_line", "end_line", parts.alias("__p"))
    c = c.withColumn("__p", F.when((F.element_at("__p", -1) == "") & (F.size("__p") > F.col("end_line") - F.col("start_line") + 1), F.slice("__p", 1, F.size("__p") - 1)).otherwise(F.col("__p")))
    c = c.where(F.size("__p") == F.col("end_line") - F.col("start_line") + 1)
    return c.select(*keys, "start_line", F.posexplode("__p").alias("__i", "line_text")).select(*keys, (F.col("start_line") + F.col("__i")).alias("line"), "line_text")


def file_lines(chunks: DataFrame, text: str = "text") -> DataFrame:
    """path, line INT, line_text: every line of a file once, from consistent chunks (see `chunk_lines`). Of a line
    that several chunks give, the one that begins first counts. Only ranges are compared, no line is shuffled."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n", -1)
    n = F.col("end_line") - F.col("start_line") + 1
    c = chunks.select("path", "start_line", "end_line", F.col(text).alias("__t"), parts.alias("__p"))
    c = c.withColumn("__p", F.when((F.element_at("__p", -1) == "") & (F.size("__p") > n), F.slice("__p", 1, F.size("__p") - 1)).otherwise(F.col("__p")))
    c = c.where((F.size("__p") == n) & F.col("path").isNotNull())
    w = Window.partitionBy("path").orderBy("start_line", F.desc("end_line"), "__t").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__seen", F.greatest(F.lit(0), F.coalesce(F.max("end_line").over(w) - F.col("start_line") + 1, F.lit(0))).cast("int"))
    c = c.where(F.col("__seen") < F.size("__p")).select("path", (F.col("start_line") + F.col("__seen")).alias("__s"), F.slice("__p", F.col("__seen") + 1, F.size("__p")).alias("__p"))
    return c.select("path", "__s", F.posexplode("__p").alias("__i", "line_text")).select("path", (F.col("__s") + F.col("__i")).alias("line"), "line_text")


def joined_runs(chunks: DataFrame) -> DataFrame:
    """path, start_line, text: chunks of a file that adjoin or overlap joined, so a file without gaps is one row.

    Lines that an earlier chunk gave are left out. A gap begins a new row; a chunk whose number of lines is not
    end_line - start_line + 1, or has no lines given, is a row of its own, as it is.
    """
    parts = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)
    n = F.col("end_line") - F.col("start_line") + 1
    c = chunks.where("path IS NOT NULL AND text IS NOT NULL").select("path", "start_line", "end_line", "text", parts.alias("p"))
    c = c.withColumn("p", F.when((F.element_at("p", -1) == "") & (F.size("p") > n), F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p")))
    fits = F.coalesce(F.size("p") == n, F.lit(False))
    odd = c.where(~fits).select("path", "start_line", "text")
    w = Window.partitionBy("path").orderBy("start_line", F.desc("end_line"), "text")
    c = c.where(fits).withColumn("before", F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("run", F.count_if(F.col("before").isNull() | (F.col("start_line") > F.col("before") + 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.greatest(F.lit(0), F.coalesce(F.col("before") - F.col("start_line") + 1, F.lit(0))).cast("int")
    c = c.where(seen < F.size("p")).select("path", "run", "start_line", F.array_join(F.slice("p", seen + 1, F.size("p")), "\n").alias("t"), (F.col("start_line") + seen).alias("at"))
    runs = c.groupBy("path", "run").agg(F.min("start_line").alias("start_line"), F.array_sort(F.collect_list(F.struct("at", "t"))).alias("l"))
    return runs.select("path", "start_line", F.array_join(F.col("l.t"), "\n").alias("text")).unionByName(odd)


#: Lines that open a declaration, comments that belong to it, and files cut by declarations.
DECLARATION = r"^\s*(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|export|default)\s+)*(?:fn|function\*?|def)\s+[A-Za-z0-9_]+"
COMMENT = r"^\s*(?://|#|/\*\*|\*)"
SECTIONED = r"\.(?:rs|[cm]?js|jsx|ts|tsx|py)$"


def chunk_code(files: DataFrame, path: str = "path", text: str = "text", limit: int = 40, declared: int = 120, overlap: int = 5) -> DataFrame:
    """path, start_line, end_line, text: sections that begin at declarations, with the comments above them,
    cut into windows of `declared` lines where a declaration opens the section, else of `limit`.

    Only files that `SECTIONED` names are read by declarations; others are one plain section. Sections and
    windows come from per-line flags within one row, so nothing is shuffled.
    """
    lines = F.split(F.regexp_replace(F.col(text), "\r\n|\r", "\n"), "\n", -1)
    f = files.select(F.col(path).alias("path"), lines.alias("l")).withColumn("l", F.when(F.element_at("l", -1) == "", F.slice("l", 1, F.size("l") - 1)).otherwise(F.col("l"))).where(F.size("l") > 0)
    # For each line (from 0) the first line of the comment block right above it: the state of a fold.
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("top"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct(
        (a["i"] + 1).alias("i"),
        F.when(x.rlike(COMMENT), a["top"]).otherwise(a["i"] + 1).alias("top"),
        F.when(x.rlike(DECLARATION), F.array_append(a["starts"], a["top"])).otherwise(a["starts"]).alias("starts"),
    )
    starts = F.when(F.col("path").rlike(SECTIONED), F.aggregate("l", start, step, lambda a: a["starts"])).otherwise(F.array().cast("array<int>"))
    s = f.withColumn("d", F.array_distinct(starts)).withColumn("b", F.array_sort(F.array_union(F.array(F.lit(0)), F.col("d"))))
    s = s.select("path", "l", "d", "b", F.posexplode("b").alias("i", "a")).withColumn("z", F.coalesce(F.get("b", F.col("i") + 1), F.size("l")))
    s = s.withColumn("m", F.when(F.array_contains("d", F.col("a")), declared).otherwise(limit)).where("z > a")
    last = F.greatest(F.lit(0), F.ceil((F.col("z") - F.col("a") - F.col("m")) / (F.col("m") - overlap))).cast("int")
    w = s.withColumn("k", F.explode(F.sequence(F.lit(0), last))).withColumn("s", F.col("a") + F.col("k") * (F.col("m") - overlap)).withColumn("e", F.least(F.col("s") + F.col("m"), F.col("z")))
    return w.select("path", (F.col("s") + 1).alias("start_line"), F.col("e").alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, F.col("e") - F.col("s")), "\n").alias("text"))
