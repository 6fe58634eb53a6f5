"""Workspace files, call-log files and index snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Languages that are read by a parser and may be larger.
PARSED_PATH = r"\.(?:rs|[cm]?js|jsx|[cm]?ts|tsx|pyi?|go|rb|rake|gemspec|java|kts?)$"
LIMIT, CODE_LIMIT, MINIFIED = 256 * 1024, 1024 * 1024, 200
CALL_LINE = "entry_id long, at string, workspace string, phase string, ok boolean, status int, error string, ms long, input_tokens long, output_tokens long"


def read_workspace(spark: SparkSession, root: str, ignored: DataFrame | None = None) -> DataFrame:
    """path, text, digest, bytes, skip of every file below `root`.

    skip is null or why a file has no text: too_large (decided by the length alone, nothing of it is decoded),
    binary, not_utf8, minified, blank. A byte order mark is dropped. `ignored` (pattern, a regular expression on
    paths) names files that are left out altogether; folders for version control always are.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file:").rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^\\Q{base}\\E/*", "")
    f = raw.withColumn("path", path).where(~F.col("path").rlike(r"(^|/)\.(git|hg|svn)/"))
    if ignored is not None:
        f = f.join(F.broadcast(ignored.select("pattern").limit(10_000)), F.expr("path RLIKE pattern"), "left_anti")
    limit = F.when(F.col("path").rlike(PARSED_PATH), CODE_LIMIT).otherwise(LIMIT)
    fits = F.col("length") <= limit
    f = f.select("path", F.col("length").alias("bytes"), fits.alias("fits"), F.when(fits, F.col("content")).alias("c"))
    body = F.when(F.startswith(F.col("c"), F.lit(bytearray(b"\xef\xbb\xbf"))), F.expr("substring(c, 4)")).otherwise(F.col("c"))
    f = f.select("path", "bytes", "fits", F.sha2("c", 256).alias("digest"), F.is_valid_utf8(F.col("c").cast("string")).alias("valid"), body.cast("string").alias("t"))
    newlines = F.greatest(F.regexp_count("t", F.lit("\n")), F.lit(1))
    skip = (
        F.when(~F.col("fits"), "too_large")
        .when(F.contains("t", F.lit("\x00")), "binary")
        .when(~F.col("valid"), "not_utf8")
        .when((F.col("bytes") > LIMIT) & (F.floor(F.col("bytes") / newlines) > MINIFIED), "minified")
        .when(F.col("t").rlike(r"^[\s\x{feff}]*\z"), "blank")
    )
    return f.withColumn("skip", skip).select("path", F.when(F.col("skip").isNull(), F.col("t")).alias("text"), "digest", "bytes", "skip")


def write_calls(calls: DataFrame, folder: str) -> None:
    """Append call lines as JSON, a folder for each month."""
    calls.withColumn("month", F.substring("at", 1, 7)).write.mode("append").partitionBy("month").json(folder)


def read_calls(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """Call lines from months on or after that of `since` (YYYY-MM-DD), malformed lines left out."""
    log = spark.read.schema(CALL_LINE + ", month string").option("mode", "DROPMALFORMED").json(folder)
    if since:
        log = log.where(F.col("month") >= since[:7]).where(F.substring("at", 1, 10) >= since)
    return log.drop("month")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two manifests of path and digest."""
    o, n = old.select("path", F.col("digest").alias("o")), new.select("path", F.col("digest").alias("n"))
    j = o.join(n, "path", "full_outer")
    return j.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").alias("change")).where("change IS NOT NULL")


def skipped(files: DataFrame, keep: int = 256) -> DataFrame:
    """path, skip, bytes, place: the largest skipped files of a coverage report, too large ones first, ties by path;
    `keep` of them. The limit is the report's."""
    w = Window.orderBy(F.desc(F.col("skip") == "too_large"), F.desc("bytes"), "path")
    top = files.where("skip IS NOT NULL").select("path", "skip", "bytes").orderBy(F.desc(F.col("skip") == "too_large"), F.desc("bytes"), "path").limit(keep)
    return top.withColumn("place", F.row_number().over(w))  # over `keep` rows
