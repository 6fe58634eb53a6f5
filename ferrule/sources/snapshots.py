"""Snapshots of derived tables with a manifest, small configuration files, item lists, metrics and fixtures."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import text as X

FORMAT = 1
ITEM = "id string, text string, source string"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_snapshot(tables: dict[str, DataFrame], manifest: DataFrame, folder: str, version: int = FORMAT) -> None:
    """Write tables and the manifest (path, digest) they were made from to `folder`/v`version`. The manifest comes
    last, after a new folder has taken the old one's place, so a broken write leaves no snapshot."""
    spark = manifest.sparkSession
    new, fs = _path(spark, f"{folder}/v{version}.new")
    old, _ = _path(spark, f"{folder}/v{version}")
    fs.delete(new, True)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/v{version}.new/{name}")
    manifest.select("path", "digest").write.parquet(f"{folder}/v{version}.new/_manifest_")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not publish {folder}/v{version}")


def read_snapshot(spark: SparkSession, folder: str, manifest: DataFrame, version: int = FORMAT) -> dict[str, DataFrame] | None:
    """The tables of a snapshot, or None where there is none of this version or the files (path, digest) have changed."""
    at, fs = _path(spark, f"{folder}/v{version}")
    if not fs.exists(at):
        return None
    held = spark.read.parquet(f"{folder}/v{version}/_manifest_")
    now = manifest.select("path", "digest")
    if not held.exceptAll(now).isEmpty() or not now.exceptAll(held).isEmpty():
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {n: spark.read.parquet(f"{folder}/v{version}/{n}") for n in names if n != "_manifest_"}


def purge_snapshots(spark: SparkSession, folder: str, version: int = FORMAT) -> list[str]:
    """Delete snapshots of other versions; the names of what is gone."""
    at, fs = _path(spark, folder)
    stale = [s.getPath() for s in fs.listStatus(at) if re.fullmatch(r"v\d+(\.new)?", s.getPath().getName()) and s.getPath().getName() != f"v{version}"]
    for p in stale:
        fs.delete(p, True)
    return sorted(p.getName() for p in stale)


def read_items(spark: SparkSession, path: str, most: int = 60, size: int = 1024 * 1024) -> DataFrame:
    """id, text, source of a JSON list of items. The file must hold at most `size` bytes and `most` items, each with
    an id of 1 to 200 UTF-16 units that no other has, a text that is not blank, and a source that is text or absent;
    else it is refused as a whole. Other fields are left out."""
    raw = spark.read.format("binaryFile").load(path).select("length", F.make_valid_utf8(F.col("content").cast("string")).alias("t"))
    got = raw.select("length", F.from_json("t", "array<struct<id: variant, text: variant, source: variant>>").alias("l")).limit(2).collect()
    if len(got) != 1 or got[0]["length"] > size or got[0]["l"] is None or len(got[0]["l"]) > most:
        raise ValueError("not a list of items within the limits")
    text = lambda c: F.try_variant_get(c, "$", "string")
    typed = lambda c: F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(False))
    items = raw.select(F.explode(F.from_json("t", "array<struct<id: variant, text: variant, source: variant>>")).alias("i"))
    good = typed(F.col("i.id")) & typed(F.col("i.text")) & (F.col("i.source").isNull() | typed(F.col("i.source")))
    items = items.select(text("i.id").alias("id"), text("i.text").alias("text"), text("i.source").alias("source"), good.alias("good"))
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"[\s\x{00a0}\x{feff}]+", "") == "", F.lit(True))
    bad = items.agg(F.count_if(~F.col("good") | blank("id") | blank("text") | (X.utf16_length("id") > 200)).alias("bad"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("twice")).first()
    if bad["bad"] or bad["twice"]:
        raise ValueError("items need an id of their own, a text, and a source that is text")
    return items.drop("good")


def record_metrics(metrics: DataFrame, folder: str) -> bool:
    """Append rows as JSON lines; a failure is told by the result and never raised, so that no search fails by it."""
    try:
        metrics.write.mode("append").json(folder)
    except Exception:  # whatever the sink's trouble is
        return False
    return True


def plain_json(text: str) -> str:
    """JSON with comments and trailing commas as JSON without them; what stands in strings stays."""
    piece = re.compile(r"\"(?:\\.|[^\"\\])*\"|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
    bare = piece.sub(lambda m: m.group() if m.group()[0] == '"' else " ", text)
    return re.sub(r"\"(?:\\.|[^\"\\])*\"|,(?=\s*[}\]])", lambda m: "" if m.group() == "," else m.group(), bare)


CONFIG = T.StructType([T.StructField("base_url", T.StringType()), T.StructField("paths", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("extends", T.BooleanType())])


@F.pandas_udf(CONFIG)
def module_config(text: pd.Series) -> pd.DataFrame:
    """STRUCT<base_url, paths, extends> of the compiler settings of a project file; nulls where it is no such file."""

    def read(t: str | None) -> tuple:
        try:
            top = json.loads(plain_json(t or ""))
            options = top.get("compilerOptions") or {}
            paths = {k: [x for x in v if isinstance(x, str)] for k, v in (options.get("paths") or {}).items() if isinstance(v, list)}
            base = options.get("baseUrl")
            return base if isinstance(base, str) else None, paths, "extends" in top
        except (ValueError, AttributeError):
            return None, None, None

    return pd.DataFrame([read(t) for t in text], columns=[f.name for f in CONFIG.fields])


def stale_gold(gold: DataFrame, files: DataFrame) -> DataFrame:
    """Gold rows (path, sha256) whose file is gone or has another digest (files: path, digest); a run on them must stop."""
    now = files.select("path", F.col("digest").alias("__now"))
    return gold.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("__now"))).drop("__now")
