"""Imports over several lines, modules they name, and the definitions they bring in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import source

#: What a module's name may stand for, in order.
ENDINGS = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]


def import_lines(files: DataFrame) -> DataFrame:
    """path, line of every line that belongs to an import, of files or their parts (path, start_line, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, line = [], []
            for i, (path, start, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                got = source.import_lines(path, re.split(r"\r\n|\r|\n", text))
                rows += [i] * len(got)
                line += [start + k for k in got]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(line, pa.int32())], names=["path", "line"])

    return files.where("path IS NOT NULL AND text IS NOT NULL").select("path", F.coalesce(F.col("start_line").cast("int"), F.lit(1)), "text").mapInArrow(run, "path string, line int")


def code_only(files: DataFrame) -> DataFrame:
    """The same rows (path, start_line, text) with comments and strings blanked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else source.blanked(p, t) for p, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["path", "start_line", "text"])

    return files.where("path IS NOT NULL").select("path", F.col("start_line").cast("int"), "text").mapInArrow(run, "path string, start_line int, text string")


def normalized(path: str | Column) -> Column:
    """A path without empty, . and .. parts; null where it leads above its root."""
    p = F.col(path) if isinstance(path, str) else path
    start = F.array().cast("array<string>")
    step = lambda acc, x: (
        F.when(acc.isNull() | (x == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when((x == "") | (x == "."), acc)
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x))
    )
    return F.array_join(F.aggregate(F.split(p, "/"), start, step), "/")


def modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, specifier, module: the file that a relative specifier (./x, ../x, .x, ..x) names, the first of `ENDINGS`
    that exists; null where none does, or where the specifier is not relative."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    dots = F.length(F.regexp_extract("specifier", r"^(\.+)[A-Za-z_]", 1))
    python = F.concat_ws("/", folder, F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/"), F.regexp_replace(F.regexp_replace("specifier", r"^\.+", ""), r"\.", "/"))
    target = F.when(F.col("specifier").rlike(r"^\.\.?/"), F.concat_ws("/", folder, F.col("specifier"))).when(dots > 0, python)
    i = imports.select("path", "specifier").distinct().withColumn("t", normalized(target))
    named = i.where("t IS NOT NULL").select("path", "specifier", F.posexplode(F.array(*[F.concat("t", F.lit(e)) for e in ENDINGS])).alias("o", "module"))
    found = named.join(files.select(F.col("path").alias("module")).distinct(), "module", "left_semi")
    best = found.groupBy("path", "specifier").agg(F.min_by("module", "o").alias("module"))
    return i.drop("t").join(best, ["path", "specifier"], "left")


def imported_definitions(imports: DataFrame, files: DataFrame, definitions: DataFrame) -> DataFrame:
    """path, specifier, name, module, start_line, end_line: the exported definition that an imported name (path,
    specifier, name) stands for; only where the module has exactly one, so none is guessed."""
    m = modules(imports, files).where("module IS NOT NULL")
    d = definitions.where("exported").select(F.col("path").alias("module"), "name", "start_line", "end_line")
    one = d.groupBy("module", "name").agg(F.count(F.lit(1)).alias("n"), F.first("start_line").alias("start_line"), F.first("end_line").alias("end_line")).where("n = 1").drop("n")
    return imports.select("path", "specifier", "name").distinct().join(m, ["path", "specifier"]).join(one, ["module", "name"]).select("path", "specifier", "name", "module", "start_line", "end_line")
