"""Relational questions on code lines: who uses a name, what depends on it, which tests cover it, what is unused."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.session import materialize

# Names that frameworks call.
ENTRY_POINTS = [
    "main", "init", "new", "String", "Error", "ServeHTTP", "MarshalJSON", "UnmarshalJSON", "MarshalText", "UnmarshalText",
    "Close", "Read", "Write", "Len", "Less", "Swap", "Reset", "setUp", "tearDown", "setup",
    "teardown", "__init__", "__str__", "__repr__", "__eq__", "__hash__", "__enter__", "__exit__", "__call__", "__iter__",
    "__next__", "__len__", "__getitem__", "__setitem__", "initialize", "to_s", "inspect", "call", "perform", "fmt",
    "drop", "default", "from", "into", "clone", "eq", "hash", "deref", "index", "run",
    "handle", "toString", "equals", "hashCode", "compareTo", "invoke", "apply", "accept", "get", "set",
]

#: Up to so many names are sent to the tasks as a set; more are joined.
SENT = 200_000
_WORD, _CALLED = re.compile(r"\w+"), re.compile(r"(\w+)[! ]*(?:::<[^>]*>?)?\(")


def word_uses(lines: DataFrame, names: DataFrame) -> DataFrame:
    """path, line, line_text, name, kind: lines that hold a name as a whole word, each once.

    lines: path, line, line_text; names: name. Words are runs of letters, digits and underscores.
    """
    wanted = materialize(names.select("name").where("name IS NOT NULL").distinct(), "names")
    sent = [r[0] for r in wanted.limit(SENT + 1).collect()]
    known = frozenset(sent) if len(sent) <= SENT else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, name, called = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = set(_WORD.findall(text or ""))
                found = found if known is None else found & known
                if found:
                    calls = set(_CALLED.findall(text)) if "(" in text else ()
                    rows += [i] * len(found)
                    name += found
                    called += [n in calls for n in found]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], pa.array(name, pa.string()), pa.array(called, pa.bool_())], names=["path", "line", "line_text", "name", "called"])

    hit = lines.select("path", "line", "line_text").mapInArrow(run, "path string, line int, line_text string, name string, called boolean")
    if known is None:
        hit = hit.join(wanted, "name", "left_semi")
    return hit.select("path", "line", "line_text", "name", X.usage_kind("path", "line_text", "called").alias("kind"))


def usage_counts(uses: DataFrame) -> DataFrame:
    """name, calls, imports, references, mentions, hidden_tests, hidden_docs: tests and docs are counted aside."""
    test, docs = X.is_test_path("path"), X.is_docs_path("path")
    shown = ~test & ~docs
    n = lambda c: F.count_if(c)
    return uses.groupBy("name").agg(
        n(shown & (F.col("kind") == "call")).alias("calls"),
        n(shown & (F.col("kind") == "import")).alias("imports"),
        n(shown & (F.col("kind") == "reference")).alias("refs"),
        n(shown & (F.col("kind") == "mention")).alias("mentions"),
        n(test).alias("hidden_tests"),
        n(~test & docs).alias("hidden_docs"),
    )


def used_by(uses: DataFrame) -> DataFrame:
    """name, path, is_test, uses, first_line."""
    return uses.groupBy("name", "path").agg(F.count(F.lit(1)).alias("uses"), F.min("line").alias("first_line")).withColumn("is_test", X.is_test_path("path"))


def dependents(uses: DataFrame) -> DataFrame:
    """name, area, path, first_line, first_text, more: uses by area and file, docs and mentions aside."""
    u = uses.where(~X.is_docs_path("path") & (F.col("kind") != "mention"))
    g = u.groupBy("name", "path").agg(F.min(F.struct("line", "line_text")).alias("f"), (F.count(F.lit(1)) - 1).alias("more"))
    return g.select("name", X.area_of("path").alias("area"), "path", F.col("f.line").alias("first_line"), F.col("f.line_text").alias("first_text"), "more")


def listing(uses: DataFrame, files: int = 12, rows: int = 40) -> DataFrame:
    """The shown rows of a usage listing: files by most uses, then path; at most so many files and rows a
    name. name, path, line, kind, place. The limits are the report's."""
    u = uses.where(~X.is_test_path("path") & ~X.is_docs_path("path") & (F.col("kind") != "mention"))
    n = u.groupBy("name", "path").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("f", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "path"))).where(F.col("f") <= files)
    w = Window.partitionBy("name").orderBy("f", "line")
    return u.join(n, ["name", "path"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows).select("name", "path", "line", "kind", "place")


def _named_for(path: str) -> Column:
    """The names that a test file's own name may be made of: with and without the marks of a test."""
    stem = _stem(path)
    marks = ("^test_", "_test$", "_spec$", "test$", "tests$", "^test")
    return F.filter(F.array_distinct(F.array(stem, *[F.regexp_replace(stem, m, "") for m in marks])), lambda c: F.length(c) >= 3)


def _stem(path: str) -> Column:
    return F.substring_index(F.lower(F.substring_index(path, "/", -1)), ".", 1)


def tests_for(uses: DataFrame, declared: DataFrame, paths: DataFrame, limit: int = 8) -> DataFrame:
    """name, defined_in, path, uses, line, confidence, rank: the tests of each definition (name, path).

    A test file named after the definition's file or its name has high confidence, even with no use of the
    name (uses 0, line null), any other that uses it medium; high ones and most uses come first, then the
    path. A line that declares what is tested is the cited one. The definition's own file is no test of it.
    """
    anchor = F.col("line_text").rlike(X.TEST_ANCHOR)
    g = uses.where(X.is_test_path("path")).groupBy("name", "path").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct(~anchor, F.col("line"))).alias("a"))
    g = materialize(g.select("name", "path", "uses", F.col("a.line").alias("line")), "tests")
    named = paths.select("path").distinct().where(X.is_test_path("path")).select("path", F.explode(_named_for("path")).alias("key"))
    d = declared.select("name", F.col("path").alias("defined_in")).distinct()
    keyed = d.select("*", F.explode(F.filter(F.array_distinct(F.array(_stem("defined_in"), F.lower("name"))), lambda c: F.length(c) >= 3)).alias("key"))

    def first(df, keys, order, n):
        return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= n).drop("n")

    # What cannot be among a definition's rows is cut before the joins, so no hot name meets all tests; one more
    # for the definition's own file, and for tests without a use those that have some.
    most = [F.desc("uses"), "path"]
    silent = keyed.join(first(named, ["key"], ["path"], 2 * limit + 1), "key").select("name", "defined_in", "path", F.lit(0).cast("long").alias("uses"), F.lit(None).cast("int").alias("line"), F.lit(True).alias("high"))
    spoken = keyed.join(first(g.join(named, "path"), ["name", "key"], most, limit + 1), ["name", "key"]).select(*silent.columns[:-1], F.lit(True).alias("high"))
    other = d.join(first(g, ["name"], most, limit + 1), "name").select(*silent.columns[:-1], F.lit(False).alias("high"))
    t = silent.unionByName(spoken).unionByName(other).where("path <> defined_in")
    t = t.groupBy("name", "defined_in", "path").agg(F.max("uses").alias("uses"), F.min("line").alias("line"), F.max("high").alias("high"))
    w = Window.partitionBy("name", "defined_in").orderBy(F.desc("high"), *most)
    return t.select("name", "defined_in", "path", "uses", "line", F.when(F.col("high"), "high").otherwise("medium").alias("confidence"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)


#: A name with so many uses is plainly used.
PLAINLY = 96


def unused(definitions: DataFrame, lines: DataFrame) -> DataFrame:
    """path, name, start_line, bucket of defined names with no use outside tests: tests_only, exported (nothing here
    uses it, but others may) or private. Each definition of a name is judged by itself.

    definitions: path, name, start_line, end_line, and exported, where that is known. Names under three letters, entry points, test names and
    names defined in tests are no candidates; lines of docs and comments are no uses, nor is the definition's own
    span. A name that is found nowhere at all, or in `PLAINLY` lines or more, is skipped.
    """
    d = definitions.where((F.length("name") >= 3) & ~F.col("name").isin(ENTRY_POINTS) & ~F.col("name").rlike("^(Test|test_)") & ~X.is_test_path("path"))
    exported = F.col("exported") if "exported" in d.columns else F.lit(False).alias("exported")
    d = materialize(d.select("path", "name", "start_line", "end_line", exported).distinct(), "candidates")
    code = lines.where(~X.is_docs_path("path") & ~X.is_comment("path", "line_text"))
    hits = materialize(word_uses(code, d).select("name", F.col("path").alias("upath"), F.col("line").alias("uline")), "hits")
    rare = hits.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < PLAINLY).select("name")  # so no name meets many uses
    own = (F.col("upath") == F.col("path")) & F.col("uline").between(F.col("start_line"), F.col("end_line"))
    test = X.is_test_path("upath")
    j = d.join(rare, "name").join(hits, "name").groupBy(*d.columns).agg(F.count_if(~own & ~test).alias("used"), F.count_if(~own & test).alias("tested"))
    return j.where("used = 0").select("path", "name", "start_line", F.when(F.col("tested") > 0, "tests_only").when(F.col("exported"), "exported").otherwise("private").alias("bucket"))
