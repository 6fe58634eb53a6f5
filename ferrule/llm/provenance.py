"""Files that people of the project did not write: generated, minified, vendored, or data saved as code.

Three kinds of evidence are joined for each file. Place: every directory of every repository gets a Merkle
hash, built level by level from the hashes of the files and directories in it; a subtree of several files that
stands in unrelated repositories is vendored, whatever it is called, and so are the customary folders. A
file's hash is over its lines of code without comments, imports and blanks, so other banners, versions and
line ends don't part copies. Headers: what generators and copied libraries say of themselves at the beginning
of a comment. Layout: lines of a few shapes repeated throughout, lines of a minifier, rows of numbers or
encoded strings.

A directory's hash is a sum over its children of their scrambled (label, hash), so no directory's children are
gathered in one place: each level is one aggregation with partial sums over the level below.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import materialize, spread

#: Folders for copies of other projects, and names that generators and bundlers give.
VENDOR_FOLDERS = r"(^|/)(vendor|third[_-]?party|Pods|Carthage|extern|externals?|node_modules|bower_components|jspm_packages|deps|Godeps|site-packages|dist-packages)/"
MADE_NAMES = r"(\.min\.(js|css)$|\.(generated|gen|g|designer)\.\w+$|_pb2(_grpc)?\.pyi?$|\.pb\.(go|cc|h|rb)$|_(gen|generated)\.\w+$|[.-](?=[0-9a-f]*\d)[0-9a-f]{8,20}\.(js|css)$|_OuterClass\.)"
CODE_NAMES = r"\.(py|pyi|ts|tsx|js|jsx|mjs|cjs|rs|go|java|kt|rb|php|c|h|cc|cpp|hpp|cs|swift|scala|css|scss)$"

_COMMENT = r"(?m)^[ \t]*(?:/\*+!?|//+!?|#+|\*|--|;+|<!--|\"\"\"|%+)[ \t]*-*[ \t]*"
_MADE = r"(?:generated|produced|written|created|built|emitted|rendered|compiled)"
_THIS = r"(?:this (?:file|code|module|class) (?:is|was|has been) |code |file )?"
#: What a generator says: that, and by, from or out of what, the file was made; or that edits of it get lost.
HEADER = re.compile(
    _COMMENT
    + r"(?i:"
    + r"(?:" + _THIS + r"(?:auto(?:matically)?|machine)[- ]?" + _MADE + r"|" + _THIS + r"generated (?:by|from|on|with|using|at|file|code))\b(?! hand\b)(?!.{0,60}\b(?:skipped|ignored|rejected|by hand)\b)"
    + r"|" + _THIS + _MADE + r" by (?!hand\b|the\b|a\b|an\b|our\b)\S+ (?:out of|from)\b"
    + r"|<auto-?generated|@generated\b"
    + r"|(?:begin|start)(?: of)? \S+ (?:output|generated)\b"
    + r"|(?:automatisch|maschinell) (?:erzeugt|generiert)|(?:généré|généree?) automatiquement|generado automáticamente"
    + r"|do not (?:edit|modify)(?:[.,;!]| this| by hand| manually|\s*$)"
    + r"|.{0,120}\b(?:hand|manual|your) (?:edits|changes) (?:are|will be|get) (?:lost|overwritten|discarded)"
    + r"|.{0,120}\bchanges (?:made )?(?:here )?will be (?:lost|overwritten|discarded)"
    + r")"
)
_RELEASE = r"(?:@[0-9a-f]{6,}|\bv?\d+(?:\.\d+)+)"
#: What a copied file says: where it was taken from, and the release; or the licence terms of its authors.
COPIED = re.compile(
    _COMMENT
    + r"(?:"
    + r"(?i:(?:imported|copied|vendored|taken|adapted|bundled|forked|ported|extracted|based) (?:\w+ )?(?:from|here|on|in)\b[^\n]{0,60}?" + _RELEASE + r")"
    + r"|(?i:part of the \S+ (?:library|project|package|framework)\b[^\n]{0,20}?" + _RELEASE + r")"
    + r"|(?i:redistribution and use in source and binary forms)"
    + r"|\S+ v?\d+(?:\.\d+)+ (?:--|-|\|) https?://"
    + r"|/?!?\s*@(?:license|preserve)\b"
    + r")"
)
#: Whose a file is; one with the name of the repository itself is no copy.
HOLDER = re.compile(_COMMENT + r"(?i:spdx-filecopyrighttext:\s*(?:\(c\)\s*|\d{4}(?:-\d{4})?,?\s*)*|copyright (?:\(c\) |© )?\d{4}(?:-\d{4})?,?\s*(?:the )?)(?P<who>[^\n,]{1,60}?)\s*(?i:contributors|authors|project|developers)\b")
_BANNER = re.compile(r"\A\s*/\*!? ?\w[\w.-]* v\d+(?:\.\d+)+ ?\*/")
_MAP = re.compile(r"(?m)^(?://|/\*)[#@] ?sourceMappingURL=\S+")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")
_NUMBER = re.compile(r"\b\d[\w.]*")
_NAME = re.compile(r"[^\W\d]\w*")
_IGNORED = re.compile(r"(?:import|from|use|using|require|require_relative|#include|package|const \w+ = require|include)\b|#include|//|# |/\*|\* |--|<!--")
_DATA_ROW = re.compile(r"(?m)^[ \t]*(?:(?:-?(?:0[xX][0-9a-fA-F]+|\d[\d.eE_]*)[uUlLfF]*[ \t]*,?[ \t]*){4,}|[bru]?\"[A-Za-z0-9+/=_\-\\]{32,}\"[ \t]*[+,.\;)]*|(?:[A-Za-z0-9+/]{48,}={0,2})|\S[^\n\"]*\"[A-Za-z0-9+/=]{160,}\"[^\n\"]*)\r?$")


def says_vendored(text: str, workspace: str | None) -> bool:
    """Whether a comment names another project as where the text is from."""
    if COPIED.search(text):
        return True
    own = set(re.findall(r"[a-z0-9]+", (workspace or "").lower()))
    return any(not set(re.findall(r"[a-z0-9]+", m["who"].lower())) & own for m in HOLDER.finditer(text))


def code_lines(text: str) -> list[str]:
    """The lines that hold code: trimmed, without blank ones, comments and imports."""
    lines = (x.strip() for x in text.split("\n"))
    return [x for x in lines if len(x) > 2 and not _IGNORED.match(x)]


#: Judged are the shares of a file's commonest shapes, those with at least so many lines.
COMMONEST, LEAST_ALIKE = 4, 4
SUMS = ("chars", "lines", "blanks", "data", "h1", "h2")
FLAGS = ("header", "copied", "bundled")


def signals(text: str, start_line: int, code: bool, workspace: str | None = None) -> tuple[tuple[int, ...], list[str]]:
    """((header, copied, bundled, chars, lines, blanks, data), the lines of code) of one chunk. The numbers add
    up over a file's chunks, however it is cut. data: characters in data rows."""
    header, copied = int(HEADER.search(text) is not None), int(says_vendored(text, workspace))
    if not code:
        return (header, copied, 0, 0, 0, 0, 0), []
    bundled = int(_MAP.search(text) is not None or start_line == 1 and _BANNER.match(text) is not None)
    lines = sum(1 for x in text.split("\n") if x and not x.isspace())
    blanks = text.count(" ") + text.count("\t")
    data = sum(m.end() - m.start() for m in _DATA_ROW.finditer(text))
    return (header, copied, bundled, len(text), lines, blanks, data), code_lines(text)


def shape_of(line: str) -> str:
    return _NAME.sub("a", _NUMBER.sub("9", _STRING.sub("9", line)))


def _hashes(lines: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(lines, dtype=object), categorize=False) if lines else np.zeros(0, np.uint64)


def file_signals(chunks: DataFrame) -> DataFrame:
    """One row for each file: workspace, path, code, FLAGS, SUMS, body (lines of code), repeated (those of its
    commonest shapes, all chunks of the file together).

    h1 and h2 are the content hash: sums of two halves of the hashes of the lines of code, so chunks may come in
    any order and be cut anywhere. Null texts count as empty; rows with a null path are ignored; a null
    start_line is 1.
    """
    slim = chunks.where("path IS NOT NULL").select("workspace", "path", F.coalesce("start_line", F.lit(1)).alias("l"), F.coalesce("text", F.lit("")).alias("t"), F.col("path").rlike(CODE_NAMES).alias("code"))
    counted = [*FLAGS, *SUMS]
    names = ["workspace", "path", "code", "shape", "n", "filled", *counted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            workspaces = batch.column(0).to_pylist()
            row, shape, n, filled, sums = [], [], [], [], []
            for i, (w, line, text, code) in enumerate(zip(workspaces, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                numbers, body = signals(text, line, code, w)
                whole = _hashes(body)
                sums.append((*numbers[:3], *numbers[3:], int((whole & np.uint64(0xFFFFFFFF)).sum()), int((whole >> np.uint64(32)).sum())))
                shapes = Counter(map(shape_of, body))
                row += [i] * (len(shapes) + 1)
                shape += [None, *_hashes(list(shapes)).view(np.int64).tolist()]
                n += [0, *shapes.values()]
                # Shapes without a number or a text in them are what hand-written code repeats as well.
                filled += [False, *("9" in x or x.count("a") >= 4 for x in shapes)]
            at = pa.array(row, pa.int64())
            first = np.r_[True, np.diff(row) > 0] if row else np.zeros(0, bool)  # a chunk's numbers stand in its first row
            numbers = np.where(first[:, None], np.array(sums, np.int64).reshape(-1, len(counted))[row], 0) if row else np.zeros((0, len(counted)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(4).take(at), pa.array(shape, pa.int64()), pa.array(n, pa.int64()), pa.array(filled, pa.bool_()), *[pa.array(numbers[:, i]) for i in range(len(counted))]], names=names)

    each = spread(slim).mapInArrow(run, "workspace string, path string, code boolean, shape long, n long, filled boolean, " + ", ".join(f"{c} long" for c in counted))
    own = [F.max(c).alias(c) for c in ("code", *FLAGS)] + [F.sum(c).alias(c) for c in SUMS]
    shapes = each.groupBy("workspace", "path", "shape").agg(F.sum("n").alias("n"), F.max("filled").alias("filled"), *own)
    place = F.row_number().over(Window.partitionBy("workspace", "path").orderBy(F.desc("n"), "shape"))
    common = (F.col("n") >= LEAST_ALIKE) & (F.col("place") <= COMMONEST)
    files = shapes.withColumn("place", place).groupBy("workspace", "path").agg(
        *own, F.sum("n").alias("body"), F.coalesce(F.sum(F.when(common, F.col("n"))), F.lit(0)).alias("alike"), F.coalesce(F.sum(F.when(common & F.col("filled"), F.col("n"))), F.lit(0)).alias("told")
    )
    return files.withColumn("repeated", F.when(F.col("told") >= 0.4 * F.col("alike"), F.col("alike")).otherwise(F.col("told"))).drop("alike", "told")


def _mixed(*columns: str | Column) -> tuple[Column, Column]:
    """Two halves of a 64-bit hash, to be summed without overflow."""
    h, half = F.xxhash64(*columns), F.lit(2**32)
    return F.pmod(h, half).alias("a"), F.pmod(F.shiftright(h, 32), half).alias("b")


def shared_subtrees(files: DataFrame, least_files: int = 2, least_lines: int = 4) -> DataFrame:
    """workspace and dir of every directory whose subtree, of at least `least_files` files with at least
    `least_lines` lines of code together, stands with an equal hash in more than one workspace.

    files: workspace, path, h1, h2, body. The hash of a directory is made of those of its children: of its
    files' contents (their names aside, as copies get renamed) and of its directories, the name of which counts,
    versions aside. Files without code count for nothing.
    """
    parts = F.split("path", "/")
    leaf = files.where((F.col("body") > 0) & (F.size(parts) > 1)).select("workspace", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), *_mixed(F.lit("file"), "h1", "h2"), F.lit(1).cast("long").alias("files"), F.col("body").alias("lines"))
    sums = [F.sum(c).alias(c) for c in ("a", "b", "files", "lines")]
    held = materialize(leaf.groupBy("workspace", "dir").agg(*sums).withColumn("depth", F.size(F.split("dir", "/"))), "leaves")
    deepest = held.agg(F.max("depth")).first()[0] or 0
    level, levels = None, []
    for depth in range(deepest, 0, -1):
        here = held.where(F.col("depth") == depth).drop("depth")
        if level is not None:
            name = F.regexp_replace(F.substring_index("dir", "/", -1), r"[-_@.]?v?\d+(?:\.\d+)*$", "")
            up = level.select("workspace", F.regexp_replace("dir", "/[^/]*$", "").alias("dir"), *_mixed(F.lit("dir"), name, "a", "b", "files"), "files", "lines")
            here = here.unionByName(up).groupBy("workspace", "dir").agg(*sums)
        level = materialize(here, f"level{depth}")
        levels.append(level)
    if not levels:
        return held.select("workspace", "dir")
    dirs = levels[0]
    for other in levels[1:]:
        dirs = dirs.unionByName(other)
    dirs = dirs.where((F.col("files") >= least_files) & (F.col("lines") >= least_lines))
    shared = dirs.groupBy("a", "b", "files").agg(F.min("workspace").alias("lo"), F.max("workspace").alias("hi")).where("lo <> hi").select("a", "b", "files")
    return dirs.join(shared, ["a", "b", "files"], "left_semi").select("workspace", "dir")


def foreign_files(chunks: DataFrame) -> DataFrame:
    """The evidence on each file: workspace, path, generated, minified, vendored, data, subtree, foreign, all
    BOOLEAN.

    subtree: below a directory that stands in another workspace as well; such files are vendored. foreign is
    the union of the first four. A file is judged as a whole from all its chunks, however it was cut. An empty
    table gives an empty result; repeated rows change sums and shares alike, so they change nothing.
    """
    files = materialize(file_signals(chunks), "files")
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = files.where(F.size(parts) > 1).select("workspace", "path", F.explode(ancestors).alias("dir"))
    shared = below.join(shared_subtrees(files), ["workspace", "dir"], "left_semi").select("workspace", "path").distinct().withColumn("subtree", F.lit(True))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    data = F.col("code") & (share("data", "chars") > 0.8) & (F.col("chars") > 400)
    minified = F.col("code") & ((share("chars", "lines") > 150) & (share("blanks", "chars") < 0.14) & (F.col("chars") > 300) | (F.col("bundled") > 0))
    repeated = F.col("code") & (share("repeated", "body") > 0.8) & (F.col("body") >= 12)
    named = F.col("path").rlike(MADE_NAMES)
    judged = files.join(shared, ["workspace", "path"], "left").select(
        "workspace",
        "path",
        ((F.col("header") > 0) | repeated & ~data | named & F.col("code")).alias("generated"),
        (minified & ~data).alias("minified"),
        ((F.col("copied") > 0) & F.col("code") | F.col("path").rlike(VENDOR_FOLDERS) | F.coalesce("subtree", F.lit(False))).alias("vendored"),
        data.alias("data"),
        F.coalesce("subtree", F.lit(False)).alias("subtree"),
    )
    return judged.withColumn("foreign", F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data"))
