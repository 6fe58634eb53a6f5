"""Index statistics: postings, document frequencies, field sizes, symbols and their reference weights.

Tokens, symbols and identifiers come from Arrow stages: of a text each word is split once, where the column
functions of `functions.text` run three patterns over every text (measured on 23 MB of code: 155 against
1,200 CPU seconds a GB). A document's terms are counted where they are found, so postings need no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import text as X
from ferrule.functions.stem import porter
from ferrule.session import small_side, spread

# How declarations look. One group of a match holds the declared name.
SYMBOL = r"(?m)^\s*(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|export|default|public|private|protected|static|final|override|abstract|internal|open|suspend|sealed|data|declare|readonly)\s+)*(?:(?:fn|function\*?|def|fun)\s+([A-Za-z_][A-Za-z0-9_]*)|func\s+(?:\([^\n)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)|(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^\n)]*\)\s*=>|[A-Za-z_][A-Za-z0-9_]*\s*=>|\([^\n)]*$)|(?:class|struct|enum|interface|trait|module|object|protocol|record|union)\s+([A-Za-z_][A-Za-z0-9_]*)|impl(?:<[^>\n]*>)?\s+(?:[A-Za-z_][A-Za-z0-9_:<>, ]*\s+for\s+)?([A-Za-z_][A-Za-z0-9_]*)|type\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:<[^>\n]*>)?\s*=)"
TYPED_SYMBOL = r"(?m)^[ \t]*(?:[A-Za-z_][A-Za-z0-9_.<>,?\[\]:*&]*[ \t]+)+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\([^;\n]*\)[ \t]*(?:\{|throws\b)"

_HUMPS, _STEPS, _WORDS = re.compile(r"([A-Z]+)([A-Z][a-z])"), re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"[a-z0-9]+")
_NAMES = re.compile(r"[A-Za-z0-9_]+")


def tokens_of(text: str) -> list[str]:
    """What `functions.text.tokens` gives for a text."""
    return _WORDS.findall(_STEPS.sub(r"\1 \2", _HUMPS.sub(r"\1 \2", text)).lower())


def _each(df: DataFrame, keep: list[str], text: str, read: Callable[[str | None], tuple[list, ...]], fields: list[T.StructField]) -> DataFrame:
    """For each row its kept columns with every row of columns that `read` finds in the text."""
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if f.dataType == T.IntegerType() else pa.string() for f in fields]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [read(t) for t in part.column(n).to_pylist()]
                rows = pa.array([i for i, g in enumerate(got) for _ in g[0]], pa.int64())
                columns = [pa.array(list(chain.from_iterable(g[c] for g in got)), types[c]) for c in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(rows) for c in range(n)], *columns], names=schema.names)

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, schema)


def _count(text: str | None) -> tuple[list, ...]:
    found = tokens_of(text) if text is not None else []
    counts = Counter(found)
    n = len(counts) + 1
    return ["", *counts], [0, *counts.values()], [len(found)] * n


def postings(docs: DataFrame, key: str, text: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """key, the kept columns, term, tf, len (tokens of the document); and for each document, also an empty one, a
    row of the empty term with tf 0, from which sizes and their number are read. Nothing is shuffled."""
    docs = docs.select(F.col(key).alias("key"), *keep, F.col(text).alias("__x"))
    fields = [T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("len", T.IntegerType())]
    return _each(docs, ["key", *keep], "__x", _count, fields)


STEMS: dict[str, str] = {}


def _stems(words: list[str]) -> list[str]:
    """The stems of words; a task remembers those it has seen."""
    new = set(words).difference(STEMS)
    if new:
        if len(STEMS) > 500_000:  # emptied when full
            STEMS.clear()
            new = set(words)
        STEMS.update((w, porter(w)) for w in new)
    return [STEMS[w] for w in words]


FIELDS = ("content", "path", "symbol")


def build(chunks: DataFrame, scope: str | None = None, stemmed: bool = False, with_symbols: bool = True) -> DataFrame:
    """All postings of chunks in one pass over their texts: field (see FIELDS), chunk_id, place, name, the scope
    column, term, tf, len, and a row of the empty term for each document.

    The path is a document for each of its chunks; each declared name is one of its own, with its place in the
    chunk, the others have place -1 and no name. Written once, an index serves any number of questions.
    """
    keep = [scope] * bool(scope)
    schema = T.StructType(
        [T.StructField("field", T.StringType()), chunks.schema["chunk_id"], *[chunks.schema[c] for c in keep], T.StructField("place", T.IntegerType()), T.StructField("name", T.StringType())]
        + [T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("len", T.IntegerType())]
    )
    code, typed = X.is_code_path("path"), F.col("path").rlike(X.TYPED_PATH)
    slim = chunks.select("chunk_id", *keep, "path", "text", F.when(typed & code, 2).when(code, 1).otherwise(0).alias("__kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = {1: _names_by(SYMBOL), 2: _names_by(TYPED_SYMBOL)}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, field, place, name, term, tf, size = [], [], [], [], [], [], []

                def add(i: int, f: str, p: int, n: str | None, text: str | None) -> None:
                    found = tokens_of(text) if text is not None else []
                    counts = Counter(_stems(found) if stemmed else found)
                    k = len(counts) + 1
                    for column, value in ((rows, i), (field, f), (place, p), (name, n), (size, len(found))):
                        column.extend([value] * k)
                    term.extend(["", *counts])
                    tf.extend([0, *counts.values()])

                texts, paths, kinds = (part.column(c).to_pylist() for c in ("text", "path", "__kind"))
                for i, (text, path, kind) in enumerate(zip(texts, paths, kinds)):
                    add(i, "content", -1, None, text)
                    add(i, "path", -1, None, path)
                    if with_symbols and kind:
                        for p, n in enumerate(named[kind](text)[0]):
                            add(i, "symbol", p, n, n)
                taken = [part.column(c).take(pa.array(rows, pa.int64())) for c in ("chunk_id", *keep)]
                yield pa.RecordBatch.from_arrays([pa.array(field, pa.string()), *taken, pa.array(place, pa.int32()), pa.array(name, pa.string()), pa.array(term, pa.string()), pa.array(tf, pa.int32()), pa.array(size, pa.int32())], names=schema.names)

    return spread(slim).mapInArrow(run, schema)


def asked_postings(docs: DataFrame, key: str, texts: list[str], terms: list[str]) -> DataFrame:
    """key and, for the k-th text column, ids{k} (places in `terms`), tfs{k}, len{k} (all tokens): a row a document, so
    its postings stay together. Other terms are counted in len only; documents without any are kept for their sizes."""
    whole = T.ArrayType(T.IntegerType(), False)
    fields = [f for k in range(len(texts)) for f in (T.StructField(f"ids{k}", whole), T.StructField(f"tfs{k}", whole), T.StructField(f"len{k}", T.IntegerType()))]
    slim = docs.select(F.col(key).alias("key"), *[F.col(t).alias(f"__text{k}") for k, t in enumerate(texts)])
    schema = T.StructType([slim.schema["key"], *fields])
    place = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = [part.column(0)]
                for k in range(len(texts)):
                    ids, tfs, ends, size = [], [], [0], []
                    for text in part.column(k + 1).to_pylist():
                        found = tokens_of(text) if text is not None else []
                        for t, n in Counter(found).items():
                            if t in place:
                                ids.append(place[t])
                                tfs.append(n)
                        ends.append(len(ids))
                        size.append(len(found))
                    ends = pa.array(ends, pa.int32())
                    columns += [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spread(slim).mapInArrow(run, schema)


def term_frequencies(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """key, term, tf, len (tokens of the document). With `terms` (term) only those terms are kept, while `len`
    still counts all tokens."""
    rows = postings(docs, key, text).where("term <> ''").withColumn("tf", F.col("tf").cast("long"))
    return rows if terms is None else rows.join(small_side(terms.select("term").distinct()), "term", "left_semi").select("key", "term", "tf", "len")


def sizes(made: DataFrame) -> DataFrame:
    """n and total_len of postings, one row."""
    return made.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))


def field_stats(docs: DataFrame, text: str) -> DataFrame:
    """n and total_len of a field, one row."""
    return sizes(postings(docs.withColumn("__key", F.lit(0)), "__key", text))


def _names_by(pattern: str) -> Callable[[str | None], tuple[list, ...]]:
    compiled = re.compile(pattern, re.ASCII)

    def read(text: str | None) -> tuple[list, ...]:
        found = [m[m.lastindex] for m in compiled.finditer(text or "")]
        return found, list(range(len(found)))

    return read


def declared(df: DataFrame, keep: list[str], pattern: str, text: str = "text") -> DataFrame:
    """The kept columns, name and place INT (from 0) of each match of a pattern with one name a match."""
    return _each(df, keep, text, _names_by(pattern), [T.StructField("name", T.StringType()), T.StructField("place", T.IntegerType())])


def symbols(chunks: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """chunk_id, path, the kept columns, name, place: the names that chunks of code declare, each occurrence a row.
    Languages with types before names are read by `TYPED_SYMBOL`, the others by `SYMBOL`."""
    code = chunks.where(X.is_code_path("path"))
    typed = F.col("path").rlike(X.TYPED_PATH)
    keep = ["chunk_id", "path", *keep]
    return declared(code.where(~typed), keep, SYMBOL).unionByName(declared(code.where(typed), keep, TYPED_SYMBOL))


def _identifiers(text: str | None) -> tuple[list, ...]:
    return (list(dict.fromkeys(_NAMES.findall(text or ""))),)


def words_of(chunks: DataFrame, keep: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """The kept columns and name: the distinct runs of ASCII letters, digits and underscores of each chunk."""
    return _each(chunks, keep, "text", _identifiers, [T.StructField("name", T.StringType())])


def identifiers(chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """path, name: the distinct identifiers of each file of code; with `names` (name) only those, which are looked
    up before anything is shuffled."""
    found = words_of(chunks.where(X.is_code_path("path")))
    if names is not None:
        found = found.join(small_side(names.select("name").distinct()), "name", "left_semi")
    return found.select("path", "name").distinct()


def reference_weights(names: DataFrame, idents: DataFrame) -> DataFrame:
    """path, name, weight = 1 + min(ln(1 + files that name it, its own aside), 2) of declared names.

    idents: path, name, at least of the declared names."""
    files = idents.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    own = idents.withColumn("own", F.lit(1))
    j = names.select("path", "name").distinct().join(files, "name", "left").join(own, ["path", "name"], "left")
    others = F.coalesce("files", F.lit(0)) - F.coalesce("own", F.lit(0))
    return j.select("path", "name", (1 + F.least(F.log1p(others.cast("double")), F.lit(2.0))).alias("weight"))
