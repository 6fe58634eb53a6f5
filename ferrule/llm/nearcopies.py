"""Near-copies by multi-index hashing over minwise fingerprints.

A text's fingerprint is a row of `segments` x `width` symbols, each the minimum of one hash function over
its word sequences; two texts agree in a symbol with a probability equal to their similarity. Every segment
has its own table, and a text is entered under the Hamming ball of its segment: the segment with any one
symbol left open, for two segments within distance 1 share such an entry. Texts that meet in any table are
candidates; of those only pairs whose complete fingerprints agree well enough are verified on the sets
themselves. Any two texts whose fingerprints differ in less than 2 x `segments` symbols meet for certain;
at similarity s they miss each other with probability (1 - s^w - w s^(w-1) (1-s))^segments, with the
defaults 0.3 % at 0.6, 0.01 % at 0.7.

Exact copies are one class with a member list, so a text that makes up a third of the corpus costs one
fingerprint. A table entry shared by more than `crowd` classes (texts with one licence header, say) is entered
again under 40 triples of further symbols, so that only classes that agree in more than the common part meet; at
similarity 0.6 a pair meets in none of them with a probability of 0.006 %. What is crowded even there is
compared block by block, on fingerprints in numpy, giving out agreeing pairs only; no group is ever held as a
whole or expanded into all its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import materialize, spread

_WORDS = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes the word sequences of texts; a word's hash is the same on every machine."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def _word_hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > 400_000:  # memory of a task; emptied, not capped
                known.clear()
                new = set(words)
            order = list(new)
            known.update(zip(order, pd.util.hash_array(np.array(order, dtype=object), categorize=False).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct hashes of each text's sequences; empty if it has fewer words than one takes."""
        split = [_WORDS(t.lower()) if t else [] for t in texts]
        h = self._word_hashes([w for ws in split for w in ws])
        out, at, k = [], 0, self.words
        for ws in split:
            x, n = h[at : at + len(ws)], len(ws) - k + 1
            at += len(ws)
            if n <= 0:
                out.append(np.zeros(0, np.uint64))
                continue
            s = x[:n]
            for i in range(1, k):
                s = _scramble(s * _MIX + x[i : i + n])
            out.append(np.unique(s))
        return out


    def ordered(self, text: str) -> np.ndarray:
        """Hashes of a text's words with their places."""
        h = self._word_hashes(_WORDS(text.lower()))
        return _scramble(h + np.arange(len(h), dtype=np.uint64) * _MIX)


def _digest(hashes: np.ndarray) -> int:
    """One number for a set of hashes, whatever their order."""
    mixed = np.bitwise_xor.reduce(_scramble(hashes + _MIX), keepdims=True) if len(hashes) else np.zeros(1, np.uint64)
    return int(_scramble(mixed + np.uint64(len(hashes)))[0]) - 2**63


def fingerprints(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """[text, symbol] UINT32: for each of `symbols` hash functions the smallest hash of the (nonempty) sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    flat = _scramble(np.concatenate(sets))
    low, high = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), symbols), np.uint32)
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 2**32, (symbols, 2), dtype=np.uint32) | np.uint32(1)
    for j in range(symbols):
        x = (low * factors[j, 0]) ^ (high * factors[j, 1])
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


def table_keys(prints: np.ndarray, segments: int, width: int) -> np.ndarray:
    """[text, segments x width] INT64: the entries of each text, one for every symbol left open."""
    p = prints.reshape(len(prints), segments, width).astype(np.uint64)
    out = np.empty((len(prints), segments, width), np.uint64)
    for skip in range(width):
        h = np.full((len(prints), segments), 0, np.uint64) + (np.arange(segments, dtype=np.uint64) * np.uint64(width) + np.uint64(skip))
        for i in range(width):
            if i != skip:
                h = _scramble(h * _MIX + p[:, :, i])
        out[:, :, skip] = h
    return out.reshape(len(prints), -1).view(np.int64)


TRIPLES = 40


def finer_keys(prints: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """[row, TRIPLES] INT64: an entry again with each of some triples of symbols, the same ones for all entries."""
    rng = np.random.default_rng(11)
    h = _scramble(entry.view(np.uint64))[:, None] * _MIX + np.arange(TRIPLES, dtype=np.uint64)
    for column in np.array([rng.choice(prints.shape[1], 3, replace=False) for _ in range(TRIPLES)]).T:
        h = _scramble(h * _MIX + prints[:, column].astype(np.uint64))
    return h.view(np.int64)


def _pieces(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _fixed(a: np.ndarray, per: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, per, dtype=np.int32)), pa.array(a.ravel()))


def similar_classes(
    df: DataFrame, key: str = "chunk_id", text: str = "text", similarity: float = 0.8, words: int = 5, segments: int = 14, width: int = 5, crowd: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members).

    pairs    rep_a < rep_b, similarity DOUBLE: classes of different texts whose word-sequence sets are at
             least `similarity` alike (shared over all); every link between different texts, given once.
    members  key, rep, shingles INT: the class of each row whose text is not null.
    Keys are unique LONGs. Null texts belong to no class; empty texts and those with fewer than `words`
    words form classes but no pairs. Words are runs of letters, digits and underscores in lower case. Whole
    texts count. An empty table gives empty results; other columns are ignored.
    """
    symbols = segments * width
    hashed = spread(df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("__k"), F.col(text).alias("__t")))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in _pieces(texts):
                sets = shingler.sets(texts[part])
                full = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
                made = fingerprints(full, symbols)
                # The set itself names the class: texts that differ only in separators have the same pairs.
                # Texts too short for a sequence are told apart by their words in order.
                digest = [_digest(s if len(s) else shingler.ordered(t)) for s, t in zip(sets, texts[part])]
                yield pa.RecordBatch.from_arrays([keys.slice(part.start, part.stop - part.start), pa.array(digest, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())], names=["key", "set", "shingles", "print"])

    marked = materialize(hashed.mapInArrow(prints, "key long, set long, shingles int, print binary"), "prints")
    return _pairs_of(marked, hashed, similarity, words, segments, width, crowd)


def _agreeing(a: np.ndarray, b: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) where rows of a and b agree in at least `least` symbols, a few rows at a time."""
    for i in range(0, len(a), 16):
        same = (a[i : i + 16, None, :] == b[None, :, :]).sum(axis=2)
        x, y = np.nonzero(same >= least)
        yield x + i, y


def _meetings(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """From (rep, entry) sorted by entry: (a, b, null) for each two classes of an entry with at most `crowd`
    classes, (rep, null, entry) for each class of a larger one. Holds one run of at most `crowd` and a batch."""
    rest_rep, rest_entry, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "entry"])

    def crowded(rep: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(entry)], names=["a", "b", "entry"])

    def runs(rep: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        size = np.diff(np.r_[start, len(entry)])
        for n in np.unique(size[size > 1]):
            at = start[size == n][:, None] + np.arange(n)[None, :]
            if n > crowd:
                yield crowded(rep[at.ravel()], entry[at.ravel()])
                continue
            x, y = np.triu_indices(n, 1)
            for part in range(0, len(at), max(1, 500_000 // len(x))):
                r = rep[at[part : part + max(1, 500_000 // len(x))]]
                yield out(r[:, x].ravel(), r[:, y].ravel())

    for batch in batches:
        rep = np.concatenate([rest_rep, batch.column(0).to_numpy(zero_copy_only=False)])
        entry = np.concatenate([rest_entry, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(entry):
            continue
        if over is not None:  # a run already known to be crowded goes on
            n = int(np.searchsorted(entry != over, True)) if entry[-1] != over else len(entry)
            if n:
                yield crowded(rep[:n], entry[:n])
            rep, entry = rep[n:], entry[n:]
            if not len(entry):
                rest_rep, rest_entry = rep, entry
                continue
            over = None
        last = int(np.searchsorted(entry, entry[-1]))  # the last run may go on
        yield from runs(rep[:last], entry[:last])
        rest_rep, rest_entry = rep[last:], entry[last:]
        if len(rest_rep) > crowd:
            yield crowded(rest_rep, rest_entry)
            over, rest_rep, rest_entry = rest_entry[0], rest_rep[:0], rest_entry[:0]
    if len(rest_entry):
        yield from runs(rest_rep, rest_entry)


#: Share of a block of classes from which an entry is hot, the least number of classes for that, and the
#: longest list of hot entries that is sent to the tasks.
HOT, HOT_LEAST, HOT_MOST = 0.02, 40, 100_000


def _pairs_of(marked: DataFrame, texts: DataFrame, similarity: float, words: int, segments: int, width: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    symbols = segments * width
    # Fingerprints of pairs at the threshold agree in similarity x symbols of them, within four deviations.
    least = max(1, int(np.floor(symbols * similarity - 4 * np.sqrt(symbols * similarity * (1 - similarity)))))
    reps = marked.groupBy("set", "shingles").agg(F.min("key").alias("rep"), F.min("print").alias("print"))
    reps = materialize(reps, "classes")
    member = marked.select("key", "set", "shingles").join(reps.select("set", "shingles", "rep"), ["set", "shingles"]).select("key", "rep", "shingles")
    reps = reps.where("shingles > 0")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, symbols)
                yield part.column(0).to_numpy(zero_copy_only=False), table_keys(made, segments, width)

    # An entry that holds the share HOT of all classes holds it in some block of 2,000 as well, so this finds every
    # such entry (of blocks under 2,000 those with HOT_LEAST classes); they go past the first shuffle. The list is
    # short unless copies stand side by side all over; its length is checked, and beyond it the shuffle takes them.
    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps_, entries in keys_of(batches):
            if len(reps_) >= HOT_LEAST:
                value, n = np.unique(entries, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value[n >= max(HOT_LEAST, HOT * len(reps_))])], names=["entry"])

    listed = reps.select("rep", "print").mapInArrow(heavy, "entry long").distinct().limit(HOT_MOST + 1).collect()
    hot = np.array(sorted(r[0] for r in listed) if len(listed) <= HOT_MOST else [], np.int64)  # beyond, streams handle them

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps_, entries in keys_of(batches):
            rep, flat = np.repeat(reps_, entries.shape[1]), entries.ravel()
            warm = np.isin(flat, hot, invert=True) if len(hot) else np.ones(len(flat), bool)
            yield pa.RecordBatch.from_arrays([pa.array(rep[warm]), pa.array(flat[warm])], names=["rep", "entry"])

    def hot_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps_, entries in keys_of(batches):
            rep, flat = np.repeat(reps_, entries.shape[1]), entries.ravel()
            at = np.isin(flat, hot)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(flat[at])], names=["rep", "entry"])

    # The tables: one shuffle by entry, then a stream over runs of equal entries.
    def meet(entries: DataFrame, name: str) -> DataFrame:
        runs = entries.repartition("entry").sortWithinPartitions("entry").mapInArrow(lambda it: _meetings(it, crowd), "a long, b long, entry long")
        return materialize(runs, name)

    meeting = meet(reps.select("rep", "print").mapInArrow(keys, "rep long, entry long"), "meetings")
    crowded = meeting.where("b IS NULL").select(F.col("a").alias("rep"), "entry")
    if len(hot):
        crowded = crowded.unionByName(reps.select("rep", "print").mapInArrow(hot_keys, "rep long, entry long"))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(part.num_rows, symbols)
                got = finer_keys(made, part.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), TRIPLES)), pa.array(got.ravel())], names=["rep", "entry"])

    again = meet(crowded.join(reps.select("rep", "print"), "rep").select("rep", "entry", "print").mapInArrow(finer, "rep long, entry long"), "finer")
    prints_ = reps.select("rep", "print", "shingles")
    small = meeting.where("b IS NOT NULL").select("a", "b").unionByName(again.where("b IS NOT NULL").select("a", "b")).distinct()
    small = small.join(prints_.select(F.col("rep").alias("a"), F.col("print").alias("pa"), F.col("shingles").alias("na")), "a").join(prints_.select(F.col("rep").alias("b"), F.col("print").alias("pb"), F.col("shingles").alias("nb")), "b")
    # Sets of too different sizes cannot be alike; exact, and free.
    sizes_fit = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - F.lit(1e-9)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                pa_, pb_ = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(part.num_rows, symbols) for c in (2, 3))
                keep = pa.array((pa_ == pb_).sum(axis=1) >= least)
                yield part.select([0, 1]).filter(keep)

    found = small.where(sizes_fit).select("a", "b", "pa", "pb").mapInArrow(agree, "a long, b long")

    # What is still crowded: classes in salted blocks of about `crowd` x 8, every pair of blocks its own small group.
    block = 8 * crowd
    big = again.where("b IS NULL").select(F.col("a").alias("rep"), "entry")
    sizes = big.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    big = big.join(sizes, "entry").withColumn("mine", F.pmod(F.xxhash64("rep", "entry"), F.col("blocks")).cast("int"))
    sides = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    big = big.select("entry", "rep", "mine", sides.alias("other")).join(prints_, "rep")
    big = big.select("entry", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "rep", "print")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, made = pdf["rep"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["print"]), np.uint32).reshape(len(pdf), symbols)
        l, r = np.flatnonzero(pdf["left"].to_numpy(bool)), np.flatnonzero(pdf["right"].to_numpy(bool))
        got = [(rep[l[x]], rep[r[y]]) for x, y in _agreeing(made[l], made[r], least)]
        a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        use = a != b
        return pd.DataFrame({"a": np.minimum(a, b)[use], "b": np.maximum(a, b)[use]}).drop_duplicates()

    crowded = big.groupBy("entry", "x", "y").applyInPandas(compare, "a long, b long")
    pairs = materialize(found.unionByName(crowded).distinct(), "agreeing")

    # Exact check: the sets of the texts in candidate pairs, made once for each text.
    wanted = pairs.select(F.col("a").alias("__k")).unionByName(pairs.select(F.col("b").alias("__k"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            keys_, texts_ = batch.column(0), batch.column(1).to_pylist()
            for part in _pieces(texts_):
                made = [s.tobytes() for s in shingler.sets(texts_[part])]
                yield pa.RecordBatch.from_arrays([keys_.slice(part.start, part.stop - part.start), pa.array(made, pa.binary())], names=["rep", "set"])

    held = materialize(texts.join(wanted, "__k", "left_semi").select("__k", "__t").mapInArrow(sets, "rep long, set binary"), "sets")
    both = pairs.join(held.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(held.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([x, y]))
                common = int((z[1:] == z[:-1]).sum())
                value[i] = common / (len(x) + len(y) - common)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["rep_a", "rep_b", "similarity"])
            yield out.filter(pa.array(value >= similarity))

    alike = both.select("a", "b", "sa", "sb").mapInArrow(verify, "rep_a long, rep_b long, similarity double")
    return alike, member


#: Rows of a class that meet as many others in one task.
PART = 10_000


def pairs_of_rows(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Every pair of rows (key_a < key_b) whose texts are alike, copies included: the full expansion, for
    reports that ask for it. Rows with the same set are pairs of similarity 1."""
    pairs = materialize(pairs, "pairs")
    members = members.where("shingles > 0").select("rep", "key")
    # A class of many rows is cut into parts, so its rows don't meet in one task.
    parts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    members = materialize(members.join(parts, "rep").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), "members")
    a = members.select(F.col("rep").alias("rep_a"), F.col("key").alias("x"), F.col("part").alias("px"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("key").alias("y"), F.col("part").alias("py"))
    parts = members.select("rep", "parts").distinct()
    cells = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = pairs.join(parts.select(F.col("rep").alias("rep_a"), F.col("parts").alias("na")), "rep_a").join(parts.select(F.col("rep").alias("rep_b"), F.col("parts").alias("nb")), "rep_b")
    of = of.select("rep_a", "rep_b", "nb", cells("na").alias("px")).select("rep_a", "rep_b", "px", cells("nb").alias("py"))
    across = of.join(a, ["rep_a", "px"]).join(b, ["rep_b", "py"]).select("x", "y")
    own = parts.select("rep", "parts", cells("parts").alias("px")).select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), "px", cells("parts").alias("py"))
    within = own.join(a, ["rep_a", "px"]).join(b, ["rep_b", "py"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
