"""Byte-level BPE encoding by merge replay.

A block of texts is split into words, and every distinct word of the block that was not met before is
encoded together with the others: an inverted index leads from a pair of adjacent tokens to all word
positions where it stands, and the merges are applied in rank order to exactly those positions, each
application updating the index for its two neighbours only. A word that occurs a million times costs one
replay and a million dictionary probes. Replaying over one word table of the whole corpus would need a
shuffle of every token occurrence to bring the ids back; replaying per block needs no shuffle at all.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Unicode White_Space, and the public pattern that splits a text into words before merging.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Words whose ids a task keeps; beyond it the memory is emptied, which costs time and changes nothing.
MEMORY_WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merges of a byte-level BPE vocabulary: `pairs` leads from a pair to (rank, merged id)."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[Iterable[str]]):
        self.first = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.pairs = {}
        self.key = hash(tuple(sorted(vocab.items())))
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], (m.split(" ") if isinstance(m, str) else m for m in model["merges"]))

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word; all words advance together, merge by merge in rank order."""
        first, pairs = self.first, self.pairs
        token: list[int] = []
        ends: list[int] = []
        for w in words:
            token += [first[b] for b in w.encode("utf-8", "replace")]
            ends.append(len(token))
        size = len(token)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        begin = 0
        for end in ends:
            if end > begin:
                before[begin], after[end - 1] = -1, -1
            begin = end
        places: dict[tuple[int, int], list[int]] = {}
        ranks: list[tuple[int, tuple[int, int], int]] = []

        def note(p: int, q: int) -> None:
            pair = (token[p], token[q])
            at = places.get(pair)
            if at is not None:
                at.append(p)
            elif pair in pairs:
                rank, merged = pairs[pair]
                places[pair] = [p]
                heapq.heappush(ranks, (rank, pair, merged))

        for p in range(size):
            if after[p] >= 0:
                note(p, after[p])
        while ranks:
            _, pair, merged = heapq.heappop(ranks)
            a, b = pair
            at = places.pop(pair)
            if a == b:
                at.sort()  # runs merge from the left
            for p in at:
                if token[p] != a:
                    continue
                q = after[p]
                if q < 0 or token[q] != b:
                    continue
                token[p], token[q] = merged, -1
                r = after[q]
                after[p] = r
                if r >= 0:
                    before[r] = p
                    note(p, r)
                o = before[p]
                if o >= 0:
                    note(o, p)
        out, begin = [], 0
        for end in ends:
            out.append(tuple(t for t in token[begin:end] if t >= 0))
            begin = end
        return out


#: The same pattern where only ASCII can occur, for the faster standard engine.
ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


@lru_cache(maxsize=2)
def _finders() -> tuple:
    return re.compile(ASCII_WORD).findall, regex.compile(WORD).findall


class Encoder:
    """Encodes texts block by block and remembers the words it has met."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}

    def words(self, texts: list[str | None]) -> list[list[str] | None]:
        (ascii_words, any_words), known = _finders(), self.known
        split = [None if t is None else ascii_words(t) if t.isascii() else any_words(t) for t in texts]
        new = {w for ws in split if ws for w in ws if w not in known}
        if new:
            if len(known) + len(new) > MEMORY_WORDS:
                known.clear()
                new = {w for ws in split if ws for w in ws}
            order = sorted(new)
            known.update(zip(order, self.merges.replay(order)))
        return split

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        known = self.known
        return [None if ws is None else list(chain.from_iterable(map(known.__getitem__, ws))) for ws in self.words(texts)]

    def count(self, texts: list[str | None]) -> list[int | None]:
        known = self.known
        return [None if ws is None else sum(map(len, map(known.__getitem__, ws))) for ws in self.words(texts)]


#: Encoders of this Python process by vocabulary: a worker runs one task after the other and keeps its words.
_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.value.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.value.key] = Encoder(shared.value)
    return _ENCODERS[shared.value.key]


def _blocks(texts: pa.Array, rows: int = 2048, size: int = 4_000_000) -> Iterator[list[str | None]]:
    """Consecutive texts, at most `rows` and about `size` characters together."""
    block, chars = [], 0
    for t in texts:
        t = t.as_py()
        block.append(t)
        chars += len(t or "")
        if len(block) >= rows or chars >= size:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _encoded(df: DataFrame, keys: list[str], text: str, out: str, tokenizer: str, only_count: bool) -> DataFrame:
    merges = df.sparkSession.sparkContext.broadcast(Merges.load(tokenizer))  # of fixed size, the vocabulary
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, T.IntegerType() if only_count else T.ArrayType(T.IntegerType()))])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(merges)
        for batch in batches:
            texts, at = batch.column(n_keys), 0
            for block in _blocks(texts):
                cols = [batch.column(i).slice(at, len(block)) for i in range(n_keys)]
                at += len(block)
                if only_count:
                    got = pa.array(encoder.count(block), pa.int32())
                else:
                    got = encoder.encode(block)
                    flat = np.fromiter(chain.from_iterable(x for x in got if x), np.int32)
                    ends = np.cumsum([0, *(len(x or ()) for x in got)]).astype(np.int32)
                    got = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in got]))
                yield pa.RecordBatch.from_arrays([*cols, got], names=[*keys, out])

    return spread(df.select(*keys, F.col(text).alias("__text"))).mapInArrow(run, schema)


def encode(df: DataFrame, keys: list[str], text: str = "text", out: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """The key columns and `out` (ARRAY<INT>): the text's token ids, no special tokens.

    A null text gives null, an empty one an empty list; strings that look like special tokens are ordinary
    text. Each row is encoded on its own, so repeated rows stay, and columns that are not keys are ignored.
    A text of any length is encoded as a whole. An empty table gives an empty result.
    """
    return _encoded(df, keys, text, out, tokenizer, only_count=False)


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """The key columns and `out` (INT): how many ids `encode` gives; null for a null text."""
    return _encoded(df, keys, text, out, tokenizer, only_count=True)
