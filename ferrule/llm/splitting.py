"""Cutting oversized texts into pieces at content-defined, natural boundaries.

A rolling hash of the last bytes marks landmarks; a cut snaps from its landmark to the nearest natural
boundary between the smallest and the largest size of a piece. As landmark and boundary depend on nearby
bytes only, an edit moves the cuts next to it and the later ones fall into step again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 32  # bytes that the rolling hash sees
_GEAR = np.random.default_rng(20260301).integers(0, 2**63, 256, dtype=np.uint64)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte over the last WINDOW bytes, by doubling."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint64(width)
        h, width = h + moved, width * 2
    return h


def _nearest(places: np.ndarray, lo: int, hi: int, aim: int) -> int | None:
    """The element of sorted `places` within [lo, hi] that is nearest to aim (the lower of two)."""
    a, b = np.searchsorted(places, lo), np.searchsorted(places, hi, "right")
    if a >= b:
        return None
    k = int(np.searchsorted(places[a:b], aim)) + a
    near = [places[i] for i in (k - 1, k) if a <= i < b]
    return int(min(near, key=lambda p: (abs(int(p) - aim), p)))


def cuts(data: bytes, smallest: int, largest: int, bits: int = 10) -> list[int]:
    """Offsets [0, ..., len(data)]; consecutive ones are at most `largest` bytes apart."""
    size = len(data)
    b = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(rolling_hash(b) & np.uint64((1 << bits) - 1) == 0) + 1
    ends = np.flatnonzero(b == 10) + 1
    # A blank line, even of blanks and a CR, ends a paragraph.
    solid = np.cumsum(~np.isin(b, (9, 10, 13, 32)))
    blank = np.r_[False, solid[ends[1:] - 1] == solid[ends[:-1] - 1]] if len(ends) else np.zeros(0, bool)
    paragraphs = ends[blank]
    spaces = np.flatnonzero((b == 32) | (b == 9)) + 1
    letters = np.flatnonzero((b & 0xC0) != 0x80)  # starts of UTF-8 characters
    out, at = [0], 0
    while size - at > largest:
        lo, hi = at + smallest, at + largest
        k = np.searchsorted(marks, lo)
        aim = int(marks[k]) if k < len(marks) and marks[k] <= hi else hi
        reach = smallest // 2  # a paragraph's end counts as nearest within this distance of the landmark
        cut = _nearest(paragraphs, max(lo, aim - reach), min(hi, aim + reach), aim)
        for places in (ends, spaces, letters):
            cut = cut or _nearest(places, lo, hi, aim)
        # Before the smallest size there may be a line's end where there is none later.
        if cut is not None and b[cut - 1] != 10:
            k = np.searchsorted(ends, lo)
            if k and ends[k - 1] > at:
                cut = int(ends[k - 1])
        at = cut if cut and cut > at else hi
        out.append(at)
    return [*out, size]


def pieces_of(text: str, limit: int, overlap_lines: int) -> list[tuple[int, int, int, str]]:
    """(first line from 0, last line from 0, bytes shared with the piece before, text) of each piece."""
    data = text.encode("utf-8", "replace")
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b == 10) + 1
    at = cuts(data, limit * 3 // 10, limit * 17 // 20)
    out = []
    for start, stop in zip(at, at[1:]):
        begin = start
        k = int(np.searchsorted(ends, start, "right"))  # ends[:k] <= start
        if start and k and ends[k - 1] == start:
            for j in range(k - 2, k - 2 - overlap_lines, -1):  # whole lines before the cut
                if j < -1:
                    break
                before = int(ends[j]) if j >= 0 else 0
                if stop - before > limit:
                    break
                begin = before
        first = int(np.searchsorted(ends, begin, "right"))
        last = int(np.searchsorted(ends, stop - 1, "right"))
        out.append((first, last, start - begin, data[begin:stop].decode("utf-8")))
    return out


def split_oversized(chunks: DataFrame, key: str = "chunk_id", text: str = "text", start_line: str = "start_line", limit: int = 4000, overlap_lines: int = 5) -> DataFrame:
    """Pieces of every text larger than `limit` bytes in UTF-8; smaller, empty and null texts give no row.

    Columns key, piece INT (from 0), start_line INT, end_line INT, shared INT, text. A piece has at most
    `limit` bytes. It begins with up to `overlap_lines` whole lines of the piece before, `shared` bytes, as
    far as the limit permits; without those bytes the pieces of a text join to exactly that text. Cuts lie
    at paragraph or line ends, in a line too long for that at blanks, else between characters, never within
    one. Lines end with a line feed; a null start_line gives null lines. Repeated rows are cut each.
    """
    big = chunks.where(F.octet_length(text) > limit).select(F.col(key).alias("__k"), F.col(start_line).cast("long").alias("__l"), F.col(text).alias("__t"))
    schema = T.StructType([T.StructField(key, chunks.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("shared", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, line, t in zip(batch["__k"], batch["__l"], batch["__t"]):
                for i, (first, last, shared, piece) in enumerate(pieces_of(t, limit, overlap_lines)):
                    known = line is not None and line == line
                    rows.append((k, i, int(line) + first if known else None, int(line) + last if known else None, shared, piece))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=schema.names)
                        rows = []
            yield pd.DataFrame(rows, columns=schema.names).astype({"start_line": "Int32", "end_line": "Int32"})

    return big.mapInPandas(run, schema)
