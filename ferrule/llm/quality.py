"""Text statistics for telling natural prose from code, lists, tables, logs and junk.

The layout of every block (the lines between two blank ones) is measured: whether delimiters or gaps stand in
the same columns as in the neighbouring line, or in equal number (tables, lists, records); whether indents are
multiples of one step (code, nested configuration); and how the lengths of neighbouring lines go together
(records take turns, wrapped prose does not). A line's evidence against running text is a weighted sum of
these and of the symbol, digit and punctuation ratios of the line and of its block. What is left is cut into
sentences, which must be made like sentences of some language: with function words of the known ones, with the
shape that cased scripts share, or with the letters and stops of a caseless script.

All texts of a batch are measured together in numpy, character by character; only sentences are read in Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import spread

WORD = re.compile(r"\w+")
STOPS = ".!?:…。！？؟۔।॥։።။។"
_QUOTES = "\"'“”‘’«»‹›()[]{}¿¡„`"
_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？؟۔।॥։።။។]+[”»」』)]*")
_CODE_SPAN = re.compile(r"`[^`\n]*`")

SPACE, LETTER, DIGIT, SOFT, HARD = 0, 1, 2, 3, 4
#: Punctuation of running text; every other punctuation or symbol is hard.
_SOFT = ",.!?…'\"“”‘’«»‹›-–—()¿¡„;。！？、，؟،۔।॥։።။។「」『』"


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each character and whether it is punctuation or a symbol, by code point below 2**16; the
    planes beyond hold letters and pictures and count as letters."""
    kind, symbol = np.full(65_537, LETTER, np.uint8), np.zeros(65_537, bool)
    for code in range(65_536):
        char = chr(code)
        category = unicodedata.category(char)
        symbol[code] = category[0] in "PS"
        if char.isspace():
            kind[code] = SPACE
        elif category == "Nd":
            kind[code] = DIGIT
        elif symbol[code] or category[0] == "C" or char == "�":
            kind[code] = SOFT if char in _SOFT else HARD
    return kind, symbol


#: How much each sign speaks against running text; from 1 in all a line is none. The first five are layout.
WEIGHTS = {
    "mark": 0.6,  # a mark in the same column, or at the end, of a neighbouring line
    "column": 1.0,  # a gap that ends in the same column as a neighbour's
    "fields": 1.0,  # as many of a delimiter as a neighbour, with few words between, in most lines of the block
    "nested": 3.0,  # indents of one step in several depths, by the share of lines that are not ended
    "record": 14.0,  # lengths that go together over eight lines or more, by the share of symbols
    "lead": 0.5,  # opens with punctuation or a digit, quotes aside
    "comment": 0.8,  # opens with a hard symbol; a quarter more among lines that do not
    "hard": 5.0,  # hard symbols in the line
    "digits": 1.5,  # digits in the line
    "around": 8.0,  # hard symbols in the other lines of the block
}
LAYOUT = ("mark", "column", "fields", "nested", "record")
WORDS_A_FIELD = 4


class Measure:
    """The lines of some texts with their layout and ratios; every array has one entry for each nonblank line."""

    def __init__(self, texts: list[str]):
        kind_of, symbol_of = _classes()
        whole = "\n\n".join(t.replace("\r\n", "\n").replace("\r", "\n") for t in texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(code, 65_536)
        kind, symbol, breaks = kind_of[low], symbol_of[low], np.flatnonzero(code == 10)
        start, end = np.r_[0, breaks + 1], np.r_[breaks, len(code)]
        filled = np.flatnonzero(kind != SPACE)
        first = np.searchsorted(filled, start)
        some = (first < len(filled)) & (filled[np.minimum(first, len(filled) - 1)] < end) if len(filled) else np.zeros(len(start), bool)
        lines = np.flatnonzero(some)  # the nonblank ones
        self.whole, self.n = whole, len(lines)
        # Each text is followed by two line feeds, so the line numbers where texts begin are known.
        counts = np.array([t.replace("\r\n", "\n").replace("\r", "\n").count("\n") + 2 for t in texts])
        self.text = np.searchsorted(np.cumsum(counts), lines, "right")
        if not self.n:
            self.block, self.start, self.end = (np.zeros(0, np.int64) for _ in range(3))
            self.signs = {k: np.zeros(0) for k in WEIGHTS}
            self.alignment = self.period = self.correlation = np.zeros(0)
            return
        begin, stop = filled[first[lines]], filled[np.searchsorted(filled, end[lines]) - 1] + 1
        self.start, self.end = begin, stop
        indent, size = begin - start[lines], (stop - begin).astype(np.float64)
        new = np.r_[True, np.diff(lines) > 1]  # a blank line lies between, or a text ends
        self.block = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        height = np.diff(np.r_[heads, self.n])
        together = ~new[1:]  # line i + 1 belongs to the block of line i

        def total(flags: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
            return (sums[stop] - sums[begin]).astype(np.float64)

        def by_block(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values.astype(np.float64), heads)[self.block]

        def either(pair: np.ndarray) -> np.ndarray:
            """Lines of which the pair with the line before or after has a sign."""
            pair = pair & together
            return np.r_[False, pair] | np.r_[pair, False]

        line_of = np.searchsorted(lines, np.searchsorted(start, filled, "right") - 1)
        kind[begin[code[begin] == ord(">")]] = SOFT  # quoted text
        hard, digits = total(kind == HARD), total(kind == DIGIT)
        # Marks and gaps by their column. Stops and commas at the end of a line are punctuation, not alignment.
        fill_kind, column = kind[filled], filled - start[lines][line_of]
        is_mark = (fill_kind >= SOFT) & ~((filled == stop[line_of] - 1) & (fill_kind == SOFT))
        gap = np.zeros(len(filled), bool)
        gap[1:] = (line_of[1:] == line_of[:-1]) & ((np.diff(filled) > 2) | (np.diff(filled) == 2) & (code[filled[1:] - 1] == 9))
        mark = self._below(line_of[is_mark], column[is_mark], code[filled[is_mark]])
        last = code[stop - 1]
        # Leading blanks of a block that is indented as a whole are no sign, so columns count from the text's left.
        ends_alike = (last[1:] == last[:-1]) & (kind[stop[1:] - 1] >= SOFT) & ~np.isin(last[1:], [ord(c) for c in STOPS + _QUOTES])
        pair_mark = mark | ends_alike
        pair_column = self._below(line_of[gap], column[gap], np.ones(int(gap.sum()), np.uint32))
        words = total(self._word_starts(kind)).clip(1)
        pair_fields = np.zeros(self.n - 1, bool)
        for delimiter in ",;\t|:=":
            k = total(code == ord(delimiter))
            few = words <= WORDS_A_FIELD * (k + 1)
            pair_fields |= (k[1:] > 0) & (k[1:] == k[:-1]) & few[1:] & few[:-1]
        marked, columned, fielded = either(pair_mark), either(pair_column), either(pair_fields)
        several = height[self.block] >= 3
        self.alignment = (marked | columned | fielded) & several

        step = np.where(indent > 0, indent, 2**31)
        step = np.minimum.reduceat(step, heads)[self.block]
        regular = (indent > 0) & (indent % step == 0)
        depths = np.maximum.reduceat(indent, heads)[self.block] > step
        self.period = np.where(several, by_block(regular) / height[self.block], 0.0)
        ended = np.isin(code[self._before_quotes(code, begin, stop)], [ord(c) for c in STOPS])
        ended_share = by_block(ended) / height[self.block]

        centred = size - by_block(size) / height[self.block]
        power = by_block(centred * centred)
        product = by_block(np.r_[centred[1:] * centred[:-1] * together, 0.0])
        self.correlation = np.where(several & (power > 0), product / np.where(power > 0, power, 1.0), 0.0)

        symbols = by_block(total(symbol)) / by_block(size)
        opening = kind[begin]
        no_quote = ~np.isin(code[begin], [ord(c) for c in _QUOTES + ">"])
        marked_open = (opening == HARD) & no_quote
        others = by_block(size) - size
        self.signs = {
            "mark": marked & several,
            "column": columned & (height[self.block] >= 4),
            "fields": fielded & (height[self.block] >= 4) & (by_block(fielded) >= 0.8 * height[self.block]),
            "nested": np.where(depths, self.period * (1 - ended_share), 0.0),
            "record": np.where((height[self.block] >= 8) & (np.abs(self.correlation) >= 0.5), np.abs(self.correlation) * symbols, 0.0),
            "lead": (opening == SOFT) & no_quote | (opening == DIGIT),
            "comment": marked_open * np.where(by_block(marked_open) < height[self.block], 1.25, 1.0),
            "hard": hard / size,
            "digits": digits / size,
            "around": np.where(others > 0, (by_block(hard) - hard) / np.maximum(others, 1), 0.0),
        }

    def _below(self, line: np.ndarray, column: np.ndarray, code: np.ndarray) -> np.ndarray:
        """For each line but the last whether some (column, code) of it is one of the next line as well."""
        key = line.astype(np.int64) << 42 | np.minimum(column, 2**21 - 1).astype(np.int64) << 21 | code.astype(np.int64)
        out = np.zeros(max(0, self.n - 1), bool)
        shared = np.intersect1d(key + (1 << 42), key, assume_unique=True)
        out[(shared >> 42) - 1] = True
        return out

    @staticmethod
    def _word_starts(kind: np.ndarray) -> np.ndarray:
        letters = kind == LETTER
        return letters & ~np.r_[False, letters[:-1]]

    @staticmethod
    def _before_quotes(code: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place of each line's last character that is neither a quote nor a bracket."""
        plain = np.flatnonzero(~np.isin(code, [ord(c) for c in _QUOTES + " \t\f\v"]))
        at = np.searchsorted(plain, stop) - 1
        return np.where(at >= 0, np.maximum(plain[np.maximum(at, 0)], begin), begin) if len(plain) else begin

    def running(self, weights: dict[str, float] = WEIGHTS) -> np.ndarray:
        """Whether each line may be running text."""
        return sum(w * self.signs[k] for k, w in weights.items()) < 1.0 if self.n else np.zeros(0, bool)


def layout(lines: list[str]) -> tuple[float, float, float]:
    """(delimiter alignment, indentation periodicity, line-length autocorrelation) of a text's nonblank lines,
    each line with the value of its block; 0 for blocks of fewer than three lines. Alignment: the share of
    lines that share a delimiter's or a gap's place, or the number of a delimiter, with a neighbouring line.
    Periodicity: the share of lines indented by a multiple of the block's smallest indent. Autocorrelation: of
    the lengths of lines at lag 1."""
    m = Measure(["\n".join(lines)])
    return tuple(float(x.mean()) if m.n else 0.0 for x in (m.alignment, m.period, m.correlation))


def _caseless(s: str) -> bool:
    """Whether letters of scripts without case prevail."""
    if s.isascii():
        return False
    letters = [c for c in s if c.isalpha()]
    return 2 * sum(c.lower() == c.upper() for c in letters) > len(letters) > 0


def is_sentence(s: str, ended: bool, common: frozenset[str]) -> bool:
    """Whether a piece of running text, up to its stop, is made like a sentence.

    Of scripts with case: three words or more, of which 12 % are function words; or, for languages without a
    list, five words or more that open with a capital, go on in lower case and have the short words that every
    such language builds sentences with (or letters beyond ASCII). Of scripts without case: six letters or
    more, hardly anything else, and a stop; scripts that write none (Thai, Lao, Khmer) go without.
    """
    if _caseless(s):
        filled = sum(not c.isspace() for c in s)
        letters = sum(unicodedata.category(c)[0] in "LM" for c in s)
        stopless = sum("฀" <= c <= "໿" or "ក" <= c <= "៿" for c in s) * 2 > letters
        return letters >= 6 and letters >= 0.7 * filled and (ended or stopless)
    if not ended:
        return False
    words = [w for w in WORD.findall(_CODE_SPAN.sub(" ", s) if "`" in s else s) if w[0].isalpha()]
    n = len(words)
    if n < 3 or s.count(",") + s.count(";") > 0.3 * n:
        return False
    if sum(w.lower() in common for w in words) >= 0.12 * n:
        return True
    opens = s.lstrip(_QUOTES + " \t")[:1].isupper()
    short = sum(len(w) <= 3 for w in words)
    return n >= 5 and opens and sum(map(str.islower, words)) >= 0.7 * n and (short >= 0.2 * n or not s.isascii())


def sentence_chars(paragraph: str, common: frozenset[str]) -> int:
    """Characters of a paragraph that stand in sentences."""
    got = begin = 0
    for m in _STOP.finditer(paragraph):
        s, begin = paragraph[begin : m.end()].strip(), m.end()
        got += len(s) + 1 if is_sentence(s, True, common) else 0
    rest = paragraph[begin:].strip()
    return got + (len(rest) + 1 if rest and is_sentence(rest, False, common) else 0)


def prose_shares(texts: list[str], common: frozenset[str], weights: dict[str, float] = WEIGHTS) -> tuple[list[float], Measure]:
    """For each text the share of its characters (blanks at the ends of lines aside) in running sentences."""
    m = Measure(texts)
    running = m.running(weights)
    total = np.bincount(m.text, m.end - m.start, len(texts)) if m.n else np.zeros(len(texts))
    prose = np.zeros(len(texts))
    # A paragraph is a run of such lines in one block.
    at = np.flatnonzero(running)
    if len(at):
        edge = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(m.block[at]) > 0)])
        starts, ends, whole = m.start.tolist(), m.end.tolist(), m.whole
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)]):
            paragraph = " ".join(whole[starts[i] : ends[i]] for i in at[a:b].tolist())
            prose[m.text[at[a]]] += sentence_chars(paragraph, common)
    return [min(1.0, p / t) if t else 0.0 for p, t in zip(prose.tolist(), total.tolist())], m


def prose_share(text: str, common: frozenset[str], weights: dict[str, float] = WEIGHTS) -> float:
    return prose_shares([text], common, weights)[0][0]


@lru_cache(maxsize=70_000)
def _is_symbol(char: str) -> bool:
    return unicodedata.category(char)[0] in "PS"


_ASCII_SYMBOLS = bytes(i for i in range(128) if _is_symbol(chr(i)))


def _symbols(text: str) -> int:
    """Punctuation and symbol characters of a text."""
    if text.isascii():
        return len(text) - len(text.encode().translate(None, _ASCII_SYMBOLS))
    return sum(n for char, n in Counter(text).items() if _is_symbol(char))


def _ends_sentence(line: str) -> bool:
    """Whether a line ends in a stop, quotes and brackets aside."""
    return line.rstrip(_QUOTES + " \t\r\n\f\v")[-1:] in frozenset(STOPS)


def _ratios(text: str, common: frozenset[str]) -> tuple:
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        n,
        sum(map(len, words)) / n if n else None,
        _symbols(text) / len(text) if text else None,
        sum(map(_ends_sentence, lines)) / len(lines) if lines else None,
        sum(map(common.__contains__, WORD.findall(text.lower()))) / n if n else None,
    )


def statistics(texts: list[str], common: frozenset[str]) -> list[tuple]:
    """The columns of COLUMNS for each text."""
    out: list[tuple] = []
    for part in _pieces(texts):
        some = texts[part]
        shares, m = prose_shares(some, common)
        lines = np.bincount(m.text, minlength=len(some)).clip(1)
        signs = [np.bincount(m.text, x, len(some)) / lines for x in (m.alignment, m.period, m.correlation)]
        out += [(*_ratios(t, common), *(float(s[i]) for s in signs), shares[i]) for i, t in enumerate(some)]
    return out


def _pieces(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts measured at once: as many as `chars` characters hold, one at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


COLUMNS = "n_words long, mean_word_length double, symbol_share double, punctuated_lines double, common_share double, delimiter_alignment double, indent_period double, length_correlation double, prose_share double"


def text_statistics(df: DataFrame, key: str, text: str, common_words: DataFrame, with_prose: float = 0.5) -> DataFrame:
    """The key, the statistics and is_prose BOOLEAN for each row.

    n_words: runs of letters, digits and underscores. mean_word_length in characters. symbol_share:
    punctuation and symbols among the characters. punctuated_lines: nonblank lines that end a sentence.
    common_share: words in `common_words` (any language, lower case). delimiter_alignment, indent_period,
    length_correlation: see `layout`. is_prose: more than `with_prose` of the characters belong to sentences
    in lines that layout and ratios admit. A null text gives nulls and is_prose false; where there is
    nothing to divide by, a share is null. Whole texts are read. Repeated rows stay; an empty table gives an
    empty result; other columns are ignored.

    `common_words` is a list of function words; up to 100,000 are sent to the tasks, more are refused.
    """
    listed = common_words.select(F.lower("word").alias("w")).where("w IS NOT NULL").distinct().limit(100_001).collect()
    if len(listed) > 100_000:
        raise ValueError("common_words is no list of function words")
    common = frozenset(r[0] for r in listed)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = [t for t in batch["__t"] if t is not None]
            measured = iter(statistics(given, common))
            rows = [(None,) * len(names) if t is None else next(measured) for t in batch["__t"]]
            out = pd.DataFrame(rows, columns=names).astype({"n_words": "Int64"} | {n: "float64" for n in names[1:]})
            out.insert(0, key, batch["__k"].to_numpy())
            yield out

    key_type = df.schema[key].dataType.simpleString()
    got = spread(df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))).mapInPandas(run, f"`{key}` {key_type}, {COLUMNS}")
    clean = [F.when(~F.isnan(n), F.col(n)).alias(n) for n in names[1:]]
    return got.select(key, "n_words", *clean, F.coalesce(F.col("prose_share") > with_prose, F.lit(False)).alias("is_prose"))
