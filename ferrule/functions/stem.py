"""Porter stemming, run once for each distinct term."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.session import small_side, spread

# Suffix tables of the published algorithm.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """consonant, vowel, consonant other than w, x, y, and nothing before but consonants."""
    s = _shape(stem)
    return s.endswith("cvc") and "v" not in s[:-2] and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if len(word) > len(e) and word.endswith(e)), key=len, default=None)


def porter(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    leading = w[0] == "y"
    if leading:
        w = "Y" + w[1:]
    if w.endswith("sses") and len(w) > 4 or w.endswith("ies") and len(w) > 3:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (e := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif _short(w):
            w += "e"
    if w.endswith("y") and len(w) > 1 and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (e := _longest(w, table)) and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    if e := _longest(w, STEP4):
        if _measure(w[: -len(e)]) > 1:
            w = w[: -len(e)]
    elif w.endswith(("sion", "tion")) and len(w) > 4 and _measure(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e") and len(w) > 1 and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return "y" + w[1:] if leading else w


@F.pandas_udf(T.StringType())
def stem_udf(terms: pd.Series) -> pd.Series:
    return terms.map(porter, na_action="ignore")


def stems(terms: DataFrame, column: str = "term", wanted: DataFrame | None = None) -> DataFrame:
    """(term, stem) of the distinct terms of a table; nulls are left out.

    With `wanted` (stem) only terms with one of those stems. Of a word of six letters or more, stemming leaves
    the first two as they are, but for a y that may become i; most terms are ruled out by that in the JVM.
    """
    words = terms.select(F.col(column).alias("term")).where("term IS NOT NULL").distinct()
    if wanted is None:
        return spread(words).withColumn("stem", stem_udf("term"))
    heads = small_side(wanted.select(F.translate(F.substring("stem", 1, 2), "y", "i").alias("head")).distinct())
    near = words.where(F.length("term") > 5).withColumn("head", F.translate(F.substring("term", 1, 2), "y", "i")).join(heads, "head", "left_semi")
    words = near.select("term").unionByName(words.where(F.length("term") <= 5))
    return spread(words).withColumn("stem", stem_udf("term")).join(small_side(wanted.select("stem").distinct()), "stem", "left_semi")
