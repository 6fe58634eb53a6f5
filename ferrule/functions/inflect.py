"""Plural and singular forms of English words, run once for each distinct word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The first pattern that matches decides.
PLURALS = [
    (r"(quiz)$", r"\1zes"), (r"^(oxen)$", r"\1"), (r"^(ox)$", r"\1en"), (r"(m|l)ice$", r"\1ice"), (r"(m|l)ouse$", r"\1ice"), (r"(pass|matr|vert|ind)(?:ix|ex)$", r"\1ices"),
    (r"(x|ch|ss|sh)$", r"\1es"), (r"([^aeiouy]|qu)y$", r"\1ies"), (r"(hive)$", r"\1s"), (r"([lr])f$", r"\1ves"), (r"([^f])fe$", r"\1ves"), (r"sis$", "ses"), (r"([ti])a$", r"\1a"),
    (r"([ti])um$", r"\1a"), (r"(buffal|tomat)o$", r"\1oes"), (r"(bu)s$", r"\1ses"), (r"(alias|status)$", r"\1es"), (r"(octop|vir)i$", r"\1i"), (r"(octop|vir)us$", r"\1i"), (r"^(ax|test)is$", r"\1es"),
    (r"s$", "s"), (r"$", "s"),
]
SINGULARS = [
    (r"(database)s$", r"\1"), (r"(quiz)zes$", r"\1"), (r"(matr)ices$", r"\1ix"), (r"(vert|ind)ices$", r"\1ex"), (r"^(ox)en", r"\1"), (r"(alias|status)(es)?$", r"\1"), (r"(octop|vir)(us|i)$", r"\1us"),
    (r"^(a)x[ie]s$", r"\1xis"), (r"(cris|test)(is|es)$", r"\1is"), (r"(shoe)s$", r"\1"), (r"(o)es$", r"\1"), (r"(bus)(es)?$", r"\1"), (r"(m|l)ice$", r"\1ouse"), (r"(x|ch|ss|sh)es$", r"\1"),
    (r"(m)ovies$", r"\1ovie"), (r"(s)eries$", r"\1eries"), (r"([^aeiouy]|qu)ies$", r"\1y"), (r"([lr])ves$", r"\1f"), (r"(tive)s$", r"\1"), (r"(hive)s$", r"\1"), (r"([^f])ves$", r"\1fe"),
    (r"(^analy)(sis|ses)$", r"\1sis"), (r"(analy|ba|diagno|parenthe|progno|synop|the)(sis|ses)$", r"\1sis"), (r"([ti])a$", r"\1um"), (r"(n)ews$", r"\1ews"), (r"(ss)$", r"\1"), (r"s$", ""),
]
IRREGULARS = {"person": "people", "man": "men", "child": "children", "sex": "sexes", "move": "moves", "zombie": "zombies"}
UNCOUNTABLES = "equipment information rice money species series fish sheep jeans police".split()


def _by_rules(word: str, rules: list[tuple[str, str]], irregular: dict[str, str]) -> str:
    low = word.lower()
    if not word or any(re.search(rf"\b{u}$", low) for u in UNCOUNTABLES):
        return word
    for one, other in irregular.items():
        if low.endswith(one) or low.endswith(other):
            cut = len(one if low.endswith(one) else other)
            return word[: len(word) - cut] + word[len(word) - cut] + other[1:]
    for pattern, form in rules:
        if re.search(pattern, word, re.I):
            return re.sub(pattern, form, word, count=1, flags=re.I)
    return word


def pluralize(word: str) -> str:
    return _by_rules(word, PLURALS, IRREGULARS)


def singularize(word: str) -> str:
    return _by_rules(word, SINGULARS, {v: k for k, v in IRREGULARS.items()})


@F.pandas_udf(T.StringType())
def plural(words: pd.Series) -> pd.Series:
    return words.map(pluralize, na_action="ignore")


@F.pandas_udf(T.StringType())
def singular(words: pd.Series) -> pd.Series:
    return words.map(singularize, na_action="ignore")
