"""The Porter stemmer of the 1980 paper ("An algorithm for suffix stripping"), over arrays of terms in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS, Analyzer, analyzer

#: Suffix rules of the published steps 2 to 4 (fixed values).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _pattern(stem: str) -> str:
    """v and c for the vowels and consonants of a stem; y is a vowel behind a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _pattern(stem)))


def _short(stem: str) -> bool:
    return _pattern(stem).endswith("cvc") and stem[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay as they are."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((n for s, n in (("ed", 2), ("ing", 3)) if w.endswith(s) and "v" in _pattern(w[:-n])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _short(w):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _pattern(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and "v" in _pattern(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        hit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((s for s in STEP4 if w.endswith(s)), key=len, default="")
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[-4] in "st"):
        w = w[: -len(hit)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(terms: Column) -> Column:
    """The stems of an array of terms."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ts: None if ts is None else [stem(t) for t in ts])

    return F.pandas_udf(run, "array<string>")(terms)


def stemming_analyzer(stopwords=STOPWORDS) -> Analyzer:
    """The plain analyzer, each term stemmed."""
    plain = analyzer(stopwords)
    return lambda c: stemmed(plain(c))
