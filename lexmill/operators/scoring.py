"""Term weights as Column expressions over term frequency, document frequency, document length and corpus size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: A scorer: (tf, df, dl, n, avgdl) -> weight of one query term in one document.
Scorer = Callable[[Column, Column, Column, Column, Column], Column]


def bm25_idf(n: Column, df: Column) -> Column:
    """Never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tfidf_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def bm25(k1: float = K1, b: float = B) -> Scorer:
    def weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
        return bm25_idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    return weight


def tfidf() -> Scorer:
    def weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
        return tf / dl * tfidf_idf(n, df)

    return weight


def scorer(ranking: Column, k1: float = K1, b: float = B, extra: dict[str, Scorer] | None = None) -> Scorer:
    """The scorer that a row's ``ranking`` names: bm25, tfidf, or one of ``extra``."""
    known = {"bm25": bm25(k1, b), "tfidf": tfidf(), **(extra or {})}

    def weight(*columns: Column) -> Column:
        chosen = F.lit(None).cast("double")
        for name, one in known.items():
            chosen = F.when(ranking == name, one(*columns)).otherwise(chosen)
        return chosen

    return weight
