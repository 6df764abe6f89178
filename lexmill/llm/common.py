"""Helpers shared by the operators of this subpackage: reading, scratch tables, size-checked broadcasts, word batches."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, delete, read_text, replace_text, scratch_path, shared_dir, written

__all__ = ["Scratch", "WordIds", "delete", "is_small", "mix", "read_text", "replace_text", "scratch_path", "sets_of", "shared_dir", "small", "table", "triple_hashes", "triple_sets", "verified_pairs", "with_similarity", "word_list", "written"]

#: Pairs whose sets are compared in one pass at least; see ``verified_pairs``.
PASS_PAIRS = 1 << 18
#: Rows up to which a side of 16-byte keys is broadcast; beyond, Catalyst joins by shuffle.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows. Counts it: give a written table."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else unchanged. Counts ``df``: give a written table."""
    return F.broadcast(df) if is_small(df, rows) else df


WORD_OR_STOP = re.compile(r"[^\W_]+|[.!?…。]+(?=\s|$)")
WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Word -> 64-bit hash, remembered; forgets everything at a fixed size, so memory stays bounded."""

    limit = 300_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        self[word] = h
        return h


def triple_hashes(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of three words in concatenated texts, and the text number of each.

    ``starts`` has the offset of each text in ``words`` and, last, the length.
    """
    n = len(words)
    if n < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = mix(words[:-2] * _M1 + mix(words[1:-1] * _M3 + mix(words[2:] * _M2)))
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = doc[:-2] == doc[2:]
    return h[inside], doc[:-2][inside]


def word_list(words: DataFrame, most: int) -> list[str]:
    """The different lower-case words of (word), in order; more than ``most`` of them are an error, never a choice."""
    found = [r[0] for r in words.select(F.lower("word").alias("word")).where("word is not null and word <> ''").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"at most {most} words can be used")
    return sorted(found)


def with_similarity(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of those of ``pairs`` (a, b) whose sets (id, triples: sorted, different 32-bit hashes) are similar."""
    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("triples").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("triples").alias("tb")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n = part.num_rows
                left, right = (_keyed(part.column(i)) for i in (2, 3))
                at = np.minimum(np.searchsorted(left[0], right[0]), max(0, len(left[0]) - 1))
                hits = left[0][at] == right[0] if len(left[0]) else np.zeros(len(right[0]), bool)
                both = np.bincount(right[1][hits], minlength=n)
                union = np.bincount(left[1], minlength=n) + np.bincount(right[1], minlength=n) - both
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both / np.maximum(1, union))], ["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= threshold)


def verified_pairs(pairs: DataFrame, texts: DataFrame, threshold: float, hold: Scratch) -> DataFrame:
    """Of ``pairs`` (a, b: different ids) those whose texts are similar, with the exact similarity.

    ``texts`` has ``id`` and ``text``. Similarity is the Jaccard coefficient of the sets of three successive
    words. Only texts that occur in a pair are read into sets, as 32-bit hashes. Pairs are joined with them in passes of at most half as many pairs as
    there are sets, so that the sets which pairs carry take less disk than the table of sets, however many pairs there are.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = hold(sets_of(hold(ids, "ids"), texts), "sets")
    many = -(-pairs.count() // max(PASS_PAIRS, sets.count() // 2))
    if many <= 1:
        return with_similarity(pairs, sets, threshold)
    return reduce(DataFrame.union, [hold(with_similarity(pairs.where(F.pmod(F.xxhash64("a"), F.lit(many)) == k), sets, threshold), "verified") for k in range(many)])


def sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, triples) of those ``texts`` (id, text) whose id is in the written table ``ids`` (id)."""
    return texts.join(small(ids), "id", "left_semi").mapInArrow(_triple_sets, "id long, triples array<int>").dropDuplicates(["id"])


def _keyed(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column of sorted sets as sorted keys (row, value), and the row of each."""
    values = np.array(column.flatten()).view(np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(np.array(column.offsets)))
    return row << np.int64(32) | values, row


def _triple_sets(batches):
    import pyarrow as pa

    ids = WordIds()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            words, starts = [], [0]
            for text in part.column(1).to_pylist():
                words += [ids[w] for w in WORD.findall((text or "").lower())]
                starts.append(len(words))
            h, doc = triple_hashes(np.array(words, np.uint64), np.array(starts))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), triple_sets(h, doc, part.num_rows)], ["id", "triples"])


def triple_sets(h: np.ndarray, doc: np.ndarray, n: int):
    """The set of 32-bit hashes of each of ``n`` texts, as a list column, from hashes of triples and the text of each."""
    import pyarrow as pa

    key = np.unique(doc << np.int64(32) | (h >> np.uint64(32)).astype(np.int64))
    offsets = np.searchsorted(key >> np.int64(32), np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((key & np.int64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
