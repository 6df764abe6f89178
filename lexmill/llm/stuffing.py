"""Pages of stuffed keywords, tags, product entries or links, by the perplexity of their word-class sequences."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, word_list, written

#: Function words of the trained languages, beside those of the table (fixed values).
FUNCTION_WORDS = (
    "about above after again against all along also although among another any around because before behind below between both do does down during each either "
    "even ever few first here how however into just last less many more most much must near never no nor nobody nothing now often once one only other out over own "
    "said same she he her his him some such than through today too under until up upon very what where while whose why within without yet you your i me my us "
    "bei bis bleiben dann des dieser durch es für gegen gilt hat hier ihr kann kein man mehr nach noch nur ob ohne sehr sich sie über um unter vor wie wird wurden zum zur zwischen "
    "après avant aussi cette chaque chez comme dans deux elle entre encore leur lui mais même nous où par plus puis quand reste sa sans se ses son sous toujours tout très vous y "
    "antes cada como cuando desde después dos entre esta hasta lo más muy nos otra pero porque quien ser sobre su sus también todo tres ya"
)
#: A content word has the class of a repeated one from its fourth occurrence in the document on.
REPEATED = 4
#: Share of prose segments that lies beyond either threshold.
TAIL = 0.01
#: Weights of the interpolated orders three, two, one, and of the uniform distribution.
ORDERS = (0.62, 0.26, 0.11, 0.01)
BIN, BINS = 0.1, 200
#: Function words at most: the model has a table of their pairs.
MOST_WORDS = 2_000

_TOKEN = re.compile(r"https?://[^\s<>\"')\]]+|</?[a-zA-Z][^<>]*>|#\w+|[^\W\d_]+(?:'[^\W\d_]+)?|\d[\d.,:%/-]*|[^\s\w]|_")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=。)\s*| {8,}|\t{4,}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_LINK = re.compile(r"https?://[^\s<>\"')\]]+|</?[a-zA-Z][^<>]*>")
_STOP = set(".!?…。")
_SEPARATORS = set(",;/|•*»·")
_MARKS = ".,;:!?-()[]|/»>*•\"'…。、+=&"


#: Classes beside function words and marks: start, end, CJK run, other script, capitals, capitalised, lower case (* repeated), number, address, tag, hash tag, other mark.
CLASSES = ["<s>", "</s>", "J", "R", "A", "A*", "C", "C*", "w", "w*", "N", "U", "H", "G", "P", *_MARKS]
START, END, PLACE = 0, 1, {c: i for i, c in enumerate(CLASSES)}
_FOREIGN, _STARRED, _LINKED = {PLACE["J"], PLACE["R"]}, {PLACE["A*"], PLACE["C*"], PLACE["w*"]}, {PLACE["U"], PLACE["H"], PLACE["G"]}


class Token(NamedTuple):
    """What a token means: its class, its class once it is repeated, its lower case if it is a word."""

    code: int
    again: int
    low: str | None
    content: bool
    function: bool
    tells: int
    mark: str


class Tokens(dict):
    """Token -> meaning, remembered; forgets everything at a fixed size. Function words and marks have classes of their own, others that of their form."""

    limit = 200_000

    def __init__(self, function: list[str]):
        super().__init__()
        self.function = {w: len(CLASSES) + i for i, w in enumerate(function)}
        self.size = len(CLASSES) + len(function)

    def __missing__(self, t: str) -> Token:
        if len(self) >= self.limit:
            self.clear()
        first = t[0]
        if first.isalpha() and not t.startswith("http"):
            low = t.lower()
            cjk = len(_CJK.findall(t))
            long = 2 if first > "ɐ" and len(t) > 5 else 1 if first > "ɐ" else 0
            if low in self.function:
                found = Token(self.function[low], self.function[low], low, False, True, 2, "")
            elif cjk:
                found = Token(PLACE["J"], PLACE["J"], low, False, False, 9 if cjk > 5 else long, "")
            elif low[0] > "ɐ":
                found = Token(PLACE["R"], PLACE["R"], low, True, False, long, "")
            else:
                form = "A" if len(t) > 1 and t.isupper() else "C" if first.isupper() else "w"
                found = Token(PLACE[form], PLACE[form + "*"], low, True, False, long, "")
        else:
            name = "N" if first.isdigit() else "U" if t.startswith("http") else "H" if first == "<" and len(t) > 1 else "G" if first == "#" and len(t) > 1 else t if t in _MARKS else "P"
            found = Token(PLACE[name], PLACE[name], None, False, False, 0, t if len(t) == 1 else "")
        self[t] = found
        return found


def segments(text: str, known: Tokens) -> list[tuple[int, list[int], bool, bool]]:
    """(characters, classes, evidence, prose) of the sentences, or short lines, of a text.

    evidence (for training only): at least half of the content words of the segment stand three times or more in the document; or it is a
    run of eight or more short items without function words; or its line is mostly links or hash tags with no sentence about them.
    prose: a sentence to train on, by its stop, length and function words, without evidence, repeated words or links.
    """
    lines = []
    total: Counter = Counter()
    for line in text.split("\n"):
        parts = [(len(s), [known[t] for t in _TOKEN.findall(s)]) for s in _SENTENCE.split(line) if s.strip()]
        if parts:
            lines.append((line, parts))
            total.update(t.low for _, p in parts for t in p if t.low is not None)
    out = []
    counts: dict[str, int] = {}
    for line, parts in lines:
        solid = len("".join(line.split())) or 1
        linked = sum(len("".join(x.split())) for x in _LINK.findall(line)) if "<" in line or "://" in line else 0
        tags = sum(t.code == PLACE["G"] for _, p in parts for t in p) if "#" in line else 0
        of_links = False
        if linked > 0.4 * solid:
            told = max((sum(t.tells == 2 or t.tells == 1 and len(p) > 4 or t.tells == 9 and len(p) > 4 for t in p) + 3 * any(t.tells == 9 for t in p) for _, p in parts if p and p[-1].mark in _STOP and p[-1].mark), default=0)
            of_links = told < 3
        if tags:
            of_links = of_links or tags > 0.6 * sum(t.low is not None or t.code in (PLACE["U"], PLACE["G"]) or t.mark == "#" for _, p in parts for t in p)
        for size, p in parts:
            if not p:
                continue
            codes, content, again, plain = [], 0, 0, 0
            for t in p:
                low = t.low
                if low is None:
                    codes.append(t.code)
                elif t.function:
                    plain += 1
                    codes.append(t.code)
                else:
                    seen = counts[low] = counts.get(low, 0) + 1
                    codes.append(t.again if seen >= REPEATED else t.code)
                    if t.content:
                        content += 1
                        again += total[low] >= REPEATED - 1
            last = p[-1].mark
            stopped = bool(last) and last in _STOP
            evidence = of_links or again >= 3 and again >= 0.5 * content
            if not evidence and not stopped and plain <= 0.06 * len(p):
                split = sum(bool(t.mark) and t.mark in _SEPARATORS for t in p)
                evidence = split >= 8 and len(p) <= 5 * split and content >= split
            prose = False
            if stopped and not evidence and len(codes) >= 6:
                foreign = sum(c in _FOREIGN for c in codes)
                prose = (foreign * 2 >= len(codes) or plain >= 0.12 * len(codes)) and sum(c in _STARRED for c in codes) <= 0.1 * len(codes) and _LINKED.isdisjoint(codes)
            out.append((size, codes, evidence, prose))
    return out


ENCODED = "id long, sizes array<int>, evidence array<boolean>, prose array<boolean>, lengths array<int>, codes array<smallint>"


def encoded(docs: DataFrame, function: list[str]) -> DataFrame:
    """The segments of each document (id, text) as lists of class numbers; null and blank texts have no row."""

    def run(batches):
        import pyarrow as pa

        known = Tokens(function)

        def lists(values, sizes, kind):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, segs, n_segs, n_codes = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = segments(text, known) if text else []
                    if found:
                        ids.append(key)
                        segs += found
                        n_segs.append(len(found))
                        n_codes.append(sum(len(x[1]) for x in found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), lists([x[0] for x in segs], n_segs, pa.int32()), lists([x[2] for x in segs], n_segs, pa.bool_()), lists([x[3] for x in segs], n_segs, pa.bool_()),
                        lists([len(x[1]) for x in segs], n_segs, pa.int32()), lists([c for x in segs for c in x[1]], n_codes, pa.int16()),
                    ],
                    ["id", "sizes", "evidence", "prose", "lengths", "codes"],
                )

    return docs.select("id", "text").where("id is not null").mapInArrow(run, ENCODED)


def _trigrams(lengths: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the class trigrams of segments, their ends included, and the segment of each."""
    seg = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - first[seg]
    c = codes.astype(np.int64)
    b = np.where(place >= 1, np.roll(c, 1), START)
    a = np.where(place >= 2, np.roll(c, 2), START)
    last = first + lengths - 1
    before = np.where(lengths >= 2, c[last - 1], START)
    return np.concatenate([(a * size + b) * size + c, (before * size + c[last]) * size + END]), np.concatenate([seg, np.arange(len(lengths))])


def _flat(batch, *names: str) -> list[np.ndarray]:
    return [np.array(batch.column(batch.schema.get_field_index(n)).flatten()) for n in names]


class ClassModel:
    """An interpolated trigram model of word classes, from counts of numbered class trigrams."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, size: int):
        order = np.argsort(numbers)
        self.numbers, self.counts, self.size = np.append(numbers[order], np.iinfo(np.int64).max), np.append(counts[order], 0).astype(float), size
        two, one = np.zeros(size * size), np.zeros(size)
        ctx2, ctx1 = np.zeros(size * size), np.zeros(size)
        np.add.at(two, numbers % (size * size), counts)
        np.add.at(one, numbers % size, counts)
        np.add.at(ctx2, numbers // size, counts)
        np.add.at(ctx1, numbers // size % size, counts)
        l3, l2, l1, l0 = ORDERS
        self.three = l3 / np.maximum(1, ctx2)
        lower = l2 * two.reshape(size, size) / np.maximum(1, ctx1)[:, None] + l1 * one / max(1.0, one.sum()) + l0 / (max(1, (one > 0).sum()) + 20)
        self.lower = lower.ravel()

    def bits(self, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Mean bits a class of each segment, its end included."""
        number, seg = _trigrams(lengths, codes, self.size)
        at = np.searchsorted(self.numbers, number)
        n = np.where(self.numbers[at] == number, self.counts[at], 0.0)
        p = n * self.three[number // self.size] + self.lower[number % (self.size * self.size)]
        return np.bincount(seg, -np.log2(p), len(lengths)) / (lengths + 1)


def _length(lengths: np.ndarray) -> np.ndarray:
    return np.minimum(6, np.log2(lengths + 1).astype(int))


#: Kinds of segments that models are trained on: prose sentences, those that show stuffing, all others.
PROSE, STUFFED, OTHER = range(3)


def class_models(table: DataFrame, size: int) -> list[ClassModel]:
    """The models of the segments of all documents of each kind: trigrams are counted in tasks, then by kind and number.

    There are fewer than 2,500 classes, and of their trigrams those that occur reach the driver: bounded by the classes, not the documents.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prose, evidence, lengths, codes = _flat(batch, "prose", "evidence", "lengths", "codes")
            if not len(lengths):
                continue
            number, seg = _trigrams(lengths, codes, size)
            kind = np.where(prose, PROSE, np.where(evidence, STUFFED, OTHER))
            found, n = np.unique(number + kind[seg] * size**3, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["number", "n"])

    rows = table.select("prose", "evidence", "lengths", "codes").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    number, n = (rows.column(i).to_numpy() for i in (0, 1))
    return [ClassModel(number[number // size**3 == k] % size**3, n[number // size**3 == k], size) for k in (PROSE, STUFFED, OTHER)]


def thresholds(table: DataFrame, shared) -> list[tuple[float, float]]:
    """By length of a segment (a power of two), the bits that all but 1 % of prose sentences stay above, and below."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(7 * BINS, np.int64)
        for batch in batches:
            prose, lengths, codes = _flat(batch, "prose", "lengths", "codes")
            if prose.any():
                bits = shared.value[PROSE].bits(lengths, codes)[prose]
                counts += np.bincount(_length(lengths[prose]) * BINS + np.minimum(BINS - 1, (bits / BIN).astype(int)), minlength=7 * BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    hist = np.zeros(7 * BINS)
    for at, n in table.select("prose", "lengths", "codes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # at most 1,400 rows
        hist[at] = n
    hist = hist.reshape(7, BINS)
    out = []
    for k in range(7):
        near = hist[k] if hist[k].sum() >= 1000 else hist.sum(0)
        share = np.cumsum(near) / max(1, near.sum())
        out.append((BIN * int(np.searchsorted(share, TAIL)), BIN * (1 + int(np.searchsorted(share, 1 - TAIL)))) if near.sum() else (0.0, BIN * BINS))
    return out


def page_scores(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(id, chars, bits, odd_chars, stuffed_chars, evidence_chars) of each document (id, text) with text.

    bits: mean bits a word class over the document under the model of prose. odd_chars: characters in segments whose perplexity is abnormally
    high or low for their length. stuffed_chars: those of them that are less surprising under the model of stuffed segments than under
    the models of prose and of everything else (tables, code, lists, headings), which are as improbable as prose; repeated words have classes
    of their own, so repetition is part of the sequence. evidence_chars: characters in segments that show stuffing by themselves; they
    name what the second model is trained on, and decide nothing. Null and blank texts have no row.
    ``words`` (word): common words, at most 2,000; more raise an error. Repeated rows count once. Texts are read once, into a
    table of class numbers; training, thresholds and scores are array passes over it.
    """
    sc = docs.sparkSession.sparkContext
    function = sorted({*word_list(words, MOST_WORDS), *FUNCTION_WORDS.split()})
    size = len(CLASSES) + len(function)
    hold = Scratch()
    table = hold(encoded(docs, function), "classes")
    shared = sc.broadcast(class_models(table, size))  # three times at most size squared numbers, and the trigrams there are
    cuts = np.array(thresholds(table, shared))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, evidence, lengths, codes = _flat(batch, "sizes", "evidence", "lengths", "codes")
            n = np.diff(np.array(batch.column(1).offsets))
            doc = np.repeat(np.arange(batch.num_rows), n)
            bits, stuffed, other = (m.bits(lengths, codes) for m in shared.value)
            low, high = cuts[_length(lengths)].T
            odd = (bits < low) | (bits > high)

            def total(x, doc=doc, rows=batch.num_rows):
                return np.bincount(doc, x, rows)

            sums = [total(sizes), total(sizes * odd), total(sizes * (odd & (stuffed < np.minimum(bits, other)))), total(sizes * evidence)]
            mean = total(bits * lengths) / total(lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0].astype(np.int64)), pa.array(mean), *(pa.array(x.astype(np.int64)) for x in sums[1:])], ["id", "chars", "bits", "odd_chars", "stuffed_chars", "evidence_chars"])

    scores = table.select("id", "sizes", "evidence", "lengths", "codes").mapInArrow(run, "id long, chars long, bits double, odd_chars long, stuffed_chars long, evidence_chars long")
    found = written(scores.dropDuplicates(["id"]), "scores")
    hold.discard()
    return found


def stuffed_pages(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Ids of the documents of which more than half of the characters are stuffed, by ``page_scores``."""
    return page_scores(docs, words).where(F.col("stuffed_chars") > 0.5 * F.col("chars")).select("id")
