"""Texts as ids of a public byte-level BPE vocabulary, and back."""

from __future__ import annotations

import base64
import os

import numpy as np
import regex
from pyspark.sql import DataFrame

#: The pre-splitting pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is cut into pieces before it is encoded.
PIECE = 100_000
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
_TOKEN = regex.compile(PATTERN)


def default_rank_file() -> str:
    """The rank file of byte_bpe_50k: below ``LEXMILL_TOKENIZERS`` if set, else in the installed vocabulary package."""
    home = os.environ.get("LEXMILL_TOKENIZERS")
    if home:
        return os.path.join(home, "byte_bpe_50k.tiktoken")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def encoder(data: bytes):
    """A tiktoken encoding without special tokens: markers inside texts are ordinary text."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})


def safe_pieces(text: str, size: int = PIECE):
    """``text`` cut where no token can cross, into pieces of about ``size`` characters.

    A single space between two non-blanks always opens a pre-split part, so the cut before it is safe. Where
    no such space comes (scripts without spaces), the cut is behind a pre-split part that ends in a non-blank.
    """
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size, min(len(text), at + 2 * size))
        if m:
            cut = m.start()
        else:
            ends = ((t.group()[-1], t.end()) for t in _TOKEN.finditer(text, at) if t.end() >= at + size)
            cut = next((end for last, end in ends if not last.isspace() and text[end : end + 1] not in "\x1c\x1d\x1e\x1f"), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(enc, text: str | None) -> list[int]:
    """Ids of a text; an empty and a null text have none."""
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def _shared(df: DataFrame, rank_file: str | None):
    with open(rank_file or default_rank_file(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size, under 1 MB


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """(id, ids array<int>) of each row. Empty and null texts have the empty list; other columns are dropped.

    No shuffle: one pass over Arrow batches. The vocabulary is read by the driver and reaches the executors as
    a broadcast of one file.
    """
    ranks = _shared(docs, rank_file)

    def run(batches):
        import pyarrow as pa

        enc = encoder(ranks.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            lo, ids, offsets = 0, [], [0]
            for i in range(batch.num_rows):
                ids += encode(enc, texts[i].as_py())
                offsets.append(len(ids))
                if len(ids) > 500_000 or i + 1 == batch.num_rows:
                    values = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(ids, np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, i + 1 - lo), values], [id_col, "ids"])
                    lo, ids, offsets = i + 1, [], [0]

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def token_counts(docs: DataFrame, text_col: str, rank_file: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``n_tokens`` (0 for null and empty texts); one pass, no shuffle."""
    ranks = _shared(docs, rank_file)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        import pyarrow as pa

        enc = encoder(ranks.value)
        for batch in batches:
            texts = batch.column(len(rest))
            n = pa.array([len(encode(enc, texts[i].as_py())) for i in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], n], [*rest, "n_tokens"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, text_col).mapInArrow(run, f"{kinds}, n_tokens long")


def token_texts(ids: DataFrame, id_col: str = "doc_id", rank_file: str | None = None) -> DataFrame:
    """(id, text) from (id, ids): the bytes of all tokens are joined first and decoded once, so that characters that
    span tokens come out whole. A null list gives a null text; bytes that aren't UTF-8 become U+FFFD."""
    ranks = _shared(ids, rank_file)

    def run(batches):
        import pyarrow as pa

        enc = encoder(ranks.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = ids.schema[id_col].dataType.simpleString()
    return ids.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")
