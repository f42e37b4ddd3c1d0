"""Encoding a corpus with a public tokenizer's rank file, and decoding ids back to text."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("SKARV_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are encoded in parts.
PART = 200_000
#: White space after something else: no piece of PATTERN goes on across this place, and none looks ahead over it.
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(2)
def encoding(path: str):
    """The tiktoken encoding of a rank file (base64 token and rank per line), without special tokens. Once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in order, cut where no token crosses: before white space that follows other characters.

    A part is longer than `size` only where a longer stretch has no such place.
    """
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(text: str | None, enc) -> np.ndarray:
    """Ids of a text; none for null and empty texts. Strings of special tokens are ordinary text."""
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= PART:
        return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32).astype(np.int32)
    return np.concatenate([encode(p, enc) if len(p) <= PART else np.asarray(enc.encode_ordinary(p), np.int32) for p in parts(text)])


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids ARRAY<INT> of each row: the text by `vocabulary`, no special tokens.

    Null and empty texts give an empty list (null ids never occur); repeated rows are repeated; row order doesn't matter;
    other columns are left out. A map over the rows: nothing is shuffled or counted. The rank file is read by each worker
    from `folder`, which every node must have.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            found = [encode(t, enc) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            ids = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, text: the bytes of the ids joined, then read as UTF-8 once, so characters split over tokens survive.

    Null or empty ids give the empty text. An id outside the vocabulary is an error.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            texts = [enc.decode_bytes(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
