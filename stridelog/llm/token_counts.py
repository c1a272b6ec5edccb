"""Operator 1: token counts by overlap resynchronisation.

A document longer than ``chunk_chars`` is encoded in overlapping chunks with
offsets. Two neighbouring chunks are spliced at a character position in their
overlap where both have a token boundary and which is proven stable: a single
space between two non-space characters, at which the byte-level pre-tokenizer
starts a new word whatever surrounds it. If an overlap holds no such position
the overlap doubles, in the end to the rest of the document, so the count is
that of the library over the whole text. Encoding itself is left to the faster of
the installed libraries, over the same vocabulary given as ranks; tests hold its
counts against the other library on whole documents.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null id stays
null; repeated rows give repeated results; an empty table gives no rows; extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table, text_of

#: Most documents are longer than a chunk, so most counts are spliced.
CHUNK_CHARS = 2_000
OVERLAP_CHARS = 200
#: The one special string of the vocabulary; it has no rank of its own.
SPECIAL = "<|endoftext|>"
_SPACE = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class _Encoder:
    def __init__(self, name: str):
        import tiktoken

        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:  # a file of the installed library
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        self.lengths = np.zeros(len(ranks) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.lengths[-1] = len(SPECIAL)

    def ids(self, text: str) -> list[int]:
        return self.own.encode(text, allowed_special="all") if SPECIAL in text else self.own.encode_ordinary(text)

    def starts(self, text: str) -> np.ndarray:
        """The byte at which each token starts."""
        ends = np.cumsum(self.lengths[self.ids(text)])
        return np.concatenate([[0], ends])[:-1].astype(np.int64)


@lru_cache(maxsize=2)
def encoder(name: str) -> _Encoder:
    return _Encoder(name)


def _stable(text: str) -> np.ndarray:
    """Bytes of single spaces between two non-space characters: proven boundaries of any encoding."""
    at = [m.start() for m in _SPACE.finditer(text)]
    if text.isascii():
        return np.array(at, np.int64)
    width = np.cumsum([len(c.encode()) for c in text])
    return width[np.array(at, np.int64)] - 1 if at else np.array([], np.int64)


def count_by_chunks(enc: _Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of the whole text from overlapping chunks.

    ``begin`` is always a proven stable boundary, so the chunk that starts there
    is encoded as the whole text would be, up to its own last stable boundary.
    """
    total, begin, widened = 0, 0, overlap
    while True:
        end = begin + max(chunk, 2 * widened)
        left = enc.starts(text[begin:end])
        if end >= len(text):
            return total + len(left)
        from_ = end - widened
        shift = len(text[begin:from_].encode())  # bytes before the overlap
        right = enc.starts(text[from_ : end + widened]) + shift
        both = _stable(text[from_:end]) + shift
        both = both[np.isin(both, left) & np.isin(both, right)]
        if not len(both):  # the chunks never meet at a proven boundary
            widened *= 2
            continue
        common = int(both[-1])
        total += int(np.searchsorted(left, common))
        begin += len(text[begin:end].encode()[:common].decode())
        widened = overlap


def count_tokens(text: str, name: str = "byte_bpe_50k.json", chunk: int = CHUNK_CHARS) -> int:
    enc = encoder(name)
    return count_by_chunks(enc, text, chunk) if len(text) > chunk else len(enc.ids(text))


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024, chunk: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``; one narrow pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [count_tokens(t, name, chunk) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_of(docs, id_col, text_col).mapInArrow(count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
