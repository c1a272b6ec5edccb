"""Operator 4: bound-certified best-fit packing.

Tokenized documents, each followed by id 0, are packed into sequences of
``capacity`` tokens; only longer ones are cut. Pieces are dealt into partitions
of bounded size and each runs best-fit decreasing. A lower bound from dual
feasible functions certifies a partition whose number of bins equals it.
Partitions with a gap keep their full bins, exchange the documents of the other
bins, dealt anew into fewer partitions, and rerun; a rerun stands only if it
saves bins. Rounds end when every partition is certified, when a round saves
nothing, or when a single partition has rerun.

Defined results: a null or empty text is a document of the single id 0; a null
id packs like any other and stays null; repeated rows are packed once each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .pieces import Memory
from .shared import materialize, table, text_of

CAPACITY = 2048
#: Pieces in a partition: some MB of Python memory.
PER_PARTITION = 60_000
#: Strings of the vocabulary that no merge makes.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Words whose lower case is the same in any table of letters.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Of a sequence id: bins of a partition, partitions of a round. Rounds have the other 15.
_BIN_BITS, _PARTITION_BITS = 26, 22
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = f"{_PIECES}, sequence_id bigint, offset bigint, final boolean, bins bigint"


class _Words:
    """Ids of whole texts by the word-level tokenizer, from remembered words.

    Words of Latin letters are encoded by merges in order of rank, which needs no list
    of pairs: each string of the vocabulary comes from its own pair (tests prove it).

    White space ends every word of this tokenizer, and a run of letters, and what
    marks and punctuation follow it, encode apart; so parts are encoded once and
    joined. Its normalizer composes characters (NFC) before all that: a text that is
    not composed already goes to the library as a whole.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(public_tokenizers.path(name))
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.simple = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}<|>']*)")
        # the faster library over the same vocabulary: a word's last byte and the blank that ends it stand for the letter that ends a word
        byte = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(byte[c] for c in s.removesuffix("</w>")) + b" " * s.endswith("</w>"): i for s, i in vocab.items() if s not in SPECIAL}
        self.latin = tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        # words cost a call of the library, parts only their joining: words get the larger memory
        self.words, self.other, self.parts = Memory(self._words), Memory(self._each, 100_000), Memory(self._parts, 200_000)

    def _each(self, keys: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.t.encode_batch_fast(keys, add_special_tokens=False)]

    def _words(self, keys: list[str]) -> list[bytes]:
        """Words of letters, those of Latin letters by the faster library."""
        latin = [k for k in keys if LATIN.fullmatch(k)]
        if not latin:
            return self._joined(keys, self._by_library)
        of = dict(zip(latin, self._joined(latin, self._by_ranks), strict=True))
        others = [k for k in keys if k not in of]
        of.update(zip(others, self._joined(others, self._by_library) if others else [], strict=True))
        return [of[k] for k in keys]

    def _by_library(self, text: str) -> list[int]:
        return self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _by_ranks(self, text: str) -> list[int]:
        return self.latin.encode_ordinary(text.lower() + " ")

    def _joined(self, keys: list[str], encode: Callable[[str], list[int]]) -> list[bytes]:
        """Words in one call; each ends with the token that its end marks."""
        ids = np.array(encode(" ".join(keys)), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(keys):  # a letter whose lower case is not a letter
            return self._each(keys)
        raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _parts(self, keys: list[str]) -> list[bytes]:
        # letters of both tables only: the pattern's is of a newer Unicode than the library's
        found = [m if m and m[1].isalpha() else None for m in map(self.simple.fullmatch, keys)]
        words = self.words.of([m[1].lower() if m[1].isascii() else m[1] for m in found if m])
        marks = self.other.of([m[2] if m else k for m, k in zip(found, keys, strict=True)])
        words.reverse()
        return [words.pop() + x if m else x for m, x in zip(found, marks, strict=True)]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        # U+0130 in lower case is a letter and a mark, which joins what follows
        if not text.isascii() and ("İ" in text or not unicodedata.is_normalized("NFC", text)):
            return self._each([text])[0]
        return b"".join(self.parts.of(text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _words(name: str) -> _Words:
    return _Words(name)


def tokenized_pieces(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' ids, cut only beyond ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _words(name).encode(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs, id_col, text_col).mapInArrow(run, _PIECES)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of a family of dual feasible functions.

    For each threshold e up to half the capacity: sizes over capacity - e count a
    whole bin, sizes below e nothing, others their share.
    """
    return _bound(np.bincount(sizes, minlength=capacity + 1)[: capacity + 1], capacity)


def _bound(count: np.ndarray, capacity: int) -> int:
    """The same from how many pieces there are of each size."""
    if not count.sum():
        return 0
    size = np.arange(capacity + 1)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(capacity // 2 + 1)
    whole = n[-1] - n[capacity - e + 1]
    share = total[capacity - e + 1] - total[e]
    return int((whole + -(-share // capacity)).max())


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, taken in the given (decreasing) order.

    Open bins are kept by room left; a bit mask over rooms finds the fullest bin
    that still takes a piece.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for k, size in enumerate(sizes.tolist()):
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            own = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, own = capacity, used
            used += 1
        bins[k], offsets[k] = own, capacity - room
        if room := room - size:
            open_[room].append(own)
            mask |= 1 << room
    return bins, offsets, used


def _pack(round_: int, capacity: int):
    """One partition: bins, whether they are settled, and how many there are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = [f for f in frames if len(f)]
        if not own:
            return
        pdf = pd.concat(own, ignore_index=True).sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(sizes, capacity)
        certified = used == lower_bound(sizes, capacity)
        full = np.bincount(bins, weights=sizes, minlength=used) == capacity
        base = (round_ * 2**_PARTITION_BITS + TaskContext.get().partitionId()) * 2**_BIN_BITS
        pdf["sequence_id"], pdf["offset"] = base + bins, offsets
        pdf["final"] = certified | full[bins]
        pdf["bins"] = (offsets == 0).astype("int64")
        yield pdf

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Adds sequence_id and offset; ``pieces`` must be cheap to read again (a table)."""
    columns = [c.split()[0] for c in _PIECES.split(", ")]
    done, left, open_bins = [], pieces.select(*columns), None
    for r in count():  # each saves bins, so they end
        n = left.count()
        if not n and r:
            return _union(done, left)
        parts = max(1, -(-n // per_partition))
        # rows of one id, or alike in all columns, go to different partitions too
        salted = left.withColumn("salt", F.monotonically_increasing_id())
        dealt = salted.repartition(parts, F.xxhash64("doc_id", "piece", "start", "ids_crc32", "salt", F.lit(r)))
        placed = materialize(dealt.select(*columns).mapInPandas(_pack(r, capacity), _PLACED))
        bins = placed.agg(F.sum("bins").alias("all"), F.sum(F.when(~F.col("final"), F.col("bins"))).alias("open")).first()
        if open_bins is not None and (bins["all"] or 0) >= open_bins:
            break  # the exchange saved nothing: what stood before stands
        if r:
            done.pop()
        done += [placed.where("final"), placed.where("not final")]
        left, open_bins = done[-1], bins["open"] or 0
        if not open_bins or (r and parts == 1):
            break
    return _union(done, left)


def bins_and_bound(placed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Bins in use and the lower bound of any packing of the same pieces."""
    sizes = placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    count_of = np.zeros(capacity + 1, np.int64)
    for s in sizes:
        count_of[s["length"]] = s["n"]
    return placed.where("offset = 0").count(), _bound(count_of, capacity)


def _union(done: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("final", "bins")


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY, per_partition: int = PER_PARTITION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(tokenized_pieces(docs, name, capacity, id_col, text_col)), capacity, per_partition)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


__all__ = ["best_fit_decreasing", "bins_and_bound", "lower_bound", "op4_best_fit_packing", "pack", "pack_documents", "tokenized_pieces"]
