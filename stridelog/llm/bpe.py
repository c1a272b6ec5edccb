"""Operator 3: byte-level BPE by a priority queue of merge ranks.

Each word is a doubly linked list of symbols. A heap holds rank and position of
mergeable neighbours, as one integer; a rank names one pair, so an entry is stale,
and skipped, if the pair now at its position has another rank. Decoding concatenates vocabulary strings.
The vocabulary file is a parameter and only its data is used: the code below
does the merging itself.

Defined results: null text encodes as empty (0 ids, digests of nothing); null
ids stay null; repeated rows repeat; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .pieces import Memory, parts
from .shared import table, text_of

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """byte -> printable character: printable Latin-1 as itself, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class BPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:  # the vocabulary is a file of the installed library, on every machine
            data = json.load(f)
        model, alphabet = data["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: left id * 2**20 + right id -> rank * 2**32, and rank -> merged id.
        self.ranks = {vocab[a] << 20 | vocab[b]: rank << 32 for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [vocab[a + b] for a, b in pairs]
        #: The same for two bytes, at left * 256 + right; -1: no merge.
        self.byte_ranks = [self.ranks.get(a << 20 | b, -1) for a in self.byte_id for b in self.byte_id]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        byte_of = {c: b for b, c in alphabet.items()}
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word_ids = Memory(lambda ws: [self.merge(w.encode()) for w in ws])
        self.first = Memory(lambda keys: [self._part(k) for k in keys])
        self.rest = Memory(lambda keys: [self._part(f" {k}") for k in keys])

    def merge(self, word: bytes) -> tuple[int, ...]:
        merged, byte_ranks = self.merged, self.byte_ranks
        symbols = list(map(self.byte_id.__getitem__, word))
        n = len(symbols)
        queue = [r | i for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if (r := byte_ranks[a << 8 | b]) >= 0]
        if not queue:
            return tuple(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        symbols.append(-1)  # the end: no pair has it
        get, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = right[i]
            if symbols[i] < 0 or symbols[j] < 0 or get(symbols[i] << 20 | symbols[j]) != entry - i:
                continue  # stale
            symbols[i] = new = merged[entry >> 32]
            symbols[j] = -2  # gone
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := get(new << 20 | symbols[k])) is not None:
                    push(queue, r | i)
            if (h := left[i]) >= 0 and (r := get(symbols[h] << 20 | new)) is not None:
                push(queue, r | h)
        return tuple([s for s in symbols if s >= 0])

    def _ids(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            ids += chain.from_iterable(self.word_ids.of(self.words.findall(text[at : m.start()])))
            ids.append(self.special[m[0]])
            at = m.end()
        ids += chain.from_iterable(self.word_ids.of(self.words.findall(text[at:] if at else text)))
        return ids

    def _part(self, text: str) -> tuple[str, bytes]:
        """A part's ids as decimal text, and the vocabulary strings of these ids put together."""
        ids = self._ids(text)
        return ",".join(map(str, ids)), b"".join(map(self.strings.__getitem__, ids))

    def _parts(self, text: str) -> list[tuple[str, bytes]]:
        head, *tail = parts(text)
        return self.first.of([head]) + self.rest.of(tail)

    def encode(self, text: str) -> list[int]:
        said = ",".join([s for s, _ in self._parts(text) if s])
        return list(map(int, said.split(","))) if said else []

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the decimal ids, sha256 of the text decoded from them."""
        own = self._parts(text)
        said = ",".join([s for s, _ in own if s])
        decoded = b"".join([b for _, b in own]).decode("utf-8", errors="replace")
        return said.count(",") + bool(said), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=2)
def load(name: str) -> BPE:
    return BPE(public_tokenizers.path(name))


def encode(docs: DataFrame, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the whole text's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([load(name).encode(text)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([load(name).decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [load(name).digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
