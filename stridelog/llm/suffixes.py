"""Operator 8: repeated passages by a depth-limited radix sort of suffixes.

Only the first ``depth`` bytes of a suffix count, so suffixes that sort equal are
exactly the repeated windows. Suffixes are sorted by most significant digits in
three passes, each over what the one before left:

1. A window is filed under its anchor, the least hashed gram within it; all
   windows filed under one anchor share it, and equal windows have equal anchors
   in equal places. Anchors alone in the corpus end here (most do).
2. Anchors whose whole run of windows, one string, occurs again need no more:
   all their windows are repeated.
3. The rest bring their bytes, and within an anchor's group windows are sorted by
   eight-byte digits from the first to the last; groups of one drop out.

Equal anchors of one batch of documents are settled there and travel once, the
others' windows as stretches that are as long as they can be, so a periodic text
takes rows by its period and not by its length. Large groups are compared in pairs of blocks. Digests only file or accept whole runs
under 128 bits; pass 3 compares bytes.

Defined results: null and empty texts have nothing to remove; texts shorter than
``depth`` neither; a row that repeats counts as another document, so all of it
goes from ``depth`` bytes on; null ids stay null; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buckets import deal, unit_starts, units
from .shared import materialize, table, text_of

DEPTH, WINDOW = 200, 128
#: Anchors' contexts in a block.
CAP = 1024
#: Windows whose anchors are found together, and anchors that become Python numbers together: bound memory for very long texts.
AT_ONCE, LISTED = 1 << 20, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=24)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def anchors(raw: bytes, depth: int = DEPTH, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first window, windows) of each anchor's run, piece by piece of a long text."""
    gram, last = depth - window + 1, len(raw) - depth
    size = 1 << max(12, min(AT_ONCE + depth, len(raw) + 1).bit_length())
    up, down = _powers(size)
    for at in range(0, last + 1, AT_ONCE):
        b = np.frombuffer(raw, np.uint8, min(AT_ONCE + depth - 1, len(raw) - at), at)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)], dtype=np.uint64)])
        n = len(b) - gram + 1
        h = _mixed((sums[gram:] - sums[:n]) * down[:n])
        # the least hash, and of equal ones the leftmost: the place fills the low bits
        least = (h & _U(~0xFFFFFF & 2**64 - 1)) | np.arange(n, dtype=np.uint64)
        step = 1
        while step < window:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        place = (least & _U(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        found = h[place[first]].view(np.int64), first + at, np.diff(np.append(first, len(place)))
        for part in range(0, len(first), LISTED):
            yield tuple(x[part : part + LISTED] for x in found)


def repeated(buffer: bytes, starts: np.ndarray, group: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which windows occur again in their group: MSD radix passes over eight-byte digits."""
    eight = np.ndarray((max(0, len(buffer) - 7),), ">u8", buffer, strides=(1,))
    alive, g = np.arange(len(starts)), group
    for d in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        digit = eight[starts[alive] + d].astype(np.uint64)
        order = np.lexsort((digit, g))
        gs, ds = g[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])
        g = np.cumsum(new) - 1
        shared = np.bincount(g, minlength=1)[g] > 1 if len(g) else np.zeros(0, bool)
        alive, g = alive[order][shared], g[shared]
        if not len(alive):
            break
    out = np.zeros(len(starts), bool)
    out[alive] = True
    return out


def _runs(depth: int, window: int) -> Callable:
    """Pass 1 and 2 within a batch of documents: one row per anchor, equal runs only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict[tuple[int, int], int] = {}
            rows: list[list] = []
            for doc, k, text in zip(ids, ks, batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                if len(raw) < depth:
                    continue
                whole: list | None = None
                for h, first, n in anchors(raw, depth, window):
                    for anchor, a, own in zip(h.tolist(), first.tolist(), n.tolist(), strict=True):
                        span = xxhash.xxh3_64_intdigest(raw[a : a + own - 1 + depth]) - 2**63
                        before = seen.setdefault((anchor, span), len(rows))
                        if before < len(rows):  # settled here: the first one speaks for all of them
                            rows[before][7] = 2
                            if whole is not None and whole[2] + whole[3] == a:  # a periodic text is one stretch, not a row a byte
                                whole[3] += own
                                continue
                            whole = [doc, k, a, own, xxhash.xxh3_64_intdigest(f"{doc} {k} {a}") - 2**63, anchor, span, 0]
                            rows.append(whole)
                        else:
                            rows.append([doc, k, a, own, anchor, anchor, span, 1])
            for at in range(0, len(rows), 100_000):
                part = list(zip(*rows[at : at + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], ["doc_id", "k", "first", "own", "key", "anchor", "span", "weight"])

    return run


def _contexts(depth: int) -> Callable:
    """The bytes of each run that needs pass 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "blocks", "doc_id", "k", "first", "own_windows", "bytes"]
        types = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            rows = []
            for doc, k, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                rows += [(r["anchor"], r["blocks"], doc, k, r["first"], r["own"], raw[r["first"] : r["first"] + r["own"] - 1 + depth]) for r in runs]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 20_000], strict=True), types, strict=True)], names)

    return run


def _sorted_windows(depth: int) -> Callable:
    """Pass 3: repeated windows of each unit, as stretches of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches, 4000):
            begin = unit_starts(t)
            unit = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, t.num_rows)))
            own, first, texts = t.column("own_windows").to_numpy(), t.column("first").to_numpy(), t.column("bytes").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]])
            row = np.repeat(np.arange(len(own)), own)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            again = repeated(b"".join(texts), at[row] + nth, unit[row], depth)
            row, start = row[again], (first[row] + nth)[again]
            if not len(row):
                continue
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            lead = np.flatnonzero(new)
            n = np.diff(np.append(lead, len(row)))
            who = t.select(["doc_id", "k"]).take(pa.array(row[lead])).combine_chunks()
            yield pa.RecordBatch.from_arrays([who.column(0).combine_chunks(), who.column(1).combine_chunks(), pa.array(start[lead], pa.int64()), pa.array(start[lead] + n - 1 + depth, pa.int64())], ["doc_id", "k", "a", "b"])

    return run


def stretches(docs: DataFrame, depth: int = DEPTH, window: int = WINDOW, cap: int = CAP) -> DataFrame:
    """doc_id, k, a, b: stretches of bytes covered by repeated windows. ``docs``: doc_id, k, text."""
    runs = docs.mapInArrow(_runs(depth, window), "doc_id bigint, k bigint, first bigint, own bigint, key bigint, anchor bigint, span bigint, weight bigint")
    group, same = Window.partitionBy("key"), Window.partitionBy("key", "span")
    counted = runs.select("*", F.sum("weight").over(group).alias("in_group"), F.sum("weight").over(same).alias("as_run"), F.row_number().over(same.orderBy("k", "first")).alias("nth"))
    alive = counted.where("weight = 0 OR in_group > 1").withColumn("whole", F.expr("weight = 0 OR as_run > 1"))
    # a run settled as a whole still stands, once, for others of its group
    brings = F.expr("weight > 0 AND (NOT whole OR nth = 1)")
    alive = alive.withColumn("brings", brings & F.max(F.when(~F.col("whole"), True).otherwise(False)).over(group))
    alive = alive.withColumn("members", F.sum(F.col("brings").cast("int")).over(group))
    alive = materialize(alive.select("doc_id", "k", "first", "own", "anchor", "whole", "brings", F.ceil(F.col("members") / cap).cast("bigint").alias("blocks")))
    lists = alive.where("brings AND blocks IS NOT NULL").groupBy("doc_id", "k").agg(F.collect_list(F.struct("anchor", "blocks", "first", "own")).alias("runs"))
    named = docs.select(F.col("doc_id").alias("d"), F.col("k").alias("dk"), "text")
    joined = named.join(lists, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("dk") == F.col("k"))).select("doc_id", "k", "text", "runs")
    context = joined.mapInArrow(_contexts(depth), "bucket bigint, blocks bigint, doc_id bigint, k bigint, first bigint, own_windows bigint, bytes binary")
    cut = context.withColumn("own", F.pmod(F.xxhash64("k", "first"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = deal(cut.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other"))
    third = dealt.mapInArrow(_sorted_windows(depth), "doc_id bigint, k bigint, a bigint, b bigint")
    return alive.where("whole").select("doc_id", "k", F.col("first").alias("a"), (F.col("first") + F.col("own") - 1 + depth).alias("b")).unionByName(third)


def cut_out(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays, bytes removed, maximal runs removed."""
    kept, at, removed, spans, upto = [], 0, 0, 0, -1
    for a, b in sorted(runs):
        if a > upto:
            kept.append(raw[at:a])
            spans += 1
            upto = a
        if b > upto:
            removed += b - max(a, upto)
            upto = at = b
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def remove_repeats(docs: DataFrame, depth: int = DEPTH, window: int = WINDOW, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k, n_bytes, n_removed, n_spans, kept_sha256, kept (the text left; a character cut in two goes)."""
    own = text_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("k"), "text")
    lists = stretches(own, depth, window, cap).groupBy(F.col("doc_id").alias("d"), F.col("k").alias("dk")).agg(F.collect_set(F.struct("a", "b")).alias("cuts"))
    joined = own.join(lists, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("dk") == F.col("k")), "left").select("doc_id", "k", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc, k, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                kept, removed, spans = cut_out(raw, [(c["a"], c["b"]) for c in cuts or ()])
                rows.append((doc, k, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), text if not removed else kept.decode("utf-8", errors="ignore")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("k", "kept")
