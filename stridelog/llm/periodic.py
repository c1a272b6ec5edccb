"""Operator 13: runs of words that repeat with a period, by sparse diagonals.

The diagonal of lag q holds the words that equal the word q places before. A stretch
of L matches on it is a run of q + L words, and counts if that is at least
``max(least, 2 * q)``. Lags below ``least`` are few and each is read as a dense
diagonal. Beyond them a run needs q matches in a row, so a diagonal is active only
where the last W words occurred before, for the power of two times ``least`` with
W <= q < 2 * W: an earlier occurrence of a window, not of one frequent word, opens
or lengthens the diagonal. Matches of a diagonal that touch are one stretch; where it
ends, a sufficient one is a run.

Within one short-period stretch every window recurs at every multiple of its
period, and across two such stretches at a whole progression of lags; word by word
that is quadratic. Occurrences at most W / 2 apart are therefore one cluster, a
progression: inside a cluster all lags are multiples of the shorter period and no
run's smallest period, and between two clusters each lag gets one interval. Each
position has a bounded number of neighbouring clusters a window size, so work is
O(n log n) for any text, and nothing is capped.

Of stretches with the same place the smallest period stays: a multiple of a run's
period matches the same stretch.

Defined results: null and empty texts have no words and no runs; a null id stays
null; repeated rows give repeated results; words are case-sensitive and compare as
bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table, text_of

LEAST = 12
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _dense(word: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """start, length, period of sufficient stretches of each lag below ``least``."""
    for q in range(1, min(least, len(word))):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (word[q:] == word[:-q]).view(np.int8), [0]])))
        begin, length = edges[::2], edges[1::2] - edges[::2] + q
        long = length >= max(least, 2 * q)
        if long.any():
            yield begin[long], length[long], np.full(long.sum(), q)


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row by its value, and which values recur."""
    _, name, n = np.unique(keys, return_inverse=True, return_counts=True)
    return name, n[name] > 1


def _windows(word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ``width`` words recur, ascending, and exact names of these windows."""
    hashed = word.astype(np.uint64)
    for k in range(1, width):  # mixed between words: equal windows hash alike, and few others do
        hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        hashed += word[k:].astype(np.uint64)
    at = np.flatnonzero(_names(hashed)[1])
    name = word[at]
    for k in range(1, width):  # exact: word by word for the few that are left
        if not len(at):
            break
        name, again = _names(name * np.int64(len(word) + 1) + word[at + k])
        at, name = at[again], name[again]
    return at, name


def _intervals(at: np.ndarray, name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """lag, begin: matches of ``width`` words and more that open at ``begin``, for lags from width to twice it; and their ends."""
    order = np.argsort(name, kind="stable")
    p, u = at[order], name[order]
    apart = np.ones(len(p), bool)
    apart[1:] = (u[1:] != u[:-1]) | (p[1:] - p[:-1] > width // 2)
    head = np.flatnonzero(apart)
    tail = np.append(head[1:], len(p)) - 1
    first, last, kind = p[head], p[tail], u[head]
    step = np.where(tail > head, p[np.minimum(head + 1, len(p) - 1)] - first, 0)
    lags, begins, ends, k = [], [], [], 1
    while k < len(head):
        a, b = np.arange(len(head) - k), np.arange(k, len(head))
        near = (kind[a] == kind[b]) & (first[b] - last[a] < 2 * width)
        if not near.any():
            break
        a, b = a[near], b[near]
        d = np.maximum(np.maximum(step[a], step[b]), 1)
        low, high = first[b] - last[a], last[b] - first[a]
        low += np.maximum(0, -((low - width) // d)) * d  # the least lag of the progression that is not below width
        n = np.maximum(0, (np.minimum(high, 2 * width - 1) - low) // d + 1)
        n = np.where(low <= high, n, 0)
        pair = np.repeat(np.arange(len(a)), n)
        lag = low[pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)) * d[pair]
        lags.append(lag)
        begins.append(np.maximum(first[b][pair], first[a][pair] + lag))
        ends.append(np.minimum(last[b][pair], last[a][pair] + lag) + width)
        k += 1
    if not lags:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(lags), np.concatenate(begins), np.concatenate(ends)


def _sparse(word: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """start, length, period of sufficient stretches of lags from ``least`` on."""
    width = least
    if len(word) < 2 * width:
        return
    at, name = _windows(word, width)
    while len(at):
        lag, begin, end = _intervals(at, name, width)
        if len(lag):
            order = np.lexsort((begin, lag))
            lag, begin, end = lag[order], begin[order], end[order]
            # along each diagonal: an interval that begins after all before it have ended opens a stretch
            span = np.int64(len(word) + 1)
            reach = np.maximum.accumulate(lag * span + end)
            opens = np.ones(len(lag), bool)
            opens[1:] = lag[1:] * span + begin[1:] > reach[:-1]
            heads = np.flatnonzero(opens)
            q, lo, hi = lag[heads], begin[heads], np.maximum.reduceat(end, heads)
            enough = hi - lo >= q
            yield lo[enough] - q[enough], hi[enough] - lo[enough] + q[enough], q[enough]
        # windows twice as long, from two that touch
        there = np.searchsorted(at, at + width)
        both = there < len(at)
        both[both] = at[there[both]] == at[both] + width
        pair, again = _names(name[both] * np.int64(len(word) + 1) + name[there[both]])
        at, name, width = at[both][again], pair[again], 2 * width


def runs_of(word: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, smallest period of all runs of numbered words, by start, then period."""
    found = [*_dense(word, least), *_sparse(word, least)]
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for words that a run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), text (its words after each run's first period removed, joined by a space). One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            split = [t.encode().split() for t in batch.column("text").to_pylist()]  # bytes split at exactly these six blanks
            sizes = np.array([len(w) for w in split])
            upto = np.cumsum(sizes + 1)
            number, _ = pd.factorize(np.array([x for w in split for x in (*w, None)], object), use_na_sentinel=True)
            number = number.astype(np.int64)
            # a number of its own between texts: no window or diagonal matches across
            number[upto - 1] = number.max(initial=0) + 1 + np.arange(len(split))
            start, length, period = runs_of(number, least)
            owner = np.searchsorted(upto, start, side="right")
            kept = kept_words(len(number), start, length, period)
            edge = np.searchsorted(owner, np.arange(len(split) + 1))
            cut = set(owner.tolist())
            texts = [b" ".join([w[i] for i in np.flatnonzero(kept[upto[k] - 1 - sizes[k] : upto[k] - 1])]) if k in cut else b" ".join(w) for k, w in enumerate(split)]
            rows = pa.StructArray.from_arrays([pa.array(start - (upto - 1 - sizes)[owner]), pa.array(length), pa.array(period)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), rows), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "n_words", "runs", "text"])

    return text_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def plant(text: str, h: int) -> str:
    """``text`` with a periodic tail if the query's rule for ``h`` asks for one."""
    words = text.encode().split()
    n, g = len(words), h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, by the query's rule; a text of null id stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t if i is None else plant(t, zlib.crc32(str(i).encode())) for i, t in zip(ids, texts)], pa.string())], ["doc_id", "text"])

    return text_of(docs).mapInArrow(run, "doc_id bigint, text string")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from those of ``periodic_runs``."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    of = found.withColumn("best", best)
    length, period = -F.col("best.less"), F.col("best.period")
    return of.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("bigint").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))
