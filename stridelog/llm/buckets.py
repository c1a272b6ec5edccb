"""Comparing rows within buckets, whatever a bucket's size.

A bucket of more than ``cap`` rows is cut into blocks by a hash of the node, and
each pair of blocks is a task's unit of its own: no unit holds more than two
blocks, and work of a hot bucket spreads over as many units as it has block
pairs. Within units only spanning forests leave Python, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs looked at together: some 100 MB of arrays at most.
PAIRS_AT_ONCE = 1_000_000


def in_blocks(rows: DataFrame, cap: int, few: bool = False, key: str = "bucket", node: str = "node") -> DataFrame:
    """Adds own, lo, hi: the row's block and the block pair this copy of it is for.

    The heavy buckets are broadcast only where the caller says that the key space
    has ``few`` keys (some millions at most); else the optimizer joins them.
    """
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > cap).select(F.col(key).alias("heavy"), F.ceil(F.col("rows") / cap).cast("int").alias("blocks"))
    cut = rows.join(F.broadcast(heavy) if few else heavy, F.col(key) == F.col("heavy"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = cut.withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("heavy", "blocks", "with")


def deal(rows: DataFrame, key: str = "bucket") -> DataFrame:
    """Each unit's rows together, one after another."""
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "own")


def units(batches: Iterator[pa.RecordBatch], at_least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole units from sorted batches: key, lo, hi are columns of each."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < at_least:
            continue
        t = pa.concat_tables(held)
        starts = unit_starts(t)
        if starts[-1] > 0:
            yield t.slice(0, starts[-1])
            t = t.slice(starts[-1])
        held, rows = [t], t.num_rows
    if held:
        yield pa.concat_tables(held)


def unit_starts(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("bucket", "lo", "hi"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within units, once per pair of blocks, in pieces."""
    starts = unit_starts(t)
    ends = np.repeat(np.append(starts[1:], t.num_rows), np.diff(np.append(starts, t.num_rows)))
    own, cross = t.column("own").to_numpy(), t.column("lo").to_numpy() != t.column("hi").to_numpy()
    index = np.arange(t.num_rows)
    partners = ends - index - 1
    upto = np.cumsum(partners)
    at = 0
    while at < t.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = partners[at:stop]
        a = np.repeat(index[at:stop], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        keep = ~cross[a] | (own[a] != own[b])
        yield a[keep], b[keep]
        at = stop


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for each node that is not itself the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        lx, ly = label[x], label[y]
        differ = lx != ly
        x, y = x[differ], y[differ]
        np.minimum.at(label, np.maximum(lx, ly)[differ], np.minimum(lx, ly)[differ])
        while (label != (further := label[label])).any():
            label = further
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def linked(dealt: DataFrame, near: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """a, b: forests of the pairs for which ``near`` says yes; no more rows than the units have.

    Pairs that a unit's earlier pairs connect already are not asked again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches):
            label = np.arange(t.num_rows)
            a = b = np.empty(0, np.int64)
            for i, j in pairs(t):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                yes = near(t, i, j)
                if yes.any():
                    a, b = forest(np.concatenate([a, i[yes]]), np.concatenate([b, j[yes]]))
                    label[a] = b
            if len(a):
                node = t.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")
