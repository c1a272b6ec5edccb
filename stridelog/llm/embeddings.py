"""Operator 10: embedding near-duplicates by a forest of random-projection trees.

Each tree splits by random directions where a bounded sample is thin about its median;
vectors near a split go to both sides (spill). Vectors are compared within leaves of their own
label, in double precision; links are verified, counted and united.

Trees grow until leaves are small, whatever the table's size: a label of more than
``LEAF`` vectors gets ``TREES`` trees as deep as a sample of its own supports, and
a leaf that is still large is split further by a tree of one, fit on a sample of
that leaf, again and again. Samples are of ``SAMPLE`` vectors; every vector is
indexed. Trees are tables and meet the vectors in groups of ``TOGETHER``, so neither
their number nor a hot label is bound to one task or the driver. Only a leaf that a
split hardly divides (vectors all alike) stays large; its blocks are compared in
pairs, as are all leaves of over ``CAP`` vectors.

Equal vectors are one class and travel once. A pair that shares several leaves
counts in the first of them only.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing; vectors of different
lengths do not compare; rows that repeat a vec_id are vectors of their own; a null
vec_id counts as a link of others but is no component's name; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import deal, forest, unit_starts, units
from .components import components
from .shared import materialize, table

THRESHOLD = 0.98
TREES, LEAF, SAMPLE = 4, 128, 8192
#: Vectors of a sample at the end of a tree's branch.
SAMPLE_LEAF = 16
#: Half the width of a split's overlap, in standard deviations of a pair's projected distance at the threshold.
SPILL = 1.0
#: Quantiles that may be split points, and the share of vectors that a split may put on both sides.
MIDDLE, TORN = (0.3, 0.7), 0.3
CAP, TOGETHER, SEED = 512, 20_000, 11
#: A part of at least this share of its leaf is not divided any more.
HARDLY = 0.9


class Tree:
    """Split points in heap order; directions follow from the seed. A leaf is the path to it."""

    def __init__(self, cuts: np.ndarray, dim: int, margin: float, seed: tuple[int, ...]):
        self.cuts, self.margin = cuts, margin
        self.depth = int(len(cuts) + 1).bit_length() - 1
        self.directions = np.random.default_rng([SEED, *seed]).normal(size=(self.depth, 8, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, margin: float, seed: tuple[int, ...]) -> Tree:
        own = cls(np.zeros(2**depth - 1), sample.shape[1], margin, seed)
        nodes = [(1, 0, sample)]
        while nodes:
            node, level, rows = nodes.pop()
            if level < depth:
                p = own._projected(rows, node, level)
                own.cuts[node - 1] = cut = own._cut(np.sort(p))
                nodes += [(2 * node, level + 1, rows[p <= cut + margin]), (2 * node + 1, level + 1, rows[p > cut - margin])]
        return own

    def _cut(self, p: np.ndarray) -> float:
        """Of the middle quantiles the one with the fewest vectors beside it; infinite (all to one side) if these are too many.

        At the median itself a group of near vectors would go to both sides, again and again.
        """
        if not len(p):
            return np.inf
        tried = p[(np.linspace(*MIDDLE, 33) * (len(p) - 1)).astype(int)]
        beside = np.searchsorted(p, tried + self.margin, "right") - np.searchsorted(p, tried - self.margin, "left")
        best = int(np.lexsort((np.abs(np.arange(33) - 16), beside))[0])
        return float(tried[best]) if beside[best] <= TORN * len(p) else np.inf

    def _projected(self, x: np.ndarray, node: int, level: int) -> np.ndarray:
        return x @ self.directions[level, node % 8]

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for all leaves that have rows."""
        stack = [(1, 0, np.arange(len(x)))]
        while stack:
            node, level, rows = stack.pop()
            if not len(rows):
                continue
            if level == self.depth:
                yield node, rows
                continue
            p = self._projected(x[rows], node, level) - self.cuts[node - 1]
            stack += [(2 * node, level + 1, rows[p <= self.margin]), (2 * node + 1, level + 1, rows[p > -self.margin])]


def _margin(threshold: float, dim: int) -> float:
    return SPILL * math.sqrt(2 - 2 * threshold) / math.sqrt(dim) / 2


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    # scaled first: squares of very large or very small components would not hold
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def read_vectors(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, vector: float64 bytes, null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array(v if v and None not in v else [0.0], np.float64)
                out.append((x + 0.0).tobytes() if label is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    own = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return own.mapInArrow(run, "vec_id bigint, label string, vector binary")


def _grown(leaf: int, threshold: float, trees: int, round_: int):
    """Trees of one label's leaf, from a sample of it."""

    def fit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label, own, rows = keys
        x = _unit([bytes(v) for v in pdf["vector"]])
        depth = max(1, min(math.ceil(math.log2(rows / leaf)), int(math.log2(max(2, len(x) / SAMPLE_LEAF)))))
        made = [Tree.fit(x, depth, _margin(threshold, x.shape[1]), (round_, t)).cuts for t in range(trees)]
        return pd.DataFrame({"label": [label], "leaf": [own], "trees": [made]})

    return fit


def _divided(threshold: float, round_: int):
    """Some of a leaf's vectors, each under the leaves that its trees put it in."""

    def run(keys: tuple, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        columns = ["label", "leaf", "node", "n", "vector", "parent"]
        if not len(rows) or not len(model):
            return pd.DataFrame({c: [] for c in columns})
        x, parts = _unit([bytes(v) for v in rows["vector"]]), []
        for t, cuts in enumerate(model["trees"].iloc[0]):
            for path, at in Tree(np.asarray(cuts), x.shape[1], _margin(threshold, x.shape[1]), (round_, t)).leaves(x):
                part = rows.iloc[at][["label", "node", "n", "vector", "rows"]].rename(columns={"rows": "parent"})
                # 64 bits name a leaf: two that got one name by chance would only be compared together
                parts.append(part.assign(leaf=xxhash.xxh3_64_intdigest(f"{keys[1]} {round_} {t} {path}") - 2**63))
        return pd.concat(parts, ignore_index=True)[columns]

    return run


def forest_leaves(classes: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """label, leaf, node, n, vector: a row per class and leaf; vectors of one length only share leaves."""
    left = classes.select("label", F.octet_length("vector").cast("bigint").alias("leaf"), "node", "n", "vector", F.lit(None).cast("bigint").alias("parent"))
    columns = ["label", "leaf", "node", "n", "vector"]
    done: list[DataFrame] = []
    for round_ in itertools.count():  # each makes leaves smaller
        sizes = left.groupBy("label", "leaf").agg(F.count(F.lit(1)).alias("rows"), F.max("parent").alias("of"))
        large = materialize(sizes.where((F.col("rows") > (2 if round_ else 1) * leaf) & (F.col("of").isNull() | (F.col("rows") < HARDLY * F.col("of")))).select(F.col("label").alias("l"), F.col("leaf").alias("f"), "rows"))
        told = left.join(large, (F.col("label") == F.col("l")) & (F.col("leaf") == F.col("f")), "left")
        done.append(told.where("rows IS NULL").select(*columns))
        if large.isEmpty():
            break
        own = told.where("rows IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / TOGETHER)))
        few = own.where(F.pmod(F.xxhash64("node", F.lit(round_)), F.ceil(F.col("rows") / sample)) == 0)
        models = few.groupBy("label", "leaf", "rows").applyInPandas(_grown(leaf, threshold, 1 if round_ else trees, round_), "label string, leaf bigint, trees array<array<double>>")
        models = models.join(large, (F.col("label") == F.col("l")) & (F.col("leaf") == F.col("f"))).select("label", "leaf", "trees", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("rows") / TOGETHER) - 1)).alias("salt"))
        keys = ["label", "leaf", "salt"]
        left = materialize(own.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInPandas(_divided(threshold, round_), "label string, leaf bigint, node bigint, n bigint, vector binary, parent bigint"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches, 2000):
            for begin, end in zip(starts := unit_starts(t).tolist(), [*starts[1:], t.num_rows], strict=True):
                if end - begin < 2:
                    continue
                u = t.slice(begin, end - begin)
                same = u.column("lo")[0].as_py() == u.column("hi")[0].as_py()
                own, node, size, leaf = (u.column(c).to_numpy() for c in ("own", "node", "n", "leaf"))
                by = {}
                for i, v in enumerate(u.column("vector").to_pylist()):
                    by.setdefault((len(v), u.column("label")[i].as_py()), []).append((i, v))
                lists = u.column("leaves").to_pylist()
                count, a, b = np.zeros(len(node), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                for group in by.values():
                    rows, x = np.array([i for i, _ in group]), _unit([v for _, v in group])
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                    i, j = rows[i], rows[j]
                    if not same:
                        cross = own[i] != own[j]
                        i, j = i[cross], j[cross]
                    if not len(i):
                        continue
                    first = np.zeros(len(i), bool)  # is this the first leaf that both share?
                    wide = max(len(lists[k]) for k in rows.tolist())
                    m = np.full((len(node), wide), np.iinfo(np.int64).max)
                    for k in rows.tolist():
                        m[k, : len(lists[k])] = lists[k]
                    for at in range(0, len(i), 50_000):
                        mi, mj = m[i[at : at + 50_000]], m[j[at : at + 50_000]]
                        shared = np.where((mi[:, :, None] == mj[:, None, :]).any(axis=2), mi, np.iinfo(np.int64).max).min(axis=1)
                        first[at : at + 50_000] = shared == leaf[i[at : at + 50_000]]
                    i, j = i[first], j[first]
                    count += np.bincount(i, weights=size[j], minlength=len(node)).astype(np.int64) + np.bincount(j, weights=size[i], minlength=len(node)).astype(np.int64)
                    a, b = forest(np.concatenate([a, node[i]]), np.concatenate([b, node[j]]))
                some = np.flatnonzero(count)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, node[some]])), pa.array(np.concatenate([b, node[some]])), pa.array(np.concatenate([np.zeros(len(a), np.int64), count[some]]))], ["a", "b", "links"])

    return run


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, cap: int = CAP, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = materialize(read_vectors(df, id_col, label_col, vector_col))
    classes = materialize(rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    filed = materialize(forest_leaves(classes, trees, leaf, threshold=threshold)).withColumn("bucket", F.xxhash64("label", "leaf"))
    lists = filed.groupBy(F.col("node").alias("listed")).agg(F.collect_list("leaf").alias("leaves"))
    filed = filed.join(lists, F.col("node") == F.col("listed")).drop("listed")
    heavy = filed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / cap).cast("int").alias("blocks")).where("blocks > 1").withColumnRenamed("bucket", "heavy")
    cut = filed.join(heavy, F.col("bucket") == F.col("heavy"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    copies = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = deal(copies.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("heavy", "blocks", "other"))
    found = materialize(dealt.mapInArrow(_compared(threshold), "a bigint, b bigint, links bigint"))
    links = found.where("links > 0").groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    joined = components(found.where("links = 0").select("a", "b"))
    named = classes.join(links, F.col("node") == F.col("linked"), "left").join(joined.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    named = named.select(F.col("label").alias("l"), F.col("vector").alias("v"), "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("own"))
    first = named.groupBy(F.col("own").alias("of")).agg(F.min("least").alias("component_id"))
    named = named.join(first, F.col("own") == F.col("of")).select("l", "v", "n_links", "component_id")
    out = rows.join(named, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
