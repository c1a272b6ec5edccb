"""Embedding near-duplicates, components and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelog.llm import components, embeddings


def plain(rows, threshold=0.98):
    ok = [(i, l, np.array(v, float)) for i, l, v in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = dict.fromkeys((r[0] for r in rows), 0), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, l, x), (j, m, y) = ok[a], ok[b]
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], c := find(i), c == i) for i in links}


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(40, 16)), []
    for i in range(400):
        rows.append((i, i % 2, (base[i % 40 if i % 3 else 0] + rng.normal(size=16) * 0.05 * (i % 4)).tolist()))
    rows += [(700, None, [1.0] * 16), (701, 1, None), (702, 1, [0.0] * 16), (703, 1, [float("nan")] * 16), (704, 1, [1.0] * 15 + [None]), (705, 1, rows[5][2]), (706, 1, [2.0, 1.0]), (707, 1, [4.0, 2.0]), (708, 1, []), (709, 0, [1e200] * 16), (710, 0, [1e-200] * 16)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, node string, leaf string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, leaf=16, cap=8).collect()}
    want = plain([r for r in rows if r[0] < 709]) | {709: (1, 709, True), 710: (1, 709, False)}
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert 0.97 * there <= found <= there
    assert all(got[i][0] <= want[i][0] for i in got) and got[706] == want[706] and got[709] == want[709]
    assert all(got[i] == (0, i, True) for i in (700, 701, 702, 703, 704, 708))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_leaves_stay_small_and_recall_high(spark, monkeypatch):
    """Samples far smaller than the table: leaves are split again, and the links stay."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 32))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.08, base, np.tile(base[:1], (600, 1)) + rng.normal(size=(600, 32)) * 0.05])
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(embeddings, "TOGETHER", 500)
    rows = embeddings.read_vectors(df).withColumn("node", F.col("vec_id")).withColumn("n", F.lit(1).cast("bigint"))
    sizes = [r["count"] for r in embeddings.forest_leaves(rows, leaf=32, sample=256).groupBy("label", "leaf").count().collect()]
    assert len(sizes) > 300 and sum(n > 2 * 32 for n in sizes) < 60  # only the group of 600 alike stays large
    want = (u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T >= 0.98
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, leaf=32).collect()}
    assert 0.97 * (want.sum() - len(x)) <= sum(got.values()) <= want.sum() - len(x)


@pytest.mark.parametrize("n,m", [(60, 40), (1, 3)])
def test_components(spark, n, m):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect()) == label


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert left.columns == columns, name
        assert left.count() <= docs.count() <= before + 3
        docs = left
    text = {r.doc_id: r.text for r in docs.collect()}
    assert None in text and len({t for t in text.values() if t}) >= len(text) * 0.95
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(text)
