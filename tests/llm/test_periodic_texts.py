"""Suffix dedup of periodic texts: rows by the period, not by the length."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from stridelog.llm import suffixes


def covered(texts, depth):
    """Bytes of each text within a window that starts twice, by plain counting."""
    seen = Counter(t[a : a + depth] for t in texts for a in range(len(t) - depth + 1))
    return [len({b for a in range(len(t) - depth + 1) if seen[t[a : a + depth]] > 1 for b in range(a, a + depth)}) for t in texts]


@pytest.mark.parametrize("period", [1, 2, 7, 73, 190])
def test_periodic_texts_against_plain_counting(spark, period):
    rng = random.Random(period)
    unit = "".join(rng.choice("abcdefgh") for _ in range(period))
    texts = [unit * (900 // period + 2), "z" * 30 + unit * (450 // period) + "y" * 40, "".join(rng.choice("mnop") for _ in range(300)) + unit * (400 // period + 1), (unit * 210)[:200], (unit * 210)[:199]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == covered([t.encode() for t in texts], suffixes.DEPTH)


@pytest.mark.parametrize("unit", ["x", "=-", "a1b2c3d", "".join(map(chr, range(33, 106)))])
def test_rows_of_a_long_periodic_text(unit):
    text = (unit * (3 * 10**6 // len(unit)))[: 3 * 10**6]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc_id", "k", "text"])
    rows = pa.Table.from_batches(suffixes._runs(suffixes.DEPTH, suffixes.WINDOW)([batch])).to_pylist()
    assert len(rows) <= 200 and sum(r["own"] for r in rows) == len(text) - suffixes.DEPTH + 1
    spans = sorted((r["first"], r["own"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
