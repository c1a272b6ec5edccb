"""Line dedup against brute force: the stream over any cut into partitions and batches, odd rows, the smallest table."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stridelog.llm import line_dedup
from stridelog.llm.queries import SQL

BLANK = " \t\n\v\f\r"
A, B, C = "a line that many documents hold", "Another Line of twenty or more", "éééééééééééééééééééé"
ROWS = [
    (1, f"{A}\n{B}\nshort\n{A}"), (2, f"  {A.upper()}\t\n{C}\n"), (3, f"{A}\n\n{A}\r\nown line of the third document"), (4, None), (5, ""), (6, "\n"), (None, f"{A}\n{C}"), (None, f"{B}\nx"),
    (7, f"{B}\n{C}\n{C}x"), (7, f"{B}\n{A}"), (7, f"{B}\n{A}"), (8, f"{B.upper()}\nx" + "y" * 30), (9, "é" * 19), (10, "é" * 19), (11, "é" * 19 + " "), (12, "\n".join([A] * 5000)), (13, "İ" * 20), (14, "i̇" * 20), (15, "İ" * 20), (16, "İ" * 20),
]


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=20, min_docs=3):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders.setdefault(key_of(line), set()).add(-(2**63) if i is None else i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(key_of(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], "doc_id long, text string, doc string, k string, pos string, keep string")


def cut(docs, **how):
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **how))
    return sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


@pytest.mark.parametrize("min_docs", [1, 2, 3, 4])
def test_odd_rows(spark, min_docs):
    assert cut(frame(spark, ROWS), min_docs=min_docs) == brute(ROWS, min_docs=min_docs)


def test_empty(spark):
    assert cut(frame(spark, ROWS).where("false")) == []


def test_a_line_over_many_partitions(spark):
    rows = [(i, f"{A}\nunique line of document {i:09}\n{A}") for i in range(3000)]
    assert cut(frame(spark, rows)) == brute(rows)


def test_bitmaps_are_what_returns(spark):
    got = {r["doc"]: r for r in line_dedup.keep_bitmaps(frame(spark, ROWS)).collect()}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(got[3]["keep"])), np.uint8))
    assert bits[:4].tolist() == [0, 1, 0, 1]
    assert 4 not in got and 5 not in got


@pytest.mark.parametrize("seed", range(0, 1500, 100))
def test_stream(seed):
    for trial in range(seed, seed + 100):
        r = random.Random(trial)
        need, hashes, docs = r.choice([1, 2, 3, 3, 4]), r.choice([1, 2, 5, 20]), r.choice([1, 2, 3, 5, 30])
        rows = sorted({(r.randrange(hashes), r.randrange(docs), r.randrange(4)) for _ in range(r.randrange(60))}, key=lambda x: (x[0], -x[1], x[2]))
        holders = {}
        for h, d, _ in rows:
            holders.setdefault(h, set()).add(d)
        want = sorted(x for x in rows if len(holders[x[0]]) >= need and x[1] != max(holders[x[0]]))

        def pieces(rows, most):
            at = sorted(r.randrange(len(rows) + 1) for _ in range(r.randrange(most)))
            return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]

        drops, late, told = [], [], {}
        for part in pieces(rows, 5):
            batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in b], pa.int64()), pa.array([0] * len(b), pa.int64()), pa.array([x[1] for x in b], pa.int64()), pa.array([0] * len(b), pa.int64()), pa.array([x[2] for x in b], pa.int32())], ["h1", "h2", "doc", "k", "pos"]) for b in pieces(part, 8)]
            summaries = 0
            for said in line_dedup.stream(iter(batches), need):
                for x in said.to_pylist():
                    if x["say"] == line_dedup.SUMMARY:
                        told.setdefault(x["h1"], set()).update(x["docs"])
                        summaries += 1
                    else:
                        (late if x["say"] == line_dedup.UNDECIDED else drops).append((x["h1"], x["doc"], x["pos"]))
            assert summaries <= 2
        drops += [x for x in late if len(told[x[0]]) >= need and x[1] != max(told[x[0]])]
        assert sorted(drops) == want


def test_query(spark, data):
    want = duckdb.sql(SQL["op12_line_dedup"].replace("FROM documents", f"FROM '{data}/documents.parquet'")).fetchall()
    got = line_dedup.op12_line_dedup(spark, data)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect())) == sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute([tuple(r) for r in texts]))
