"""Periodic runs against brute force over all lags, odd rows, the smallest table, and texts where word pairs are quadratic."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from stridelog.llm import periodic

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(i, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if i is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
    runs = brute(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def text_like(r):
    kind = r.randrange(7)
    if kind == 0:
        return [r.randrange(2) for _ in range(r.randrange(300))]
    if kind == 1:
        return sum(([*u] * r.randrange(1, 7) for u in ([r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 60))] for _ in range(r.randrange(1, 6)))), [])
    if kind == 2:
        return [0] * r.randrange(200) + [1] + [0] * r.randrange(200) + [2] * r.randrange(3) + [0] * r.randrange(60)
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < 400:
            a, b = b, b + a
        return b[: r.randrange(400)]
    if kind == 4:
        return [k.bit_count() % 2 for k in range(r.randrange(512))] + [k.bit_count() % 2 for k in range(r.randrange(100))]
    if kind == 5:
        u = [r.randrange(2) for _ in range(r.randrange(1, 8))] * 60
        x, y = u[: r.randrange(200)], u[r.randrange(8) :][: r.randrange(200)]
        return x + y + x + y[: r.randrange(len(y) + 1)]
    return [r.randrange(40) for _ in range(r.randrange(400))]


@pytest.mark.parametrize("seed", range(0, 600, 60))
def test_runs(seed):
    for s in range(seed, seed + 60):
        words = text_like(random.Random(s))
        for least in (12, 4):
            assert sorted(zip(*(x.tolist() for x in periodic.runs_of(np.array(words, np.int64), least)))) == brute(words, least), s


@pytest.mark.parametrize("words", [[0] * 300_000, [0] * 150_000 + [1] + [0] * 150_000, [0, 1] * 75_000 + [1, 0] * 75_000, list(range(300)) * 1000], ids=["one word", "two stretches", "shifted", "long period"])
def test_no_quadratic_texts(words):
    began = time.perf_counter()
    start, length, period = periodic.runs_of(np.array(words, np.int64))
    assert time.perf_counter() - began < 30
    assert (length >= np.maximum(12, 2 * period)).all() and len(start) < len(words)


ODD = [
    (1, "a b " * 20), (2, None), (3, ""), (4, " \t\n"), (None, "x " * 30), (5, "x " * 11), (6, "x\v" * 12), (7, "é　y " * 9), (8, "A a " * 3 + "A b " * 6), (9, "a b " * 20), (9, "a b " * 20), (10, "z"),
    (11, "\x00 " * 14), (12, " ".join(str(k % 700) for k in range(5000))), (13, "a b c\n" * 4),
]


def test_odd_rows(spark):
    plantable = [i for i in range(20, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    rows = [*ODD, *((i, " ".join(random.Random(i).choices("abcdefgh", k=i))) for i in plantable), (plantable[0], None), (plantable[1], "one")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, runs string, n_words string, best string").repartition(3)
    got = periodic.digests(periodic.periodic_runs(periodic.planted(docs)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert periodic.digests(periodic.periodic_runs(docs.where("false"))).count() == 0


def test_operator_gives_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "p q r " * 5 + "end")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["text"]) == (16, [(0, 15, 3)], "p q r end")


def test_query(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    few = [tuple(r) for r in texts if len((r["text"] or "").split()) < 3000]
    got = {r["doc_id"]: tuple(r) for r in periodic.op13_periodic_runs(spark, data).collect()}
    assert len(got) == len(texts)
    assert all(got[i] == brute_row(i, t) for i, t in few)
