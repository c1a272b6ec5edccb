"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import pytest

from corpus_pipeline import STAGES
from stridelog.llm import simhash, stages

SCHEMA = "doc_id long, text string"
PAIRS = 1600


def similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def texts():
    """Each text and a copy with scattered edits: similarities around 0.8."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeghimnoprstu") for _ in range(6)) for _ in range(2000)]
    out = {}
    for i in range(PAIRS):
        n, edits = ((100, 2), (200, 4), (100, 3), (60, 1), (10, 0), (200, 5), (40, 1), (1000, 20))[i % 8]
        words = [rng.choice(vocabulary) for _ in range(n)]
        copy = list(words)
        for k in range(edits):
            copy[n * (2 * k + 1) // (2 * edits)] = "edited"
        out[2 * i], out[2 * i + 1] = " ".join(words), " ".join(copy if edits else copy[:-1])
    return out


@pytest.fixture(scope="module")
def groups(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA), cap=8).collect()}


def test_no_similar_pair_is_lost(texts, groups):
    alike = [i for i in range(0, 2 * PAIRS, 2) if similarity(texts[i], texts[i + 1]) >= 0.8]
    assert len(alike) >= 800 and [i for i in alike if groups[i + 1] != i] == []


def test_less_similar_texts_stay(texts, groups):
    other = {i: round(similarity(texts[i], texts[i + 1]), 3) for i in range(0, 2 * PAIRS, 2) if similarity(texts[i], texts[i + 1]) < 0.8}
    assert len([s for s in other.values() if s >= 0.7]) >= 400
    assert {i: s for i, s in other.items() if groups[i + 1] != i + 1} == {} and len(groups) == 2 * PAIRS


def test_groups_in_blocks_and_odd_rows(spark):
    base = [f"w{k}" for k in range(300)]
    chain = [" ".join(base[: 60 + 4 * i]) for i in range(50)]
    rows = [*enumerate(chain), (100, None), (101, " "), (102, ""), (None, chain[3]), (103, " ".join(base[10:30])), (7, "another text of the same id as one before")]
    for caps in ((2, 3), (1024, 4096)):
        got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), cap=caps[0], text_cap=caps[1]).collect()
        assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted([*[(i, 0) for i in range(50)], (100, 100), (101, 100), (102, 100), (103, 103), (7, 7)])
        assert [r.component_id for r in got if r.doc_id is None] == [0]
    assert stages.simhash_near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    words = [f"w{k}" for k in range(80)]
    a, b = " ".join(words), " ".join(words[::-1])
    c, d = " ".join([*words[:40], "changed", *words[41:]]), " ".join([*words[::-1], "more"])
    rows = [(1, a), (6, b), (6, c), (None, d), (None, "alone")]
    kept = stages.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (6, b), (0, "alone")])


@pytest.mark.parametrize("name", [n for n, _ in STAGES if n not in ("toxicity", "best_fit_packing")])
def test_stages_take_empty_tables_and_clashing_columns(spark, name):
    stage = dict(STAGES)[name]
    clash = "doc_id long, text string, nth int, kept_id string, text_key int, text_digest int, cut_id int, k int, Left_Over int, kept_digest int, kept_key int, cut_key int, component_id int"
    rows = [(i, t, *range(11)) for i, t in [(1, "some words of a text"), (2, None), (2, None), (None, ""), (3, "z" * 500)]]
    rows = [(*r[:3], str(r[3]), *r[4:]) for r in rows]
    got = stage(spark, spark.createDataFrame(rows, clash), "")
    assert got.columns == [c.split()[0] for c in clash.split(", ")] and 1 in {r.doc_id for r in got.collect()}
    assert stage(spark, spark.createDataFrame([], clash), "").count() == 0


def test_a_line_of_all_documents_makes_no_pairs_of_blocks(spark, monkeypatch):
    """Rows compared grow with the documents, not with a common line's documents squared; pairs that hold the line are linked."""
    rng, rows, n = random.Random(9), {}, 600
    line = " ".join(f"common{k}" for k in range(20))
    for i in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows[2 * i] = " ".join(words) + "\n" + line
        rows[2 * i + 1] = " ".join(["edited" if k in (60, 140) else w for k, w in enumerate(words)]) + "\n" + line
    for i in range(30):  # almost nothing but the line
        rows[2 * n + i] = line + f" end{i // 2}" + " twice" * (i % 2)
    dealt, deal = [], simhash.deal
    monkeypatch.setattr(simhash, "deal", lambda x: (dealt.append(x.count()), deal(x))[1])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(rows.items()), SCHEMA), cap=16).collect()}
    assert dealt[0] <= 30 * len(rows)
    assert got == {k: k - k % 2 if k < 2 * n else 2 * n for k in rows}
