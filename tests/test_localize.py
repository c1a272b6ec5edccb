"""Both ways of localizing against a search over all links, and injected faults judged again against whole runs judged anew."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridelog.operators import gates, hashing, inject, levels, localize
from stridelog.plans import journal
from stridelog.scratch import materialize

ROWS = "run_id string, pos int, step_index int, kind string, parent_step int, gate string, targets boolean, refs array<struct<file:string,produces:boolean,base:boolean,base_produces:boolean>>"


def brute(steps, failing):
    n = len(steps)
    touches = lambda i, key: {r["file"] for r in steps[i]["refs"] if key is None or r[key]}
    linked = lambda i, c, made, used: steps[c]["parent_step"] == i or i < c and touches(i, made) & touches(c, used)
    children = {i: [c for c in range(n) if linked(i, c, "produces", None)] for i in range(n)}
    base = {(i, c) for i in range(n) for c in range(n) if linked(i, c, "base_produces", "base")}

    def paths(start):
        best, level = {start: (start,)}, [(start,)]
        while level:
            found = {}
            for p in level:
                for c in children[p[-1]]:
                    if c not in best:
                        found[c] = min(found.get(c, (n,)), (*p, c))
            best |= found
            level = list(found.values())
        return best

    ways = {f: paths(f) for f in failing}
    own = {f: min(g for g in failing if f in ways[g]) for f in failing}
    out = []
    for b in sorted(set(own.values())):
        cascade = sorted(f for f in failing if own[f] == b and f != b)
        opaque, unlinked, guessed, shown = set(), set(), set(), set()
        for goal in cascade:
            path = ways[b][goal]
            opaque |= {x for x in path if steps[x]["kind"] in ("opaque_shell", "unmapped")}
            unlinked |= {x for x in path[1:] if steps[x]["parent_step"] is None}
            for edge in zip(path, path[1:]):
                if edge not in base:
                    guessed.add(edge)
                    shown |= {x for x in edge if steps[x]["targets"]}
        known = sum(steps[x]["targets"] for x in opaque)
        notes = [f"{m} {noun}{'' if m == 1 else 's'}" for m, noun in zip((known, len(opaque) - known, len(unlinked), len(guessed)), levels.NOTES) if m]
        out.append((b, failing[b], cascade, "LOW" if notes else "HIGH", levels.joined(notes), sorted(opaque | unlinked | shown)))
    return out


def some_runs(seed, runs):
    rng = random.Random(seed)
    rows, want = [], {}
    for t in range(runs):
        n, forward = rng.randrange(2, 12), t % 2
        steps = []
        for i in range(n):
            refs = [{"file": f, "produces": made, "base": base, "base_produces": made and base} for f in "abc" if rng.random() < 0.35 for made, base in [(rng.random() < 0.5, rng.random() < 0.5)]]
            parents = [None, *range(i)] if forward else [None, *range(n + 1)]
            steps.append({"parent_step": rng.choice(parents), "kind": rng.choice(["file_edit", "opaque_shell", "unmapped", "test_run"]), "targets": rng.random() < 0.5, "refs": refs})
        failing = {f: rng.choice(["G1", "G2", "G3"]) for f in rng.sample(range(n), rng.randrange(1, n + 1))}
        want[f"r{t}"] = brute(steps, failing)
        rows += [(f"r{t}", i, i, s["kind"], s["parent_step"], failing.get(i), s["targets"], [tuple(r.values()) for r in s["refs"]]) for i, s in enumerate(steps)]
    return rows, want


def by_run(found):
    out = {}
    for r in found.orderBy("run_id", "breaking_step").collect():
        out.setdefault(r.run_id, []).append(tuple(r)[1:])
    return out


def test_levels_and_pass_against_search(spark):
    rows, want = some_runs(5, 200)
    df = spark.createDataFrame(rows, ROWS)
    assert by_run(levels.localize(df)) == want
    passed = by_run(df.drop("pos").repartition("run_id").sortWithinPartitions("run_id", "step_index").mapInArrow(localize.ordered, localize.LOCALIZATIONS))
    settled = {k: v for k, v in passed.items() if v[0][0] is not None}
    assert len(settled) >= 100 and all(settled[k] == want[k] for k in settled)


def test_backward_links_go_to_levels(spark):
    """Through the whole function: step 0 names step 2 as its parent, so 2 leads to 0; the smaller one still breaks."""
    j = spark.createDataFrame([("r", 0, "test_run", 2, "1 failed"), ("r", 1, "test_run", 0, "2 passed"), ("r", 2, "test_run", 1, "1 failed"), ("s", 0, "test_run", None, "1 failed"), ("s", 1, "test_run", 0, "1 failed")], "run_id string, pos int, kind string, parent_step int, test_text string")
    from stridelog.schema import complete

    a = complete(j.withColumns({"step_index": F.col("pos"), "tool_name": F.lit("Bash"), "command": F.lit("make all")}))
    got = {(r.run_id, r.breaking_step): (r.cascade, r.confidence) for r in localize.localize(a).collect()}
    assert got == {("r", 0): ([2], "HIGH"), ("s", 0): ([1], "HIGH")}


@pytest.mark.parametrize("chain", [True, False])
def test_a_long_run_is_linear(chain):
    """200,000 steps, each linked to the one before it or through a file; none is brought together."""
    n = 200_000

    def batches():
        for at in range(0, n, 10_000):
            steps = range(at, at + 10_000)
            refs = [[] if chain else [{"file": f"f{i % 7}", "produces": True, "base": True, "base_produces": True}] for i in steps]
            yield pa.RecordBatch.from_pydict({"run_id": ["r"] * 10_000, "step_index": list(steps), "kind": ["file_edit"] * 10_000, "parent_step": [i - 1 if chain and i else None for i in steps], "gate": ["G2" if i % 1000 == 3 else None for i in steps], "targets": [False] * 10_000, "refs": pa.array(refs, pa.list_(pa.struct([("file", pa.string()), ("produces", pa.bool_()), ("base", pa.bool_()), ("base_produces", pa.bool_())])))})

    began = time.perf_counter()
    found = [r for b in localize.ordered(batches()) for r in b.to_pylist()]
    assert time.perf_counter() - began < 20
    assert sum(1 + len(r["cascade"]) for r in found) == n // 1000 and len(found) == (1 if chain else 7)


def test_judged_again_like_whole_runs(spark, data):
    """Failing steps, buckets and predictions of the cases equal those of whole copied runs."""
    j = materialize(journal.short_journal(spark, data))
    results = materialize(gates.gate_results(j))
    clean = hashing.with_content_hash(j.join(gates.dirty_runs(results), "run_id", "left_anti"))
    cases = materialize(inject.sample(inject.eligible(clean, results), 200, 3, inject.SEED))
    delta = materialize(inject.judge(clean, cases))
    whole = materialize(gates.gate_results(inject.mutate(clean, cases)))
    failed = lambda r: sorted(map(tuple, r.where("status = 'FAIL'").select("run_id", "step_index", "gate", "evidence").collect()))
    assert failed(delta) == failed(whole) and failed(whole)
    bucket = lambda r: sorted(map(tuple, inject.outcomes(cases, r).select("case_id", "bucket").collect()))
    assert bucket(delta) == bucket(whole)
    assert by_run(inject.localize_cases(clean, cases, delta)) == by_run(localize.localize(inject.mutate(clean, cases), whole))
    assert delta.count() < whole.count()
