"""Ordered passes: chains and edits against plain loops, whatever the batches and partitions; long runs in linear time."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from stridelog.operators import gates, hashing
from stridelog.schema import complete


def edits(spark, rows):
    return complete(spark.createDataFrame(rows, "run_id string, pos int, step_index int, kind string, file_path string, tool_name string, write_mode boolean, old_string string, new_string string, edits_is_list boolean, edits array<struct<old_string:string,new_string:string>>"))


def loop(rows):
    """By the rules, one row after another."""
    content, out = {}, []
    for run, pos, step, _, path, tool, mode, old, new, is_list, many in sorted(rows, key=lambda r: (r[0], r[1])):
        state, pairs = content.get((run, path)), many if is_list and tool == "MultiEdit" else [(old, new)]
        if not path:
            status = "FAIL"
        elif tool == "Write" or mode:
            status = "FAIL" if new is None else "PASS"
            content[run, path] = state if new is None else new
        elif not pairs:
            status = "FAIL"
        elif state is None:
            status = "NA"
        else:
            status = "PASS"
            for o, n in pairs:
                if o is None or n is None or o == "" or state.count(o) != 1:
                    status = "FAIL"
                    break
                state = state.replace(o, n)
            if status == "PASS":
                content[run, path] = state
        out.append((run, pos, step, status))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 5])
def test_edits_against_a_loop(spark, partitions):
    rng = random.Random(7)
    text = lambda: rng.choice([None, "", "x", "y", "xy", "x y", "éx", "aa", "aaa"])
    rows = [
        (f"r{rng.randrange(4)}", i, i, "file_edit", rng.choice(["a", "b", "", None]), rng.choice(["Write", "Edit", "Edit", "MultiEdit", None]), rng.random() < 0.1, text(), text(), rng.random() < 0.7, [(text(), text()) for _ in range(rng.randrange(3))])
        for i in range(1500)
    ]
    got = gates.g2(edits(spark, rows).repartition(partitions)).select("run_id", "pos", "step_index", "status")
    assert sorted(map(tuple, got.collect())) == loop(rows)


def test_chain_against_a_loop(spark):
    a = complete(spark.range(3000).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("run_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("step_index"), F.lit("llm_call").alias("kind"), F.lit('{"é":"\\""}').alias("inputs_json")))
    texts = {(r.run_id, r.pos): r.c for r in a.select("run_id", "pos", hashing.payload(a).alias("c")).collect()}
    last, want = {}, []
    for (run, pos), c in sorted(texts.items()):
        own, prev = hashlib.sha256(c.encode()).hexdigest(), last.get(run, "0" * 64)
        last[run] = hashlib.sha256(('{"activity":{"content_hash":"' + own + '",' + c[1:] + ',"prev_hash":"' + prev + '"}').encode()).hexdigest()
        want.append((run, pos, own, prev, last[run]))
    got = hashing.chain(a.repartition(4))
    assert sorted(map(tuple, got.collect())) == want
    assert hashing.verify(a, got).count() == 0


def test_one_long_run(spark):
    """A run of 10^6 steps on one file: time in proportion, and no row holds the run."""
    n = 1_000_000
    a = complete(spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("step_index"), F.lit("file_edit").alias("kind"), F.lit("f").alias("file_path"), F.when(F.col("id") == 0, "Write").otherwise("Edit").alias("tool_name"), F.when(F.col("id") > 0, F.concat(F.lit("v"), F.col("id") - 1, F.lit(";"))).alias("old_string"), F.concat(F.lit("v"), F.col("id"), F.lit(";")).alias("new_string")))
    began = time.perf_counter()
    assert gates.g2(a).groupBy("status").count().collect() == [("PASS", n)]
    assert hashing.chain(a).select(F.countDistinct("record_hash")).first()[0] == n
    assert time.perf_counter() - began < 120
