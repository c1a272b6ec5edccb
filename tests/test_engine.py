"""Gates, shell targets, localization and scoring on small hand-made runs."""

import pytest
from shell_by_hand import is_path, targets
from pyspark.sql import functions as F

from stridelog import cli
from stridelog.operators import gates, graph, inject, labels, localize, regexdiff, render, reports
from stridelog.schema import ACTIVITIES, COLUMNS, complete
from stridelog.sources import files
from stridelog.streaming import feed


def act(spark, *steps):
    base = {"run_id": "r", "source": "s", "ts": "", "write_mode": False, "inputs_json": "{}", "outputs_json": "{}"}
    rows = [tuple({**dict.fromkeys(COLUMNS), **base, "pos": i, "step_index": i, **s}.get(c) for c in COLUMNS) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, ACTIVITIES)


def edit(path, old, new, parent=None, **more):
    return {"kind": "file_edit", "tool_name": "Edit", "file_path": path, "target": path, "old_string": old, "new_string": new, "parent_step": parent, **more}


def write(path, text, parent=None):
    return edit(path, "", text, parent, tool_name="Write", write_mode=True)


def ran(command, parent=None, kind="opaque_shell", **more):
    return {"kind": kind, "tool_name": "Bash", "command": command, "target": "shell", "parent_step": parent, **more}


def test(text, parent=None, command="pytest", code=None):
    return ran(command, parent, "test_run", test_text=text, exit_code=code)


test.__test__ = False


@pytest.mark.parametrize("text,code,status", [
    ("3 passed in 0.04s", None, "PASS"), ("0 passed", None, "PASS"), ("0 failed", None, "NA"), ("3 passed, 1 failed", None, "FAIL"), ("3 passed", 1, "FAIL"), ("", 0, "NA"), ("nothing here", 0, "NA"),
    ("an exception, 3 passed", None, "FAIL"), ("ok  pkg/x 0.1s", None, "PASS"), ("\x1b[31mFAILED\x1b[0m x", None, "FAIL"), ("npm err! code 1", None, "NA"), ("test result: ok. 4 passed; 0 failed", None, "PASS"), ("=== FAILURES ===", None, "FAIL"), ("ok", None, "PASS"), ("a ok", None, "NA"),
])
def test_g3(spark, text, code, status):
    assert gates.g3(act(spark, test(text, code=code))).first().status == status


def test_g1_and_g2(spark):
    a = act(
        spark, write("a", "x y x"), edit("a", "y", "z"), edit("a", "x", "q"), edit("a", "nope", "q"), edit("a", "", "q"), edit("b", "y", "z"), edit(None, "y", "z"), edit("a", None, "z"), edit("a", "z", "w"),
        edit("a", None, None, tool_name="MultiEdit", edits_is_list=True, edits=[("x w", "m"), ("m", "n")]), edit("a", "", "", tool_name="MultiEdit", edits_is_list=True, edits=[]), edit("a", "n x", "done"), {"kind": "tool_call", "tool_name": "Grep"}, {"kind": "tool_call"}, {"kind": "verdict"}, {"kind": "llm_call"}, ran("pytest", kind="test_run", tool_name="sh"),
    )
    g2 = {r.pos: (r.status, r.evidence) for r in gates.g2(a).collect()}
    assert [g2[i][0] for i in range(12)] == ["PASS", "PASS", "FAIL", "FAIL", "FAIL", "NA", "FAIL", "FAIL", "PASS", "PASS", "FAIL", "PASS"]
    assert g2[2][1] == "edit 1 old_string ambiguous" and g2[3][1] == "edit 1 old_string not found" and g2[4][1] == "edit 1 empty old_string" and g2[9][1] == "2 edits matched uniquely" and g2[7][1] == "edit 1 malformed" and g2[10][1] == "file_edit malformed: missing edit fragments"
    g1 = {r.pos: (r.status, r.evidence) for r in gates.g1(a).collect()}
    assert g1[6] == ("FAIL", "file_edit malformed: file_path missing/not str") and g1[12] == ("FAIL", "tool_call malformed: pattern missing/not str") and g1[13][1] == "tool_call malformed: missing tool_name"
    assert g1[14] == ("PASS", "verdict activity schema ok") and g1[15][0] == "NA" and g1[16][1] == "test_run malformed: tool_name must be Bash or PowerShell" and g1[9][1] == "file_edit malformed: old_string missing/not str; new_string missing/not str"


@pytest.mark.parametrize("command,reads,writes", [
    ("cat a.py b.py", "a.py b.py", ""), ("head -n 5 a.txt", "a.txt", ""), ("tail -3 a.txt", "a.txt", ""), ("tee -a out.log", "", "out.log"), ("cp a.py b.py", "a.py", "b.py"), ("mv a.py b.py", "a.py", "a.py b.py"), ("rm -rf build/x", "", "build/x"),
    ("touch new.txt", "", "new.txt"), ("mkdir -p a/b", "", "a/b"), ("sed -i s/a/b/ f.py", "f.py", "f.py"), ("sed s/a/b/ f.py", "", ""), ("sed -i '' -e s/a/b/ f.py", "f.py", "f.py"), ("python -u run.py", "run.py", ""), ("python -m pytest tests -q", "tests", ""), ("node app.js", "app.js", ""),
    ("pytest tests/t.py::test_x -k name", "tests/t.py", ""), ("go test ./pkg/x", "./pkg/x", ""), ("npm test -- a/b.js", "a/b.js", ""), ("npm run test", "", ""), ("make > out/log.txt", "", "out/log.txt"), ("cat a.py >>b.py", "a.py", "b.py"), ("/usr/bin/CAT.exe a.py", "a.py", ""),
    ("cat a.py | wc", "", ""), ("cat *.py", "", ""), ("cat a.py; ls", "", ""), ("cat < a.py", "", ""), ("cat -n a.py", "", ""), ("cp -r a/x b/y", "", ""), ("rm -i a.py", "", ""), ("python -c 1", "", ""), ("curl http://x/y.py", "", ""), ("cat 'a.py", "", ""), ("pytest --maxfail", "", ""), ("head -n x a.txt", "", ""), ("head -n -3 5 src/f.py", "", ""), ("head -n5 -2 src/f.py", "src/f.py", ""), ("tail src/f.py -n", "", ""), ("sed -i s/a/b/ -e s/c/d/ src/f.py", "src/f.py", "src/f.py"), ("sed -i -e s/a/b/ -e s/c/d/ src/f.py", "src/f.py", "src/f.py"), ("sed -i src/f.py", "", ""), ("echo $X", "", ""), ("", "", ""),
])
def test_shell_targets(command, reads, writes):
    assert targets(command) == (set(reads.split()), set(writes.split()))


def test_paths():
    assert is_path("a/b") and is_path("x.py") and not is_path("README") and not is_path("a/...") and not is_path("..") and is_path("tests", True) and not is_path(".bashrc")


def found(spark, *steps):
    return [(r.breaking_step, r.breaking_gate, r.cascade, r.confidence, r.coverage, r.candidates) for r in localize.localize(act(spark, *steps)).orderBy("breaking_step").collect()]


def test_localize(spark):
    ok = {"kind": "user_msg"}
    assert found(spark, ok, write("a", "x", 0), edit("a", "y", "z", 1), test("1 failed", 2)) == [(2, "G2", [3], "HIGH", "structured path", [])]
    assert found(spark, write("a.py", "x"), edit("a.py", "y", "z", 0), ran("make all", 1), test("1 failed", 2)) == [(1, "G2", [3], "LOW", "1 opaque_shell node on path", [2])]
    assert found(spark, write("a.py", "x"), edit("a.py", "y", "z", 0), edit("a.py", "q", "z")) == [(1, "G2", [2], "LOW", "1 unlinked step on path", [2])]
    got = found(spark, test("1 failed", command="pytest > o.txt"), test("1 failed", command="cat o.txt"))
    assert got == [(0, "G3", [1], "LOW", "1 unlinked step; 1 heuristic shell-target edge on path", [0, 1])]
    assert [x[:4] for x in found(spark, test("1 failed"), test("1 failed", command="cat a.py | sh"))] == [(0, "G3", [], "HIGH"), (1, "G3", [], "HIGH")]
    assert found(spark, ok, test("2 passed", 0)) == []


def test_metamorphic(spark):
    """Neither partitions, nor row order, nor other runs matter; a fault does."""
    steps = [write("a", "x"), edit("a", "x", "y", 0), test("2 passed", 1), edit("a", "y", "w", 2)]
    a = act(spark, *steps)
    other = act(spark, test("1 failed")).withColumn("run_id", F.lit("other"))
    both = a.unionByName(other).orderBy(F.desc("pos")).repartition(3)
    key = lambda df: sorted(tuple(r) for r in gates.gate_results(df).where("run_id = 'r'").collect())
    assert key(a) == key(both) and localize.localize(a).count() == 0
    out = inject.run_injection(complete(both), 10, 3)
    by = {r.fault_class: r for r in out["confusion"].collect()}
    assert by["G1_TARGET"].tp == by["G1_TARGET"].injected == 3 and by["G2_TARGET"].recall == 1 and by["G3_TARGET"].tp == 1 and by["BENIGN"].clean == 1
    assert {r.confidence: (r.cases, r.exact) for r in out["accuracy"].collect()}["ALL"] == (6, 6)


def test_sampling_caps(spark):
    rows = [(f"r{i % 5}", "s", i, "CONTROL") for i in range(50)]
    cases = inject.sample(spark.createDataFrame(rows, "run_id string, source string, step_index int, fault_class string"), 7, 2)
    per = {r["run_id"]: r["count"] for r in cases.groupBy("run_id").count().collect()}
    assert cases.count() == 7 and max(per.values()) <= 2 and cases.collect() == cases.collect()


def test_labels(spark):
    a = act(spark, write("a", "x"), edit("a", "q", "z", 0), test("1 failed", 1))
    raw = spark.createDataFrame([("r", "c", "2"), ("r", "c", "9"), ("r", "d", "x"), ("gone", "d", "1")], "run_id string, config string, mistake_step string")
    scored = labels.score(labels.read_labels(raw, a), localize.localize(a))
    assert sorted((str(r.expected_step), r.exact, r.cascade) for r in scored.collect()) == [("2", False, True), ("None", False, False), ("None", False, False), ("None", False, False)]
    assert {r.exclusion: r.n for r in labels.exclusions(scored).collect()} == {"step out of range": 1, "step not a number": 1, "no run": 1}


def test_regex_check(spark):
    patterns = spark.createDataFrame([("a", "x+"), ("b", "(")], "pattern_id string, pattern string")
    inputs = spark.createDataFrame(list(enumerate(["x", "xy", "y"])), "pos int, input string")
    seen = regexdiff.observations(patterns, inputs)
    assert {(r.pattern_id, r.status, r.first_divergence) for r in regexdiff.summary(seen).collect()} == {("a", "divergent", 1), ("b", "unsupported", None)}
    assert [r.breaking_step for r in localize.localize(regexdiff.as_activities(seen)).collect()] == [1]
    assert regexdiff.generate_inputs("ab+", 8)[:7] == list(regexdiff.SEEDS)
    assert regexdiff.generate_inputs("ab+")[7:] == ["ab", "xab", "abx", "xabx", "abab", "ba", "aa"] and regexdiff.generate_inputs(r"\.x[-a]", 0) == [] and r".x-a" in regexdiff.generate_inputs(r"\.x[-a]")


def test_reports_and_rendering(spark):
    a = act(spark, write("a", "x"), edit("a", "q", "z", 0), test("1 failed", 1))
    results = gates.gate_results(a)
    where = localize.localize(a, results)
    study = {r.source: r for r in reports.study(reports.study_runs(a, results, where)).collect()}
    assert study["ALL"].runs == 1 and study["s"].high_runs == 1 and study["ALL"].g2_steps == 1
    assert "breaks at step 1 (G2, HIGH" in render.narrative(reports.replay(a, results, where), where)
    assert render.cell("a\tb\n") == "a b " and render.tsv(where).count("\n") == 1 and render.as_json(x=where).startswith("{")
    assert graph.shell_coverage(a).first().steps_with_targets == 0


def test_cli(spark, capsys, tmp_path):
    args = cli.parser().parse_args(["demo"])
    assert cli.run(spark, args)[1] == 0 and "G2" in cli.run(spark, args)[0]
    assert cli.run(spark, cli.parser().parse_args(["replay", "x"])) == ("replay needs --explain", 2)
    (tmp_path / "p.json").write_text('{"patterns": [{"pattern": "a+", "inputs": ["a", "ba"], "generate": true}, {"id": "bad", "pattern": "(", "inputs": ["x"]}]}')
    text, code = cli.run(spark, cli.parser().parse_args(["regex", str(tmp_path / "p.json")]))
    assert code == 1 and "pattern-0\t" in text and "unsupported" in text
    for bad in ('{"patterns": 3}', '[{"pattern": 5}]', '[{"pattern": "a", "inputs": "x"}]', '[{"pattern": "a", "generate": 1}]', '[{"pattern": "a", "id": ""}]', "[7]"):
        with pytest.raises(ValueError):
            files.pattern_rows(bad)
    assert files.pattern_rows('[{"pattern": "a"}]')[0] == {"pattern_id": "pattern-0", "pattern": "a", "inputs": [], "generate": True, "description": ""}


def test_stream(spark, tmp_path):
    a = act(spark, test("1 failed"), test("2 passed"), test("3 failed")).withColumn("arrived", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, pos)"))
    a.write.parquet(str(tmp_path / "in"))
    q = feed.first_failures(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("fails").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.failing_steps, r.first_failing_step) for r in spark.sql("SELECT * FROM fails").collect()] == [(2, 0)]
    assert feed.stateless_gates(a).where("status = 'FAIL'").count() == 2
