"""The sweep's report through the command line: a manifest's instances and commits, shares of nothing, runs that none lists."""

import json

from stridelog import cli
from stridelog.operators import reports
from stridelog.schema import KINDS


def test_report_with_a_manifest(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    failing = [{"role": "user", "content": "t"}, {"role": "assistant", "action": "pytest"}, {"role": "tool", "content": "2 failed"}]
    quiet = [{"role": "user", "content": "t"}]
    for name, history in {"a": failing, "b": quiet, "c": failing}.items():
        (folder / f"{name}.json").write_text(json.dumps({"history": history}))
    sources = [{"local_path": "runs/a.json", "instance_id": "one", "repo": "r", "commit": "x"}, {"local_path": "runs/b.json", "instance_id": "one", "repo": "r"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"sources": sources}))
    args = cli.parser().parse_args(["sweep", str(folder), "--format", "action", "--manifest", str(tmp_path / "manifest.json")])
    text, code = cli.run(spark, args)
    parts = {p.splitlines()[0]: [x[2:-2].split(" | ") for x in p.splitlines()[2:] if x.startswith("|")] for p in text.split("## ")[1:]}
    table = lambda title: [dict(zip(parts[title][0], r, strict=True)) for r in parts[title][2:]]
    assert code == 0 and [(r["runs"], r["instances"]) for r in table("Sweep")] == [("3", "1")]
    assert [(r["instance_id"], r["runs"]) for r in table("By instance")] == [("local:c", "1"), ("one", "2")]
    assert [(r["repo"], r["commit"], r["runs"]) for r in table("By commit")] == [("", "", "1"), ("r", "", "1"), ("r", "x", "1")]
    runs = {r["run_id"]: r for r in table("Runs")}
    assert runs["b"]["failing_steps"] == "0" and runs["a"]["failing_steps"] == runs["c"]["failing_steps"] != "0"
    for r in runs.values():
        assert int(r["failing_steps"]) == sum(int(r[f"{c}_steps"]) for c in ("high", "low", "na"))


def test_no_actions_no_failures(spark):
    """Shares of nothing are null, and nothing at all is one row of zeros."""
    a = spark.createDataFrame([("r", 0, 0, KINDS[0], None)], "run_id string, pos int, step_index int, kind string, parent_step int")
    results = spark.createDataFrame([], "run_id string, step_index int, status string")
    found = spark.createDataFrame([], "run_id string, breaking_step int, cascade array<int>, confidence string")
    sources = spark.createDataFrame([], "run_id string, instance_id string, repo string, commit string")
    total = reports.sweep_totals(reports.sweep_runs(a, results, found, sources)).first()
    assert (total.runs, total.instances, total.activities, total.failing_steps, total.high_rate) == (1, 0, 1, 0, None)
    nothing = reports.sweep_totals(reports.sweep_runs(a.limit(0), results, found, sources)).first()
    assert (nothing.runs, nothing.activities, nothing.opaque_or_unmapped_fraction) == (0, 0, None)
    assert reports.sweep_totals(reports.sweep_runs(a.limit(0), results, found, sources), "repo", "commit").count() == 0
