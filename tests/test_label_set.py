"""Files matched with their manifest by path ends, and labelled histories read as a set."""

import json

import pytest

from stridelog import cli
from stridelog.operators import labels
from stridelog.sources import files

MANIFEST = "local_path string, config string, row_idx long"


def test_manifest_by_path_ends(spark):
    """The longest end wins, only whole names count, a path listed twice is ambiguous, columns stay."""
    paths = spark.createDataFrame([("file:/d/a/x.json", 1), ("file:/d/b/x.json", 2), ("file:/d/b/yx.json", 3), ("file:/d/twice.json", 4), (None, 5), ("x.json", 6), ("", 7)], "path string, n int")
    manifest = spark.createDataFrame([("a/x.json", "long", 1), ("x.json", "short", 2), ("twice.json", "p", 3), ("twice.json", "q", 4), (None, "none", 5)], MANIFEST)
    got = {r.n: (r.config, r.row_idx, r.claims) for r in files.with_manifest(paths, manifest).collect()}
    assert got == {1: ("long", 1, 1), 2: ("short", 2, 1), 3: (None, None, 0), 4: ("q", 4, 2), 5: (None, None, 0), 6: ("short", 2, 1), 7: (None, None, 0)}
    assert {r.claims for r in files.with_manifest(paths, manifest.where("false")).collect()} == {0}


def test_label_set_from_a_folder(spark, tmp_path):
    history = [{"role": "user", "content": "a"}, {"role": "assistant", "name": "agent", "content": "b"}]
    rows = {
        "one.json": {"config": "own", "row_idx": 7, "row": {"history": history, "mistake_step": "1"}},
        "two.json": {"row_idx": "no number", "row": {"history": history, "mistake_step": "2"}},
        "three.json": {"row": {"history": history, "mistake_step": True}},
        "four.json": {"row": {"history": history, "mistake_step": 0}},
    }
    for name, data in rows.items():
        (tmp_path / name).write_text(json.dumps(data))
    (tmp_path / "manifest.json").write_text(json.dumps({"sources": [{"local_path": f"{tmp_path.name}/{n}", "config": "listed", "row_idx": k} for k, n in enumerate(rows)]}))
    texts = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="[!m]*.json").selectExpr("_metadata.file_path AS path", "value")
    activities, found = labels.label_set(texts, files.read_manifest(spark, str(tmp_path / "manifest.json")))
    got = sorted((r.config, r.row_idx, r.run_id, r.expected_step, r.exclusion) for r in found.collect())
    assert got == [("listed", 1, "listed:1", None, "step out of range"), ("listed", 2, "listed:2", None, "step not a number"), ("listed", 3, "listed:3", 0, None), ("own", 7, "own:7", 1, None)]
    assert sorted({r.run_id for r in activities.collect()}) == ["listed:1", "listed:2", "listed:3", "own:7"] and activities.count() == 8


def test_labels_of_one_run_id_are_judged_by_their_own_files(spark):
    history = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    value = lambda n, step: json.dumps({"config": "c", "row_idx": 5, "row": {"history": history * n, "mistake_step": step}})
    texts = spark.createDataFrame([("/d/one.json", value(1, "1")), ("/d/two.json", value(3, "5")), ("/d/three.json", value(1, "3"))], "path string, value string")
    activities, found = labels.label_set(texts, spark.createDataFrame([], MANIFEST))
    assert {(r.run_id, r.expected_step, r.exclusion) for r in found.collect()} == {("c:5", 1, None), ("c:5", 5, None), ("c:5", None, "step out of range")} and found.count() == 3
    assert activities.count() == 10


def test_studies_go_on_past_bad_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"run{k}.jsonl").write_text("\n".join(map(json.dumps, cli.DEMO)))
    (tmp_path / "bad.jsonl").write_text("{}\n{oops\n")
    args = lambda command: cli.parser().parse_args([command, str(tmp_path), "--format", "linked"])
    for command in ("study", "accuracy"):
        text, code = cli.run(spark, args(command))
        assert code == 0 and "Files that failed" in text and "ValueError" in text
    with pytest.raises(Exception, match="bad.jsonl:2"):
        cli.run(spark, args("localize"))
    (tmp_path / "bad.jsonl").unlink()
    assert "Files that failed" not in cli.run(spark, args("study"))[0]
    assert cli.run(spark, args("localize"))[0].count("G2") == 3
