"""Journals read by byte ranges against the reader of whole texts, at every cut and for every kind of damage."""

import json

import pytest
from pyspark.sql import functions as F

from stridelog.schema import complete
from stridelog.sources import files, journals


@pytest.fixture(scope="module")
def lines(spark):
    a = complete(spark.range(120).select(F.lit("run").alias("run_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("step_index"), F.lit("llm_call").alias("kind"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_step"), F.format_string('{"text":"é%s"}', F.repeat(F.lit("z"), (F.col("id") % 40).cast("int"))).alias("inputs_json")))
    return [r.value for r in files.journal_lines(a).orderBy("pos").collect()]


@pytest.fixture
def ranges(spark):
    """Files of kilobytes in many ranges each."""
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def read(spark, path):
    found = journals.read_journals(spark, str(path), strict=False).select("path", "error", "activity.pos", "activity.content_hash", "record_hash").collect()
    return {r.path.rsplit("/", 1)[-1]: r.error for r in found}, sorted((r.path.rsplit("/", 1)[-1], r.pos, r.content_hash, r.record_hash) for r in found if r.error is None)


def test_many_ranges_of_one_file(spark, lines, ranges, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines[:50]))
    (tmp_path / "empty.jsonl").write_text("")
    assert journals.ranged_lines(spark, str(tmp_path)).select("path", "start").distinct().count() > 20
    errors, rows = read(spark, tmp_path)
    assert errors == {"a.jsonl": None, "b.jsonl": None}
    own = [json.loads(x) for x in lines]
    want = [(f, i, r["activity"]["content_hash"], r["record_hash"]) for f, n in (("a.jsonl", 120), ("b.jsonl", 50)) for i, r in enumerate(own[:n])]
    assert rows == want
    assert journals.read_journals(spark, str(tmp_path)).count() == 170 and files.read_activities(spark, str(tmp_path), "journal").count() == 170


@pytest.mark.parametrize("at", [0, 40, 119])
def test_damage(spark, lines, ranges, tmp_path, at):
    """At any place, range edges among them, the fault is named as by the reader of whole texts."""
    other = json.loads(lines[at])
    other["record_hash"] = "0" * 64
    harms = {
        "changed": [*lines[:at], lines[at].replace('"ts":"', '"ts":"x'), *lines[at + 1 :]],
        "sealed": [*lines[:at], json.dumps(other), *lines[at + 1 :]],
        "oops": [*lines[:at], "{oops", *lines[at + 1 :]],
        "none": [*lines[:at], '{"activity": {}}', *lines[at + 1 :]],
        "twice": [*lines[: at + 1], *lines[at:]],
    } | ({"lost": [*lines[:at], *lines[at + 1 :]]} if at < 119 else {})
    for name, text in harms.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(text) + "\n")
    errors, rows = read(spark, tmp_path)
    assert rows == [] and set(errors) == {f"{x}.jsonl" for x in harms}
    for name, text in harms.items():
        with pytest.raises(ValueError) as e:
            files.parse_journal("j", "\n".join(text))
        said = errors[f"{name}.jsonl"]
        assert said == {"oops": f"line {at + 1}: invalid JSON", "none": f"line {at + 1}: not a journal record"}.get(name, said)
        if name not in ("oops", "none"):
            assert str(e.value) == f"j: {said}"
    with pytest.raises(ValueError, match="record|line"):
        journals.read_journals(spark, str(tmp_path))


def test_a_fault_of_form_comes_first(spark, lines, ranges, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join([lines[1], *lines[2:60], "[]", *lines[60:]]))
    assert read(spark, tmp_path)[0] == {"x.jsonl": "line 60: not a journal record"}
