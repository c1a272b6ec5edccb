"""The three checks of every step: schema, edit applies, test result.

Each takes activities and returns run_id, pos, step_index, gate, status, evidence.
G1 and G3 are expressions; G2 is one ordered pass per run and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passes import in_order

# What a normalized, lower-cased test output must show, on any line.
FAIL_SIGNALS = [
    r"\b[1-9]\d*\s+failed\b",
    r"\b[1-9]\d*\s+failures?\b",
    r"\b[1-9]\d*\s+errors?\b",
    r"^=+\s*failures?\s*=+$",
    r"^failed\b",
    r"^fail\s+\S+",
    r"^errors?\b",
    r"\berror:",
    r"\bnpm err!\b",
    r"\btraceback\b",
    r"\bexception\b",
    r"\bassertionerror\b",
    r"\bpanic\b",
    r"\bcompilation failed\b",
    r"test result:\s*failed",
    r"---\s*fail:",
]
PASS_SIGNALS = [
    r"\b\d+\s+passed\b",
    r"\btests?:\s*\d+\s+passed\b",
    r"\btest files?\s+\d+\s+passed\b",
    r"\btest result:\s*ok\b",
    r"^ok\s+\S+",
    r"^ok$",
    r"\bpass\b",
    r"\bcompiled successfully\b",
    r"\bbuild succeeded\b",
]
# What normalization takes out of a test output, in order.
NOISE = [
    (r"\x1b\[[0-9;]*[A-Za-z]", ""),
    (r"\r\n?", "\n"),
    (r"(?i)\b(?:in|after)\s+\d+(?:\.\d+)?s\b", ""),
    (r"(?i)\b\d+(?:\.\d+)?\s*(?:ms|s|sec|secs|seconds)\b", ""),
    (r"(?i)\bchunk(?:-|_)?id[:=]\S+", ""),
    (r"(?i)\btokens?[:=]\d+\b", ""),
    (r"[ \t]+", " "),
]
#: Lines end at LF only and classes are Unicode's, as in the patterns' own dialect.
_FLAGS = "(?mdU)"
_FILE_EDIT, _CALL, _TEST = ("file_path", "old_string", "new_string"), {"Read": "file_path", "Grep": "pattern", "Glob": "pattern"}, ("Bash", "PowerShell")


def _missing(*names: str) -> Column:
    return F.concat_ws("; ", *[F.when(F.col(n).isNull(), F.lit(f"{n} missing/not str")) for n in names])


def _result(df: DataFrame, gate: str, status: Column, evidence: Column) -> DataFrame:
    return df.select("run_id", "pos", "step_index", F.lit(gate).alias("gate"), status.alias("status"), evidence.alias("evidence"))


def g1(activities: DataFrame) -> DataFrame:
    """Does a structured step carry what its kind requires?"""
    kind, tool = F.col("kind"), F.col("tool_name")
    call = F.when(F.coalesce(tool, F.lit("")) == "", "missing tool_name")
    for name, need in _CALL.items():
        call = call.when(tool == name, _missing(need))
    bad = (
        F.when(kind == "file_edit", _missing(*_FILE_EDIT))
        .when(kind == "tool_call", call.otherwise(""))
        .when(kind == "test_run", F.when(~F.coalesce(tool.isin(*_TEST), F.lit(False)), "tool_name must be Bash or PowerShell").otherwise(_missing("command")))
        .otherwise("")
    )
    judged = kind.isin("file_edit", "tool_call", "test_run", "verdict")
    status = F.when(~judged, "NA").when(bad != "", "FAIL").otherwise("PASS")
    evidence = F.when(~judged, "not a structured activity").when(bad != "", F.concat(kind, F.lit(" malformed: "), bad)).when(kind == "verdict", "verdict activity schema ok").otherwise(F.concat(kind, F.lit(" schema ok")))
    return _result(activities, "G1", status, evidence)


def _apply(text: str, fragments: list[dict]) -> tuple[str, str | None]:
    """``text`` after all fragments, one after another, and the first complaint. Content moves only if all apply."""
    now = text
    for n, x in enumerate(fragments, 1):
        old, new = x["old_string"], x["new_string"]
        if old is None or new is None:
            return text, f"edit {n} malformed"
        if old == "":
            return text, f"edit {n} empty old_string"
        if (found := now.count(old)) != 1:
            return text, f"edit {n} old_string {'ambiguous' if found else 'not found'}"
        now = now.replace(old, new)
    return now, None


def _judge_edit(state: str | None, run_id: str, file_path: str, pos: int, step_index: int, write: bool, content: str | None, fragments: list[dict] | None) -> tuple[str | None, tuple]:
    """The file's content after an edit (none before a full write anchors it), and the edit's result."""
    if write:
        said = ("FAIL", "write malformed: missing content") if content is None else ("PASS", "full-content anchor established")
        state = state if content is None else content
    elif not fragments:
        said = "FAIL", "file_edit malformed: missing edit fragments"
    elif state is None:
        said = "NA", "no full-content anchor"
    else:
        state, bad = _apply(state, fragments)
        said = ("FAIL", bad) if bad else ("PASS", "old_string matched uniquely" if len(fragments) == 1 else f"{len(fragments)} edits matched uniquely")
    return state, (run_id, pos, step_index, *said)


def g2(activities: DataFrame) -> DataFrame:
    """Do edits apply to the content that earlier steps of the run established?

    Edits of one file of a run pass in order over the file's content, which is all
    that is carried. Steps that are no edit, or whose own fields already decide,
    never reach the pass.
    """
    is_edit, path = F.col("kind") == "file_edit", F.col("file_path")
    write = (F.coalesce(F.col("tool_name"), F.lit("")) == "Write") | F.coalesce("write_mode", F.lit(False))
    single = F.array(F.struct(F.col("old_string"), F.col("new_string")))
    many = F.coalesce("edits_is_list", F.lit(False)) & (F.col("tool_name") == "MultiEdit")
    fragments = F.when(many, F.col("edits")).otherwise(single)
    rows = activities.where(is_edit & (F.coalesce(path, F.lit("")) != "")).select("run_id", "file_path", "pos", "step_index", write.alias("write"), F.col("new_string").alias("content"), fragments.alias("fragments"))
    judged = in_order(rows, ["run_id", "file_path"], ["pos", "step_index"], _judge_edit, lambda: None, "run_id string, pos int, step_index int, status string, evidence string")
    judged = judged.select("run_id", "pos", "step_index", F.lit("G2").alias("gate"), "status", "evidence")
    rest = activities.where(~is_edit | (F.coalesce(path, F.lit("")) == ""))
    other = _result(rest, "G2", F.when(is_edit, "FAIL").otherwise("NA"), F.when(is_edit, "file_edit malformed: missing file_path").otherwise("not a file_edit"))
    return judged.unionByName(other)


def normalized_output(text: Column) -> Column:
    for pattern, by in NOISE:
        text = F.regexp_replace(text, f"(?dU){pattern}", by)
    return F.lower(F.regexp_replace(text, r"(?dU)\A\s+|\s+\z", ""))


def signal(text: Column, patterns: list[str]) -> Column:
    """One alternation instead of a list of searches."""
    return text.rlike(_FLAGS + "(?:" + "|".join(patterns) + ")")


def g3(activities: DataFrame) -> DataFrame:
    """What does the recorded test output say? Exit code, then failure, then success."""
    out = normalized_output(F.coalesce("test_text", F.lit("")))
    rows = activities.withColumn("out", F.when(F.col("kind") == "test_run", out))
    test = F.col("kind") == "test_run"
    exit_bad = F.coalesce(F.col("exit_code") != 0, F.lit(False))
    failed, passed = signal(F.col("out"), FAIL_SIGNALS), signal(F.col("out"), PASS_SIGNALS)
    status = F.when(~test, "NA").when(exit_bad | failed, "FAIL").when(passed, "PASS").otherwise("NA")
    evidence = F.when(~test, "not a test_run").when(exit_bad, "non-zero exit code").when(failed, "test failure signal").when(passed, "test pass signal").otherwise("unparseable test output")
    return _result(rows, "G3", status, evidence)


def gate_results(activities: DataFrame) -> DataFrame:
    return g1(activities).unionByName(g2(activities)).unionByName(g3(activities))


def failures(results: DataFrame) -> DataFrame:
    """run_id, step_index, gate: the first failing gate of each failing step."""
    return results.where("status = 'FAIL'").groupBy("run_id", "step_index").agg(F.min("gate").alias("gate"))


def status_matrix(results: DataFrame) -> DataFrame:
    """A row per step, a column per gate."""
    return results.groupBy("run_id", "pos", "step_index").pivot("gate", ["G1", "G2", "G3"]).agg(F.first("status"))


def dirty_runs(results: DataFrame) -> DataFrame:
    return results.where("status = 'FAIL'").select("run_id").distinct()


def clean_runs(activities: DataFrame, results: DataFrame) -> DataFrame:
    return activities.select("run_id").distinct().join(dirty_runs(results), "run_id", "left_anti")
