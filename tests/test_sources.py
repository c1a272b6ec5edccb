"""Readers of recordings, on hand-written files."""

import json

import pytest

from stridelog.operators import gates, hashing, localize
from stridelog.sources import files, linked

LINKED = [
    {"type": "user", "uuid": "a", "message": {"content": "please"}},
    {"type": "assistant", "uuid": "b", "parentUuid": "a", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "w", "name": "Write", "input": {"file_path": "m.py", "content": "x = 1\n"}}]}},
    {"type": "user", "uuid": "c", "parentUuid": "b", "message": {"content": [{"type": "tool_result", "tool_use_id": "w", "content": "done"}]}},
    {"type": "assistant", "uuid": "d", "parentUuid": "c", "message": {"content": [{"type": "tool_use", "id": "e", "name": "Edit", "input": {"file_path": "m.py", "old_string": "y = 1", "new_string": "z"}}]}},
    {"type": "assistant", "uuid": "f", "parentUuid": "d", "message": {"content": [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "pytest -q"}}]}},
    {"type": "user", "uuid": "g", "parentUuid": "f", "toolUseResult": {"stdout": "1 failed", "exitCode": 1}, "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": "1 failed"}]}},
    {"type": "summary"},
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "run1.jsonl").write_text("\n".join(map(json.dumps, LINKED)) + "\n\n")
    return tmp_path


def test_linked_end_to_end(spark, folder):
    a = files.read_activities(spark, str(folder)).cache()
    rows = a.orderBy("pos").collect()
    assert [r.kind for r in rows] == ["user_msg", "llm_call", "file_edit", "file_edit", "test_run", "opaque_shell"]
    assert [r.parent_step for r in rows] == [None, 0, 0, 2, 3, None]
    assert rows[4].exit_code == 1 and "1 failed" in rows[4].test_text
    assert {r.run_id: r.content_hash for r in rows} and all(x.content_hash == y.content_hash for x, y in zip(rows, hashing.with_content_hash(a).orderBy("pos").collect(), strict=True))
    found = localize.localize(a).collect()
    assert [(r.breaking_step, r.breaking_gate, r.cascade, r.confidence) for r in found] == [(3, "G2", [4], "HIGH")]
    status = {(r.step_index, r.gate): r.status for r in gates.gate_results(a).collect()}
    assert status[2, "G2"] == "PASS" and status[3, "G2"] == "FAIL" and status[4, "G3"] == "FAIL" and status[0, "G1"] == "NA"


def test_journal_round_trip_and_tampering(spark, folder, tmp_path):
    a = files.read_activities(spark, str(folder))
    lines = [r.value for r in files.journal_lines(a).orderBy("pos").collect()]
    text = "\n".join(lines) + "\n"
    assert files.looks_like_journal(text) and [r["kind"] for r in files.parse_journal("j", text)] == [r.kind for r in a.orderBy("pos").collect()]
    for bad in (text.replace('"pytest -q"', '"pytest -x"'), "\n".join(lines[:1] + lines[2:]), text.replace("record_hash", "other", 1)):
        with pytest.raises(ValueError):
            files.parse_journal("j", bad)
    files.write_journals(a, str(tmp_path / "out"))
    again = files.read_activities(spark, str(tmp_path / "out"))
    assert again.count() == len(lines)


def test_bad_files_are_errors_or_counted(spark, folder):
    (folder / "bad.jsonl").write_text("{}\n{oops\n")
    out = files.read_files(spark, str(folder), "linked", strict=False)
    assert [(r.error, r.files) for r in files.read_errors(out).collect()] == [("ValueError", 1)]
    assert {r.path.rsplit("/", 1)[-1]: r.records for r in files.count_records(spark, str(folder)).collect()} == {"run1.jsonl": 7, "bad.jsonl": 2}
    with pytest.raises(ValueError, match="bad.jsonl:2"):
        files.split("bad.jsonl", "{}\n{oops\n", "linked")


def test_multi_edit_and_readers():
    x = linked.tool_inputs("MultiEdit", {"file_path": "f", "edits": [{"old_string": "a", "new_string": "b"}, {"old_string": "c", "new_string": "d"}, 3]})
    assert (x["old_string"], x["new_string"]) == ("a\nc", "b\nd")
    assert linked.tool_inputs("Write", {"content": "q"}) == {"file_path": None, "old_string": "", "new_string": "q", "write_mode": True}


def read(spark, form, text, stem="s"):
    rows = files.read_texts(spark.createDataFrame([(f"x/{stem}.json", text)], "path string, value string"), form).select("activity.*").orderBy("pos").collect()
    return [r.asDict() | {"inputs": json.loads(r.inputs_json), "outputs": json.loads(r.outputs_json)} for r in rows]


def test_calls(spark):
    patch = "*** Begin\n*** Update File: b.py\n*** Add File: a.py\n"
    records = [
        {"type": "session_meta", "payload": {"type": "meta"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "hi", "turn_id": "1"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "call_id": "c1", "arguments": '{"cmd": "pytest"}', "turn_id": "1"}},
        {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "call_id": "c2", "input": patch}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "Exit code: 1\n2 passed, 1 failed"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "zz", "output": ""}},
        {"type": "event_msg", "payload": {"type": "task_complete"}},
        7,
    ]
    steps = read(spark, "calls", "\n".join(map(json.dumps, records)))
    assert [s["kind"] for s in steps] == ["unmapped", "user_msg", "test_run", "file_edit", "unmapped", "verdict", "unmapped"]
    assert [s["parent_step"] for s in steps] == [None, 0, 1, 2, 2, 4, None]
    assert steps[2]["outputs"]["exit_code"] == 1 and steps[2]["outputs"]["result_text"] == "2 passed"
    assert steps[3]["inputs"]["patch_targets"] == ["a.py", "b.py"] and steps[3]["target"] is None
    assert steps[4]["inputs"]["reason"] == "unlinked_function_call_output" and len(steps[0]["run_id"]) == 22


def call(name, ident="i", **args):
    return {"role": "assistant", "tool_calls": [{"id": ident, "function": {"name": name, "arguments": json.dumps(args)}}]}


def test_action_history(spark):
    steps = read(spark, "action", json.dumps({"history": [
        {"role": "system", "content": "s"}, {"role": "user", "content": "task"}, {"role": "assistant", "action": "create new.py", "content": ""}, {"role": "user", "content": "[File: new.py (1 lines total)]"},
        {"role": "assistant", "action": "edit 1:1\nprint(1)\nend_of_edit"}, {"role": "user", "content": "ok (Open file: new.py)"}, call("edit", search="print(1)", replace="print(2)"), {"role": "tool", "tool_call_ids": ["i"], "content": "done"},
        {"role": "assistant", "action": "python new.py"}, {"role": "alien"}, "text",
    ]}))
    assert [s["kind"] for s in steps] == ["user_msg", "user_msg", "tool_call", "verdict", "file_edit", "verdict", "file_edit", "verdict", "test_run", "unmapped", "unmapped"]
    assert steps[4]["tool_name"] == "Write" and steps[6]["inputs"]["file_path"] == "new.py" and steps[6]["outputs"]["result_text"] == "done"
    assert [s["parent_step"] for s in steps][:8] == [None, None, None, 2, 2, 4, 4, 6]


def test_editor_and_fenced_histories(spark):
    steps = read(spark, "editor", json.dumps({"row": {"instance_id": "i", "trajectory_id": "t", "trajectory": [
        {"role": "user", "content": "x"}, call("str_replace_editor", "1", command="view", path="a.py"), {"role": "tool", "tool_call_id": "1", "name": "str_replace_editor", "content": "body"},
        call("str_replace_editor", "2", command="str_replace", path="a.py", old_str="b", new_str=""), call("execute_bash", "3", command="pytest"), call("think", "4"), call("finish", "5"), call("what", "6"),
    ]}}))
    assert steps[0]["run_id"] == "i::t" and [s["kind"] for s in steps] == ["user_msg", "tool_call", "verdict", "file_edit", "test_run", "llm_call", "tool_call", "unmapped"]
    assert read(spark, "editor", "{}")[0]["inputs"]["reason"] == "openhands_missing_trajectory"
    fenced = read(spark, "fenced", json.dumps({"instance_id": "m", "messages": [
        {"role": "user", "content": "go"}, {"role": "assistant", "content": "```bash\nsed -i 's/a/b/' f.py\n```"}, {"role": "user", "content": "<returncode>0</returncode><output>\nfine\n</output>"},
        {"role": "assistant", "content": "```\npython t.py\n```"}, {"role": "user", "content": "<returncode>1</returncode>"}, {"role": "assistant", "content": "```\ncat > n.py <<EOF\nEOF\n```"}, {"role": "exit", "content": "end"},
    ]}))
    assert [s["kind"] for s in fenced] == ["user_msg", "file_edit", "verdict", "test_run", "verdict", "file_edit", "verdict"]
    assert [s["parent_step"] for s in fenced] == [None, None, 1, None, 3, None, 5] and fenced[3]["outputs"]["exit_code"] == 1 and fenced[1]["outputs"]["result_text"] == "fine"


def test_chat(spark):
    steps = read(spark, "chat", json.dumps({"history": [{"role": "human", "content": "q"}, {"role": "assistant", "name": "Planner", "content": "p"}, {"role": "Computer_terminal", "content": "o"}, {"role": "Expert (thought)", "content": "e"}, {"role": "assistant", "content": "?"}]}))
    assert [s["kind"] for s in steps] == ["user_msg", "llm_call", "unmapped", "llm_call", "unmapped"] and steps[3]["parent_step"] == 2


def test_auto_knows_each_form(spark, tmp_path):
    made = {
        "a.jsonl": "\n".join(map(json.dumps, LINKED)), "b.jsonl": json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "x"}}),
        "c.json": json.dumps({"history": [{"role": "user", "content": "t"}]}), "d.json": json.dumps({"row": {"instance_id": "i", "trajectory": [{"role": "user"}]}}),
        "e.json": json.dumps({"trajectory_format": "1", "messages": [{"role": "user"}]}), "f.json": json.dumps({"question_ID": "q", "history": [{"role": "human", "content": "x"}]}),
    }
    for name, text in made.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[-1]: r.source for r in files.read_files(spark, str(tmp_path)).select("path", "activity.source").distinct().collect()}
    assert got == {"a.jsonl": "linked", "b.jsonl": "calls", "c.json": "action", "d.json": "editor", "e.json": "fenced", "f.json": "chat"}


def test_recordings_by_place_and_name(spark, tmp_path):
    """Of a folder, what stands where a tool leaves it; a dialect in the name comes before the look; given files are read as they are."""
    fixtures = tmp_path / "tests" / "fixtures"
    fixtures.mkdir(parents=True)
    history = json.dumps({"messages": [{"role": "user", "content": "t"}], "history": [{"role": "user", "content": "t"}]})
    for path, text in {fixtures / "SWE-agent.traj": history, fixtures / "plain.json": history, fixtures / "notes.md": "x", tmp_path / "c.json": history, tmp_path / "a b.txt": json.dumps(LINKED[0])}.items():
        path.write_text(text)
    read = lambda paths, form="auto": {r.path.rsplit("/", 1)[-1]: r.source for r in files.read_files(spark, paths, form, placed=True).select("path", "activity.source").distinct().collect()}
    assert read(str(tmp_path)) == {"SWE-agent.traj": "action", "plain.json": "fenced"}
    assert read([str(fixtures), str(tmp_path / "a b.txt")]) == {"SWE-agent.traj": "action", "plain.json": "fenced", "a%20b.txt": "linked"}
    (fixtures / "manifest.json").write_text("{}")
    assert set(read(str(fixtures), "fenced")) == {"SWE-agent.traj", "plain.json"}
