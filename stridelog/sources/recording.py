"""What all recording formats share: canonical JSON, summaries, and the activity row."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from ..schema import ACTION_KINDS, COLUMNS, KINDS

#: Commands that run tests or builds, lower case. The second list is for histories of shell agents.
TEST_COMMANDS = [
    r"\bpytest\b",
    r"\bpython(?:\.exe)?\s+-m\s+pytest\b",
    r"\bpython(?:\.exe)?\s+-m\s+unittest\b",
    r"\bpython(?:\.exe)?\s+-m\s+[\w.]*verify\b",
    r"\bnpm\s+test\b",
    r"\bnpm\s+run\s+(test|build)\b",
    r"\bpnpm\s+(test|build)\b",
    r"\byarn\s+(test|build)\b",
    r"\bgo\s+test\b",
    r"\bcargo\s+test\b",
]
HISTORY_TEST_COMMANDS = [
    r"\bpytest\b",
    r"\bpython(?:3)?\s+[\w./-]+\.py\b",
    r"\bnpm\s+(test|run\s+test|run\s+build)\b",
    r"\btox\b",
    r"\bgo\s+test\b",
    r"\bcargo\s+test\b",
]
#: Where results keep their text and their exit code.
RESULT_TEXT, EXIT_CODE, NESTED = ("result_text", "stdout", "stderr", "text", "output"), ("exit_code", "exitCode", "code"), ("tool_result", "tool_use_result")


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def is_test(command: Any, patterns: list[str] = TEST_COMMANDS) -> bool:
    return isinstance(command, str) and re.search("|".join(patterns), command.lower()) is not None


def text_or_none(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def whole_number(value: Any) -> int | None:
    """An int or a string of digits; truth values are no numbers."""
    if isinstance(value, str) and re.fullmatch(r"\s*-?\d+\s*", value):
        return int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def find_code(payload: Any, keys: tuple[str, ...] = (*EXIT_CODE, "status")) -> int | None:
    """The first exit code of a nested object, its own keys before its values' in their order."""
    if not isinstance(payload, dict):
        return None
    found = [n for k in keys if (n := whole_number(payload.get(k))) is not None]
    return found[0] if found else next((n for v in payload.values() if (n := find_code(v, keys)) is not None), None)


def recorded_code(outputs: dict) -> int | None:
    own = [n for k in EXIT_CODE if (n := whole_number(outputs.get(k))) is not None]
    return own[0] if own else next((n for k in NESTED if isinstance(outputs.get(k), dict) and (n := recorded_code(outputs[k])) is not None), None)


def recorded_text(outputs: dict) -> str:
    own = [outputs[k] for k in RESULT_TEXT if isinstance(outputs.get(k), str) and outputs[k]]
    return "\n".join(own + [t for k in NESTED if isinstance(outputs.get(k), dict) and (t := recorded_text(outputs[k]))])


def gather_text(value: Any, keys: tuple[str, ...]) -> str:
    """Strings of a nested value, depth first, through lists and the named keys."""
    if isinstance(value, str):
        return value
    parts = value if isinstance(value, list) else [value.get(k) for k in keys] if isinstance(value, dict) else []
    return "\n".join(t for p in parts if (t := gather_text(p, keys)))


class Recording:
    """The activities of one run, as they come in."""

    def __init__(self, run_id: str, source: str):
        self.run_id, self.source, self.steps = run_id, source, []

    def add(self, kind: str, parent: int | None = None, ts: str = "", tool: str | None = None, target: str | None = None, inputs: dict | None = None, outputs: dict | None = None) -> dict:
        if kind not in KINDS:
            raise ValueError(f"invalid activity kind: {kind}")
        step = {"step": len(self.steps), "kind": kind, "parent": parent, "ts": ts, "tool": tool, "target": target, "inputs": inputs or {}, "outputs": outputs or {}}
        self.steps.append(step)
        return step

    def rows(self) -> list[dict]:
        return [row(self.run_id, self.source, s) for s in self.steps]


def is_action(step: dict) -> bool:
    return step["kind"] in ACTION_KINDS


def row(run_id: str, source: str, s: dict) -> dict:
    """A row of the activities table; payload fields are null unless of the required type."""
    x, out = s["inputs"], s["outputs"]
    text = lambda k: x[k] if isinstance(x.get(k), str) else None
    edits = x.get("edits")
    fields = {"inputs": x, "kind": s["kind"], "outputs": out, "parent_step": s["parent"], "run_id": run_id, "step_index": s["step"], "target": s["target"], "tool_name": s["tool"], "ts": s["ts"]}
    made = {
        "run_id": run_id, "source": source, "pos": s["step"], "step_index": s["step"], "ts": s["ts"], "kind": s["kind"], "tool_name": s["tool"], "target": s["target"], "parent_step": s["parent"],
        "inputs_json": canonical(x), "outputs_json": canonical(out), "content_hash": digest(canonical(fields)),
        **{k: text(k) for k in ("file_path", "old_string", "new_string", "pattern", "command")}, "write_mode": x.get("write_mode") is True,
        "edits": [{k: e[k] if isinstance(e.get(k), str) else None for k in ("old_string", "new_string")} for e in edits if isinstance(e, dict)] if isinstance(edits, list) else None,
        "edits_is_list": isinstance(edits, list), "exit_code": recorded_code(out), "test_text": recorded_text(out),
    }
    return {c: made[c] for c in COLUMNS}
