"""Recordings of uuid-linked records with content blocks (text, tool_use, tool_result)."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linking import keyed, resolved, rows
from .recording import canonical, digest, find_code, gather_text, is_test, text_or_none

EDITS, READERS, SHELLS = ("Edit", "MultiEdit", "Write"), ("Read", "Grep", "Glob"), ("Bash", "PowerShell")
_TEXT = ("stdout", "stderr", "output", "text", "content")


def blocks_of(record: dict) -> list[dict]:
    message = record.get("message")
    content = message["content"] if isinstance(message, dict) and "content" in message else record.get("content")
    if isinstance(content, str):
        return [{"type": "text", "text": content}]
    return [b for b in (content if isinstance(content, list) else [content]) if isinstance(b, dict)]


def _said(blocks: list[dict]) -> dict:
    text = "\n".join(b["text"] for b in blocks)
    return {"text_blocks": len(blocks), "text_length": len(text), "text_hash": digest(text)}


def tool_inputs(tool: str | None, raw: dict) -> dict:
    """A full write becomes new_string; several edits also get joined fragments, their own fields first."""
    if tool == "Write":
        return {"file_path": raw.get("file_path"), "old_string": "", "new_string": raw.get("content", ""), "write_mode": True}
    if tool != "MultiEdit":
        return dict(raw)
    edits = raw.get("edits")
    joined = {k: "\n".join(str(e.get(k, "")) for e in edits if isinstance(e, dict)) if isinstance(edits, list) else raw.get(k, "") for k in ("old_string", "new_string")}
    return joined | raw


def _target(tool: str | None, x: dict) -> str | None:
    if tool in SHELLS:
        return "shell"
    if tool in ("Grep", "Glob"):
        return text_or_none(x.get("path")) or text_or_none(x.get("pattern"))
    return text_or_none(x.get("file_path"))


def _kind(tool: str | None, x: dict) -> str:
    if tool in EDITS:
        return "file_edit"
    if tool in READERS:
        return "tool_call"
    return "test_run" if tool in SHELLS and is_test(x.get("command")) else "opaque_shell"


def _answer(block: dict, top: Any) -> dict:
    content = canonical(block.get("content"))
    about = {"is_error": bool(block.get("is_error", False)), "content_kind": type(block.get("content")).__name__, "content_length": len(content), "content_hash": digest(content)}
    said = None if top is None else canonical(top)
    own = None if top is None else {"payload_kind": type(top).__name__, "keys": sorted(map(str, top)) if isinstance(top, dict) else [], "payload_length": len(said), "payload_hash": digest(said)}
    return {"tool_result": about, "tool_use_result": own}


def _test_answer(block: dict, top: Any) -> dict:
    """What a test run's answer adds: its text and exit code."""
    text = "\n".join(t for t in (gather_text(block.get("content"), _TEXT), gather_text(top, _TEXT)) if t)
    codes = [n for p in (top, block) if (n := find_code(p)) is not None]
    return ({"result_text": text} if text else {}) | ({"exit_code": codes[0]} if codes else {})


_FACTS = (
    "uuid string, after string, refers array<string>, drafts array<struct<kind:string,tool:string,target:string,inputs:string,outputs:string,use_id:string>>, "
    "answers array<struct<use_id:string,answer:string,test_answer:string>>"
)
_ID = canonical  # ids are any JSON value; as text they compare alike


def facts(record: dict) -> dict:
    """A record's own id, the ids it refers to, the activities it makes, the answers it holds."""
    blocks, kind = blocks_of(record), text_or_none(record.get("type")) or ""
    of = lambda *types: [b for b in blocks if b.get("type") in types]
    answers, texts = of("tool_result"), [b for b in of(None, "text") if isinstance(b.get("text"), str) and b["text"]]
    drafts = []
    if texts and (kind == "assistant" or kind == "user" and not answers):
        drafts.append({"kind": "llm_call", "outputs": _said(texts)} if kind == "assistant" else {"kind": "user_msg", "inputs": _said(texts)})
    for b in of("tool_use"):
        tool = text_or_none(b.get("name"))
        x = tool_inputs(tool, b["input"] if isinstance(b.get("input"), dict) else {})
        drafts.append({"kind": _kind(tool, x), "tool": tool, "target": _target(tool, x), "inputs": x, "use_id": _ID(b["id"]) if b.get("id") else None})
    if not drafts and not answers and kind not in ("user", "assistant"):
        drafts.append({"kind": "opaque_shell", "inputs": {"record_type": kind or "<missing>", "top_level_keys": sorted(record)}})
    return {
        "uuid": _ID(record["uuid"]) if record.get("uuid") else None, "after": None if record.get("parentUuid") is None else _ID(record["parentUuid"]), "refers": [_ID(b["tool_use_id"]) for b in blocks if b.get("tool_use_id") is not None],
        "drafts": [{"tool": None, "target": None, "use_id": None} | d | {k: canonical(d.get(k, {})) for k in ("inputs", "outputs")} for d in drafts],
        "answers": [{"use_id": _ID(b.get("tool_use_id")), "answer": canonical(_answer(b, record.get("toolUseResult"))), "test_answer": canonical(_test_answer(b, record.get("toolUseResult")))} for b in answers],
    }


def _made(said: str, step: int, parent: int | None, kind: str, tool: str | None, target: str | None, inputs: str, outputs: str, answer: str | None, test_answer: str | None) -> dict:
    out = json.loads(answer) | (json.loads(test_answer) if kind == "test_run" else {}) if answer else json.loads(outputs)
    return {"source": "linked", "step": int(step), "parent": None if parent is None else int(parent), "ts": text_or_none(json.loads(said).get("timestamp")) or "", "kind": kind, "tool": tool, "target": target, "inputs": json.loads(inputs), "outputs": out}


def activities(records: DataFrame) -> DataFrame:
    """path, error, activity. A record's activities share a parent: the first of the record that it names, else of a call it names; a call's last answer stands."""
    read = keyed(records, facts, _FACTS)
    order = Window.partitionBy("path").orderBy("pos", "nth")
    drafts = read.select("path", "run_id", "pos", "record", "uuid", F.posexplode("drafts").alias("nth", "d")).withColumn("step", F.row_number().over(order) - 1)
    used = drafts.where("d.use_id IS NOT NULL").select("path", F.col("d.use_id").alias("key"), F.struct("pos", (F.col("nth") + 2).alias("nth")).alias("at"), "step")
    # an answer may be to a call of its own record, so it comes after all of that
    last = F.lit(2**30)
    answers = read.select("path", "pos", "uuid", F.posexplode("answers").alias("nth", "a"))
    answers = resolved(answers.select("path", "pos", "uuid", "nth", F.col("a.use_id").alias("key"), F.struct("pos", last.alias("nth")).alias("at"), "a"), used).where("step IS NOT NULL")
    # a record's id stands for its first activity; without any for the call that its first answer is to
    firsts = drafts.where("nth = 0").select("path", "pos", "uuid", "step").unionByName(answers.groupBy("path", "pos", "uuid").agg(F.min_by("step", "nth").alias("step")).join(drafts.select("path", "pos").distinct(), ["path", "pos"], "left_anti"))
    named = firsts.where("uuid IS NOT NULL").select("path", F.concat(F.lit("record "), "uuid").alias("key"), F.struct("pos", F.lit(2).alias("nth")).alias("at"), "step")
    refs = read.select("path", "pos", F.posexplode(F.concat(F.array(F.concat(F.lit("record "), "after")), "refers")).alias("rank", "key")).where("key IS NOT NULL").withColumn("at", F.struct("pos", F.lit(1).alias("nth")))
    parents = resolved(refs, named.unionByName(used)).where("step IS NOT NULL").groupBy("path", "pos").agg(F.min_by("step", "rank").alias("parent"))
    latest = answers.groupBy("path", "step").agg(F.max_by("a", F.struct("pos", "nth")).alias("a"))
    made = drafts.join(parents, ["path", "pos"], "left").join(latest, ["path", "step"], "left").select("path", "run_id", "record", "step", "parent", "d.*", "a.answer", "a.test_answer")
    return rows(made, _made, "record", "step", "parent", "kind", "tool", "target", "inputs", "outputs", "answer", "test_answer")
