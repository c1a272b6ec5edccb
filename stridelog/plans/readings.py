"""Readers over recordings made up from the driver's tables, and what SQL says they must find.

The tables hold no recordings, so each user's events become one file's text in a
reader's format (a line or a record an event) and the reader does the rest. The SQL
never sees that text: it says from the events what the activities are.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import labels
from ..scratch import new_folder
from ..sources import files, journals
from . import journal
from . import oracle as o

#: A user's events in order, each with the number in its properties.
_ORDERED = "SELECT user_id, event_id, event_type AS t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}"

#: Format -> event type -> its record's text. {k}, {k2}, {k3}, {k4}, {k5}: the number, and modulo these; | divides the even from the odd.
RECORDS = {
    "calls": {
        "signup": '{"type":"event_msg","timestamp":"{id}","payload":{"type":"user_message","message":"m{k}","turn_id":"t{k3}"}}',
        "view": '{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"m{k}"}]}}',
        "click": r'{"type":"response_item","payload":{"type":"function_call","name":"exec_command","call_id":"c{k4}","turn_id":"t{k3}","arguments":"{\"cmd\":\"pytest\"}"}}|{"type":"response_item","payload":{"type":"function_call","name":"exec_command","call_id":"c{k4}","turn_id":"t{k3}","arguments":"{\"cmd\":\"ls\"}"}}',
        "purchase": r'{"type":"response_item","payload":{"type":"function_call_output","call_id":"c{k4}","output":"Exit code: {k3}\n{k} passed"}}',
        "error": '{"type":"event_msg","payload":{"type":"task_complete"}}|{"type":"response_item","payload":{"type":"custom_tool_call","name":"apply_patch","call_id":"c{k4}","input":"*** Update File: f{k5}.py"}}',
    },
    "linked": {
        "signup": '{"type":"user","uuid":"u{pos}","parentUuid":"u{before}","message":{"content":"m{k}"}}',
        "view": '{"type":"assistant","uuid":"u{pos}","parentUuid":"u{before}","timestamp":"{id}","message":{"content":[{"type":"text","text":"m{k}"},{"type":"tool_use","id":"c{k4}","name":"Read","input":{"file_path":"f{k5}.py"}}]}}',
        "click": '{"type":"assistant","uuid":"u{pos}","parentUuid":"none","message":{"content":[{"type":"tool_use","id":"c{k4}","name":"Bash","input":{"command":"pytest"}}]}}|{"type":"assistant","uuid":"u{pos}","parentUuid":"u{before}","message":{"content":[{"type":"tool_use","id":"c{k4}","name":"Edit","input":{"file_path":"f{k5}.py","old_string":"a","new_string":"b"}}]}}',
        "purchase": '{"type":"user","uuid":"u{pos}","parentUuid":"u{before}","toolUseResult":{"stdout":"{k} passed","exitCode":{k3}},"message":{"content":[{"type":"tool_result","tool_use_id":"c{k4}","content":"done"}]}}',
        "error": '{"type":"summary","uuid":"u{pos}"}',
    },
    "action": {
        "signup": '{"role":"user","content":"m{k}"}',
        "view": '{"role":"assistant","action":"open f{k5}.py"}',
        "click": '{"role":"assistant","tool_calls":[{"id":"c{k4}","function":{"name":"edit","arguments":{"search":"a","replace":"b"}}}]}',
        "purchase": '{"role":"tool","tool_call_ids":["c{k4}"],"content":"done {k}"}',
        "error": '{"role":"assistant","action":"pytest"}|{"role":"assistant","content":"words"}',
    },
    "editor": {
        "signup": '{"role":"user","content":"m{k}"}',
        "view": '{"role":"assistant","tool_calls":[{"id":"c{k4}","function":{"name":"str_replace_editor","arguments":{"command":"view","path":"f{k5}.py"}}}]}',
        "click": '{"role":"assistant","tool_calls":[{"id":"c{k4}","function":{"name":"str_replace_editor","arguments":{"command":"create","path":"f{k5}.py","file_text":"x"}}}]}|{"role":"assistant","tool_calls":[{"id":"c{k4}","function":{"name":"str_replace_editor","arguments":{"command":"str_replace","old_str":"a","new_str":""}}}]}',
        "purchase": '{"role":"tool","tool_call_id":"c{k4}","content":"done {k}"}',
        "error": '{"role":"assistant","tool_calls":[{"id":"e","function":{"name":"execute_bash","arguments":{"command":"pytest"}}}]}|{"role":"assistant","tool_calls":[{"id":"e","function":{"name":"think","arguments":{}}}]}',
    },
    "fenced": {
        "signup": r'{"role":"user","content":"<returncode>{k3}</returncode><output>\nm{k}\n</output>"}',
        "view": r'{"role":"assistant","content":"```bash\ncat f{k5}.py\n```"}',
        "click": r"""{"role":"assistant","content":"```\nsed -i 's/a/b/' f{k5}.py\n```"}""",
        "purchase": r'{"role":"assistant","content":"```sh\npython t.py\n```"}',
        "error": '{"role":"exit","content":"end"}|{"role":"assistant","content":"words"}',
    },
}
_WHOLE = {"action": ('{"history":[', "]}"), "editor": ('{"row":{"instance_id":"{user}","trajectory":[', "]}}"), "fenced": ('{"messages":[', "]}")}
COLUMNS = ("run_id", "step_index", "kind", "tool_name", "target", "parent_step", "exit_code", "test_text")


def _record(form: str) -> Column:
    """An event's record, its numbers put in."""
    said = F.lit(None).cast("string")
    for t, texts in RECORDS[form].items():
        even, _, odd = texts.partition("|")
        said = F.when((F.col("t") == t) & (F.lit(not odd) | (F.col("k") % 2 == 0)), even).when(F.col("t") == t, odd or even).otherwise(said)
    put = {"{id}": "event_id", "{pos}": "pos", "{before}": "before", "{k}": "k"}
    for name, c in put.items():
        said = F.replace(said, F.lit(name), F.col(c).cast("string"))
    for n in (3, 4, 5):
        said = F.replace(said, F.lit(f"{{k{n}}}"), (F.col("k") % n).cast("string"))
    return said


def recordings(spark: SparkSession, sf_dir: str, form: str, who: str = "true") -> DataFrame:
    """path, value: a file's text for each user for whom ``who`` holds."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("stridelog_events")
    rows = spark.sql(_ORDERED.replace("{events}", "stridelog_events")).where(who).withColumn("before", F.col("pos") - 1).select("user_id", "pos", _record(form).alias("r"))
    head, tail = _WHOLE.get(form, ("", ""))
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"]), "," if head else "\n")
    texts = rows.groupBy("user_id").agg(lines.alias("lines"))
    return texts.select(F.concat(F.lit("events/"), user, F.lit(".json")).alias("path"), F.concat(F.replace(F.lit(head), F.lit("{user}"), user), "lines", F.lit(tail)).alias("value"))


def read(form: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return files.read_texts(recordings(spark, sf_dir, form), form).select(*[f"activity.{c}" for c in COLUMNS])

    return query


def payloads(form: str):
    """Whole inputs and outputs of each activity, as canonical text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return files.read_texts(recordings(spark, sf_dir, form), form).select(*[f"activity.{c}" for c in ("run_id", "step_index", "inputs_json", "outputs_json")])

    return query


#: A mixed folder: the user's number modulo 8, the form, the file's folder and name around user-N, its end, and what follows the text. 5 has a bad line, 6 is no recording by its place, 7 is known by its look alone.
PLACES = [
    (0, "calls", "/home/u/.codex/", ".jsonl", ""), (1, "linked", "/home/u/.claude/", ".jsonl", ""), (2, "action", "/w/tests/fixtures/swe-agent-", ".json", ""), (3, "editor", "tests/fixtures/openhands-", ".json", ""),
    (4, "fenced", "/w/tests/fixtures/mini-swe-agent-", ".traj", ""), (5, "linked", "/data/", ".jsonl", "\n{oops"), (6, "action", "/data/", ".json", ""), (7, "calls", "/data/", ".jsonl", ""),
]


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, value: each user's file in one of the forms, where its tool would leave it."""
    parts = []
    for n, form, before, end, after in PLACES:
        own = recordings(spark, sf_dir, form, f"user_id % 8 = {n}")
        parts.append(own.select(F.concat(F.lit(before), F.regexp_extract("path", "(user-[0-9]+)", 1), F.lit(end)).alias("path"), F.concat("value", F.lit(after)).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def read_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_mixed(mixed_files(spark, sf_dir)).select("path", "place", "error", *[f"activity.{c}" for c in COLUMNS])


def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_errors(files.read_mixed(mixed_files(spark, sf_dir)))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat histories; texts come back as lengths and hashes."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    texts = rows.groupBy("conv_id").agg(F.to_json(F.struct(history.alias("history"))).alias("value")).select(F.concat(F.lit("x/conv-"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), "value")
    made = files.read_texts(texts, "chat").select("activity.*")
    said = F.when(F.col("kind") == "llm_call", F.col("outputs_json")).otherwise(F.col("inputs_json"))
    return made.select("run_id", "step_index", "kind", "parent_step", F.get_json_object(said, "$.content_length").cast("bigint").alias("content_length"), F.get_json_object(said, "$.content_hash").alias("content_hash"))


#: What befalls a user's journal, by the user's number: a changed record, a lost one, a line that is no JSON, one that is no record (after a blank line), a lost end, which none can see.
_HARM = """CASE WHEN u = 1 AND pos = 1 THEN replace(value, '"ts":"', '"ts":"x') WHEN u = 2 AND pos = 1 THEN NULL WHEN u = 3 AND pos = 2 THEN '{oops' WHEN u = 4 AND pos = 1 THEN concat('\n', replace(value, '"record_hash"', '"seal"')) WHEN u = 5 AND pos = last THEN NULL ELSE value END"""
_STEPS = ("pos", "step_index", "kind", "tool_name", "target", "parent_step", "inputs_json", "outputs_json", "content_hash", "file_path", "command", "exit_code", "test_text")


def journal_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of journals, one of each user, some of them harmed."""
    lines = files.journal_lines(journal.events_journal(spark, sf_dir)).withColumn("u", F.regexp_extract("run_id", "([0-9]+)$", 1).cast("bigint") % 6).withColumn("last", F.max("pos").over(Window.partitionBy("run_id")))
    folder = new_folder(spark)
    lines.withColumn("value", F.expr(_HARM)).where("value IS NOT NULL").repartition("run_id").sortWithinPartitions("run_id", "pos").select("run_id", "value").write.partitionBy("run_id").text(folder)
    return folder


def read_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of journals that hold, and why the others do not."""
    found = journals.read_journals(spark, journal_files(spark, sf_dir), strict=False)
    return found.select(F.regexp_extract("path", "run_id=([^/]+)/", 1).alias("run_id"), "error", *[F.col(f"activity.{c}").alias(c) for c in _STEPS], "record_hash")


JOURNAL_SQL = o.with_(
    f"""SELECT run_id, NULL AS error, {", ".join(f"n.{c}" for c in _STEPS)}, record_hash FROM n WHERE u IN (0, 5) AND (u <> 5 OR pos <> last)
 UNION ALL SELECT run_id, CASE u WHEN 1 THEN 'record_hash mismatch at record 1' WHEN 2 THEN 'prev_hash mismatch at record 1' WHEN 3 THEN 'line 3: invalid JSON' ELSE 'line 3: not a journal record' END, {", ".join("NULL" for _ in _STEPS)}, NULL FROM n WHERE u IN (1, 2, 3, 4) AND pos = 0""",
    j=o.J, c=o.CANON, k=o.CHAIN, n="SELECT c.* REPLACE (coalesce(test_text, '') AS test_text), k.content_hash, k.record_hash, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS BIGINT) % 6 AS u, max(pos) OVER (PARTITION BY run_id) AS last FROM c JOIN k USING (run_id, pos)",
)

def label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a set of labelled files: some say their own number, some are listed twice, by a longer and a shorter path, or not at all."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    n = F.col("conv_id")
    step = F.when(n % 7 == 0, F.concat(F.lit("x"), n.cast("string"))).otherwise((n % 9).cast("string"))
    texts = rows.groupBy("conv_id").agg(history.alias("history")).select(n, F.to_json(F.struct(F.when((n % 3 == 0) | (n % 20 == 0), n + 1000).alias("row_idx"), F.struct("history", step.alias("mistake_step")).alias("row"))).alias("value"))
    name = F.concat(F.lit("conv-"), n.cast("string"), F.lit(".json"))
    listed = texts.select("conv_id", F.explode(F.filter(F.array(F.when(n % 4 != 0, F.struct(F.concat(F.lit("set/"), name).alias("p"), F.lit("long").alias("c"))), F.when(n % 5 != 0, F.struct(name.alias("p"), F.lit("short").alias("c")))), lambda x: x.isNotNull())).alias("l"))
    manifest = listed.select(F.col("l.p").alias("local_path"), F.col("l.c").alias("config"), n.alias("row_idx"))
    return labels.label_set(texts.select(F.concat(F.lit("/any/set/"), name).alias("path"), "value"), manifest)[1]


LABELS_SQL = """SELECT *, config || ':' || row_idx AS run_id, CASE WHEN exclusion IS NULL THEN n % 9 END::INT AS expected_step FROM (
 SELECT conv_id AS n, CASE WHEN conv_id % 4 <> 0 THEN 'long' WHEN conv_id % 5 <> 0 THEN 'short' ELSE '' END AS config, CASE WHEN conv_id % 3 = 0 OR conv_id % 20 = 0 THEN conv_id + 1000 ELSE conv_id END AS row_idx,
  CASE WHEN conv_id % 4 <> 0 OR conv_id % 5 <> 0 THEN 1 ELSE 0 END::BIGINT AS claims, CASE WHEN conv_id % 7 = 0 THEN 'step not a number' WHEN conv_id % 9 >= count(*) THEN 'step out of range' END AS exclusion FROM conversations GROUP BY conv_id)"""
LABELS_SQL = f"SELECT config, row_idx, run_id, claims, expected_step, exclusion FROM ({LABELS_SQL})"

_E = "e AS (" + _ORDERED.replace("{events}", "events") + ")"
_IN, _BEFORE = "OVER (PARTITION BY user_id ORDER BY pos)", "OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CALL = "OVER (PARTITION BY user_id, k % 4 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

_CALLS = f"""WITH {_E}, o AS (SELECT *, t = 'click' OR (t = 'error' AND k % 2 = 1) AS opens, t IN ('signup', 'click') AS turned FROM e),
m AS (SELECT *, NOT (t = 'purchase' AND coalesce(bool_or(opens) {_CALL}, false)) AS made FROM o),
s AS (SELECT *, CAST(count(*) FILTER (made) {_IN} - 1 AS INT) AS step FROM m),
c AS (SELECT *, last_value(CASE WHEN opens THEN step END IGNORE NULLS) {_CALL} AS call FROM s), d AS (SELECT *, CASE WHEN made THEN step ELSE call END AS touched FROM c),
p AS (SELECT *, CASE WHEN turned THEN lag(touched) OVER (PARTITION BY user_id, turned, k % 3 ORDER BY pos) END AS by_turn, lag(touched) {_IN} AS last FROM d),
a AS (SELECT user_id, call AS step, max_by(k % 3, pos) AS code, max_by(k, pos) AS n FROM d WHERE NOT made GROUP BY user_id, call)"""
CALLS_SQL = f"""{_CALLS}
SELECT 'codex-' || substr(sha256('user-' || p.user_id), 1, 16) AS run_id, p.step AS step_index,
 CASE t WHEN 'signup' THEN 'user_msg' WHEN 'view' THEN 'llm_call' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'test_run' ELSE 'opaque_shell' END WHEN 'purchase' THEN 'unmapped' ELSE CASE WHEN k % 2 = 0 THEN 'verdict' ELSE 'file_edit' END END AS kind,
 CASE t WHEN 'click' THEN 'PowerShell' WHEN 'purchase' THEN 'codex_unmapped' WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'task_complete' ELSE 'apply_patch' END END AS tool_name,
 CASE WHEN t = 'click' THEN 'shell' WHEN t = 'error' AND k % 2 = 1 THEN 'f' || k % 5 || '.py' END AS target, coalesce(by_turn, last) AS parent_step, a.code AS exit_code,
 CASE WHEN t = 'click' AND k % 2 = 0 AND n IS NOT NULL THEN n || ' passed' ELSE '' END AS test_text FROM p LEFT JOIN a ON a.user_id = p.user_id AND a.step = p.step WHERE made"""

_LINKED = f"""WITH {_E}, n AS (SELECT *, CASE t WHEN 'view' THEN 2 WHEN 'purchase' THEN 0 ELSE 1 END AS made, t IN ('view', 'click') AS opens FROM e),
s AS (SELECT *, CAST(sum(made) {_IN} - made AS INT) AS first FROM n),
c AS (SELECT *, last_value(CASE WHEN opens THEN first + made - 1 END IGNORE NULLS) {_CALL} AS call FROM s), u AS (SELECT *, CASE WHEN made > 0 THEN first ELSE call END AS own FROM c),
p AS (SELECT *, CASE WHEN t = 'error' OR (t = 'click' AND k % 2 = 0) THEN NULL ELSE lag(own) {_IN} END AS parent FROM u),
a AS (SELECT user_id, call AS step, max_by(k % 3, pos) AS code, max_by(k, pos) AS n FROM u WHERE t = 'purchase' AND call IS NOT NULL GROUP BY user_id, call),
r AS (SELECT user_id, first AS step, CASE t WHEN 'signup' THEN 'user_msg' WHEN 'view' THEN 'llm_call' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'test_run' ELSE 'file_edit' END ELSE 'opaque_shell' END AS kind, CASE WHEN t = 'click' THEN CASE WHEN k % 2 = 0 THEN 'Bash' ELSE 'Edit' END END AS tool_name,
  CASE WHEN t = 'click' THEN CASE WHEN k % 2 = 0 THEN 'shell' ELSE 'f' || k % 5 || '.py' END END AS target, parent, t, k FROM p WHERE made > 0
 UNION ALL SELECT user_id, first + 1, 'tool_call', 'Read', 'f' || k % 5 || '.py', parent, t, k FROM p WHERE made = 2)"""
LINKED_SQL = f"""{_LINKED}
SELECT 'user-' || r.user_id AS run_id, r.step AS step_index, kind, tool_name, target, parent AS parent_step, CASE WHEN kind = 'test_run' THEN code END AS exit_code, CASE WHEN kind = 'test_run' AND n IS NOT NULL THEN 'done' || chr(10) || n || ' passed' ELSE '' END AS test_text FROM r LEFT JOIN a ON a.user_id = r.user_id AND a.step = r.step"""


def _text(template: str) -> str:
    """SQL for a text in which «...» are expressions."""
    parts = re.split("[«»]", template)
    return " || ".join(f"({x})" if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x)


def _digest(template: str) -> str:
    return f"«sha256({_text(template)})»"


def _size(template: str) -> str:
    return f"«length({_text(template)})»"


_M = '"text_hash":"' + _digest("m«k»") + '","text_length":' + _size("m«k»")
#: What a record says of itself: its payload's keys, its types, its place.
_BASE = '"payload_keys":[{0}],"payload_type":"{1}","record_type":"{2}"{3},"source_index":«pos»'


def _base(keys: str, about: str, kind: str, more: str = "") -> str:
    return _BASE.format(",".join(f'"{x}"' for x in keys.split()), about, kind, more)


_CMD, _PATCH, _SAID = "«CASE WHEN k % 2 = 0 THEN 'pytest' ELSE 'ls' END»", "*** Update File: f«k % 5».py", r'"Exit code: «n % 3»\n«n» passed"'
_LOST = r'{"payload":{"call_id":"c«k % 4»","output":"Exit code: «k % 3»\n«k» passed","type":"function_call_output"},"type":"response_item"}'
_MESSAGE = '{"content_blocks":1,"content_types":[["output_text",1]],"image_count":0,'
_CALLS_SAY = {
    "signup": '{"image_count":0,"local_image_count":0,' + _base("message turn_id type", "user_message", "event_msg") + "," + _M + "}",
    "click": '{"argument_keys":["cmd"],"arguments_hash":"' + _digest('{"cmd":"' + _CMD + '"}') + '","arguments_kind":"dict","arguments_length":' + _size('{"cmd":"' + _CMD + '"}') + ',"call_id":"c«k % 4»","command":"' + _CMD + '","command_hash":"' + _digest(_CMD) + '","command_length":' + _size(_CMD) + "," + _base("arguments call_id name turn_id type", "function_call", "response_item") + "}",
    "purchase": _base("call_id output type", "function_call_output", "response_item").replace('"record_type"', '"reason":"unlinked_function_call_output","record_hash":"' + _digest(_LOST) + '","record_type"').join(("{", ',"top_level_keys":["payload","type"]}')),
    "error": '{"call_id":"c«k % 4»","file_path":"f«k % 5».py","new_string":"<patch-summary:' + _size(_PATCH) + ":«left(sha256(" + _text(_PATCH) + '), 12)»>","old_string":"<patch-before-unavailable:«left(sha256(' + _text(_PATCH) + '), 12)»>","patch_hash":"' + _digest(_PATCH) + '","patch_length":' + _size(_PATCH) + ',"patch_targets":["f«k % 5».py"],' + _base("call_id input name type", "custom_tool_call", "response_item") + "}",
}
_ANSWER = '{"call_id":"c«k % 4»","exit_code":«n % 3»,"output":{"hash":"' + _digest(_SAID) + '","keys":[],"kind":"str","length":' + _size(_SAID) + '},"payload_type":"function_call_output"«CASE WHEN t = \'click\' AND k % 2 = 0 THEN \',"result_text":"\' || n || \' passed"\' ELSE \'\' END»}'
_CALLS_SAY_SQL = " ".join(f"WHEN {'(t, k % 2) = (' + chr(39) + 'error' + chr(39) + ', 1)' if t == 'error' else f't = {chr(39)}{t}{chr(39)}'} THEN {_text(x)}" for t, x in _CALLS_SAY.items())
CALLS_PAYLOADS_SQL = f"""{_CALLS}, q AS (SELECT p.*, a.n FROM p LEFT JOIN a ON a.user_id = p.user_id AND a.step = p.step WHERE made)
SELECT 'codex-' || substr(sha256('user-' || user_id), 1, 16) AS run_id, step AS step_index, CASE {_CALLS_SAY_SQL} ELSE '{{}}' END AS inputs_json,
 CASE WHEN t = 'view' THEN {_text(_MESSAGE + _base("content role type", "message", "response_item", ',"role":"assistant"') + "," + _M + "}")} WHEN t = 'error' AND k % 2 = 0 THEN {_text("{" + _base("type", "task_complete", "event_msg") + "}")} WHEN n IS NOT NULL THEN {_text(_ANSWER)} ELSE '{{}}' END AS outputs_json FROM q"""

_TOP, _BLOCK = '{"exitCode":«n % 3»,"stdout":"«n» passed"}', '{"text_blocks":1,' + _M + "}"
_RESULT = '{«CASE WHEN kind = \'test_run\' THEN \'"exit_code":\' || n % 3 || \',"result_text":"done\\n\' || n || \' passed",\' ELSE \'\' END»"tool_result":{"content_hash":"' + _digest('"done"') + '","content_kind":"str","content_length":6,"is_error":false},"tool_use_result":{"keys":["exitCode","stdout"],"payload_hash":"' + _digest(_TOP) + '","payload_kind":"dict","payload_length":' + _size(_TOP) + "}}"
LINKED_PAYLOADS_SQL = f"""{_LINKED}
SELECT 'user-' || r.user_id AS run_id, r.step AS step_index,
 CASE kind WHEN 'user_msg' THEN {_text(_BLOCK)} WHEN 'tool_call' THEN {_text('{"file_path":"f«k % 5».py"}')} WHEN 'test_run' THEN '{{"command":"pytest"}}' WHEN 'file_edit' THEN {_text('{"file_path":"f«k % 5».py","new_string":"b","old_string":"a"}')} WHEN 'opaque_shell' THEN '{{"record_type":"summary","top_level_keys":["type","uuid"]}}' ELSE '{{}}' END AS inputs_json,
 CASE WHEN kind = 'llm_call' THEN {_text(_BLOCK)} WHEN n IS NOT NULL THEN {_text(_RESULT)} ELSE '{{}}' END AS outputs_json FROM r LEFT JOIN a ON a.user_id = r.user_id AND a.step = r.step"""


def _history_sql(acts: str, sees: str, kind: str, tool: str, target: str, said: str, ids: str | None, ends: bool = False, code: str = "CAST(NULL AS INT)", name: str = "'user-' || user_id", more: str = "") -> str:
    """``sees`` may refer to pending; ``ids``: rows whose call id later answers may name."""
    ended = "max(CASE WHEN {x} THEN pos END) " + _BEFORE
    waits = f"max(CASE WHEN {acts} THEN pos END) {_BEFORE}"
    pending = f"CASE WHEN {ended.format(x=sees.replace('pending IS NOT NULL', 'true'))} > {waits} THEN NULL ELSE {waits} END" if ends else waits
    to = f"coalesce(max(CASE WHEN {ids} THEN pos END) {_CALL}, pending)" if ids else "pending"
    by = f"CASE WHEN t = 'purchase' THEN {to} ELSE pending END" if ids else "pending"
    return f"""WITH {_E}, w AS (SELECT *, CAST({pending} AS INT) AS pending{more} FROM e), z AS (SELECT *, coalesce({sees}, false) AS seen FROM w), y AS (SELECT *, CAST(CASE WHEN seen THEN {by} END AS INT) AS called FROM z),
a AS (SELECT user_id, called AS pos, max_by({said}, pos) AS said, max_by({code}, pos) FILTER (({code}) IS NOT NULL) AS code FROM y WHERE called IS NOT NULL GROUP BY user_id, called)
SELECT {name.replace("user_id", "y.user_id")} AS run_id, y.pos AS step_index, {kind} AS kind, {tool} AS tool_name, {target} AS target, CASE WHEN seen THEN coalesce(called, pending) ELSE pending END AS parent_step,
 coalesce(a.code, CASE WHEN seen THEN {code} END) AS exit_code, coalesce(a.said, CASE WHEN seen THEN {said} END, '') AS test_text FROM y LEFT JOIN a ON a.user_id = y.user_id AND a.pos = y.pos"""


_FILE = "'f' || k % 5 || '.py'"
ACTION_SQL = _history_sql(
    acts="t IN ('view', 'click') OR (t = 'error' AND k % 2 = 0)", sees="t = 'purchase' OR (t = 'signup' AND pending IS NOT NULL)", ids="t = 'click'", said="CASE WHEN t = 'purchase' THEN 'done ' || k ELSE 'm' || k END",
    more=f", last_value(CASE WHEN t = 'view' THEN {_FILE} END IGNORE NULLS) {_BEFORE} AS open",
    kind="CASE WHEN seen THEN 'verdict' WHEN t = 'signup' THEN 'user_msg' WHEN t = 'view' THEN 'tool_call' WHEN t = 'click' THEN CASE WHEN open IS NULL THEN 'unmapped' ELSE 'file_edit' END WHEN k % 2 = 0 THEN 'test_run' ELSE 'llm_call' END",
    tool="CASE WHEN seen THEN 'swe_agent_observation' WHEN t = 'view' THEN 'open' WHEN t = 'click' THEN CASE WHEN open IS NULL THEN 'foreign_unmapped' ELSE 'Edit' END WHEN t = 'error' AND k % 2 = 0 THEN 'Bash' END",
    target=f"CASE WHEN t = 'view' THEN {_FILE} WHEN t = 'click' THEN open WHEN t = 'error' AND k % 2 = 0 THEN 'shell' END",
)
EDITOR_SQL = _history_sql(
    acts="t IN ('view', 'click') OR (t = 'error' AND k % 2 = 0)", sees="t = 'purchase'", ids="t IN ('view', 'click')", said="'done ' || k",
    kind="CASE t WHEN 'signup' THEN 'user_msg' WHEN 'view' THEN 'tool_call' WHEN 'purchase' THEN 'verdict' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'file_edit' ELSE 'unmapped' END ELSE CASE WHEN k % 2 = 0 THEN 'test_run' ELSE 'llm_call' END END",
    tool="CASE t WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'openhands_observation' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'Write' ELSE 'foreign_unmapped' END WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'Bash' ELSE 'think' END END",
    target=f"CASE WHEN t = 'view' OR (t = 'click' AND k % 2 = 0) THEN {_FILE} WHEN t = 'error' AND k % 2 = 0 THEN 'shell' END",
)
FENCED_SQL = _history_sql(
    acts="t IN ('view', 'click', 'purchase')", sees="(t = 'signup' AND pending IS NOT NULL) OR (t = 'error' AND k % 2 = 0)", ids=None, ends=True, said="CASE WHEN t = 'signup' THEN 'm' || k ELSE 'end' END", code="CASE WHEN t = 'signup' THEN k % 3 END",
    kind="CASE WHEN seen THEN 'verdict' WHEN t = 'signup' THEN 'user_msg' WHEN t = 'view' THEN 'opaque_shell' WHEN t = 'click' THEN 'file_edit' WHEN t = 'purchase' THEN 'test_run' ELSE 'llm_call' END",
    tool="CASE WHEN seen THEN CASE WHEN t = 'error' THEN 'mini_swe_agent_exit' ELSE 'mini_swe_agent_observation' END WHEN t IN ('view', 'purchase') THEN 'Bash' WHEN t = 'click' THEN 'Edit' END",
    target=f"CASE WHEN t IN ('view', 'purchase') THEN 'shell' WHEN t = 'click' THEN {_FILE} END",
)
CHAT_SQL = """SELECT 'conv-' || conv_id AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS step_index, CASE WHEN role = 'user' THEN 'user_msg' WHEN role = 'assistant' THEN 'unmapped' ELSE 'llm_call' END AS kind,
 CAST(CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 2 END AS INT) AS parent_step, coalesce(length(text), 0) AS content_length, coalesce(sha256(text), '') AS content_hash FROM conversations"""

_PLACED = {0: ("codex", ""), 1: ("claude", ""), 2: ("foreign-swe-agent", "swe-agent-"), 3: ("foreign-openhands", ""), 4: ("foreign-mini-swe-agent", "mini-swe-agent-"), 7: ("journal", "")}
_BY_FORM = {"calls": CALLS_SQL.replace("SELECT 'codex-' ||", "SELECT p.user_id, 'codex-' ||"), "linked": LINKED_SQL.replace("SELECT 'user-' || r.", "SELECT r.user_id, 'user-' || r."), **{k: q.replace("SELECT 'user-' || y.user_id", "SELECT y.user_id, 'user-' || y.user_id") for k, q in {"action": ACTION_SQL, "editor": EDITOR_SQL, "fenced": FENCED_SQL}.items()}}
_REST = [c for c in COLUMNS if c != "run_id"]
MIXED_SQL = " UNION ALL ".join(
    f"SELECT '{before}user-' || user_id || '{end}' AS path, '{_PLACED[n][0]}' AS place, NULL AS error, '{_PLACED[n][1]}' || run_id AS run_id, {', '.join(_REST)} FROM ({_BY_FORM[form]}) WHERE user_id % 8 = {n}"
    for n, form, before, end, _ in PLACES if n in _PLACED
) + f" UNION ALL SELECT DISTINCT '/data/user-' || user_id || '.jsonl', 'journal', 'ValueError', NULL, {', '.join('NULL' for _ in _REST)} FROM events WHERE user_id % 8 = 5"
ERRORS_SQL = "SELECT 'ValueError' AS error, count(DISTINCT user_id) AS files FROM events WHERE user_id % 8 = 5 HAVING count(*) > 0"

QUERIES = {"read_calls_payloads": payloads("calls"), "read_linked_payloads": payloads("linked"), "read_mixed": read_mixed, "file_errors": file_errors} | {f"read_{form}": read(form) for form in RECORDS} | {"read_chat": chat, "read_journal": read_journal, "label_set": label_set}
SQL = {"read_calls_payloads": CALLS_PAYLOADS_SQL, "read_linked_payloads": LINKED_PAYLOADS_SQL, "read_mixed": MIXED_SQL, "file_errors": ERRORS_SQL, "read_calls": CALLS_SQL, "read_linked": LINKED_SQL, "read_action": ACTION_SQL, "read_editor": EDITOR_SQL, "read_fenced": FENCED_SQL, "read_chat": CHAT_SQL, "read_journal": JOURNAL_SQL, "label_set": LABELS_SQL}
