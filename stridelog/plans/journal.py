"""Activities derived from the driver's tables, which hold no transcripts.

``EVENTS`` and ``HISTORY`` are plain SQL that Spark and DuckDB read alike, so the
queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import complete

_COMMAND = """CASE k % 8 WHEN 0 THEN 'pytest repo/f1.py -q' WHEN 1 THEN 'cat repo/f2.py > repo/out.txt' WHEN 2 THEN 'cp repo/f0.py repo/f3.py'
 WHEN 3 THEN 'sed -i s/a/b/ repo/f4.py' WHEN 4 THEN 'cat repo/f1.py | grep x' WHEN 5 THEN 'make all' WHEN 6 THEN 'python repo/f0.py' ELSE 'rm -f repo/f2.py' END"""
_TEXT = """CASE k % 6 WHEN 0 THEN '3 passed in 0.04s' WHEN 1 THEN '2 failed, 1 passed' WHEN 2 THEN 'command completed'
 WHEN 3 THEN 'FAILED tests/x.py::t - AssertionError' WHEN 4 THEN 'test result: ok. 4 passed; 0 failed' ELSE '' END"""

_EVENTS = f"""
SELECT run_id, source, step AS pos, step AS step_index, ts, kind, tool_name,
 CASE WHEN kind IN ('tool_call', 'file_edit') THEN file_path WHEN kind IN ('test_run', 'opaque_shell') THEN 'shell' END AS target,
 CASE WHEN step = 0 OR event_id % 5 = 0 THEN NULL ELSE step - 1 END AS parent_step,
 CASE WHEN kind = 'file_edit' THEN '{{"file_path":' || coalesce('"' || file_path || '"', 'null') || ',"new_string":"' || new_string || '","old_string":"' || old_string || '","write_mode":' || CASE WHEN write_mode THEN 'true' ELSE 'false' END || '}}'
  WHEN kind = 'tool_call' THEN '{{"file_path":' || coalesce('"' || file_path || '"', 'null') || '}}'
  WHEN kind IN ('test_run', 'opaque_shell') THEN '{{"command":"' || command || '"}}' ELSE '{{}}' END AS inputs_json,
 CASE WHEN kind = 'test_run' THEN '{{"exit_code":' || coalesce(CAST(exit_code AS STRING), 'null') || ',"result_text":"' || test_text || '"}}' ELSE '{{}}' END AS outputs_json,
 CASE WHEN kind IN ('tool_call', 'file_edit') THEN file_path END AS file_path,
 CASE WHEN kind = 'file_edit' THEN old_string END AS old_string, CASE WHEN kind = 'file_edit' THEN new_string END AS new_string,
 CASE WHEN kind IN ('test_run', 'opaque_shell') THEN command END AS command, write_mode,
 CASE WHEN kind = 'test_run' THEN exit_code END AS exit_code, CASE WHEN kind = 'test_run' THEN test_text END AS test_text
FROM (SELECT <run> AS run_id, 'src' || CAST(user_id % 3 AS STRING) AS source, CAST(step AS INT) AS step, CAST(event_id AS STRING) AS ts, event_id,
  CASE event_type WHEN 'signup' THEN 'user_msg' WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'file_edit' WHEN 'purchase' THEN 'test_run' ELSE 'opaque_shell' END AS kind,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'Write' ELSE 'Edit' END WHEN 'purchase' THEN 'PowerShell' WHEN 'error' THEN 'Bash' END AS tool_name,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'repo/f' || CAST(k % 5 AS STRING) || '.py' END AS file_path,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'tok' || CAST(event_id % 7 AS STRING) END AS old_string,
  CASE WHEN k % 3 = 0 THEN 'tok' || CAST(k % 7 AS STRING) || ' tok' || CAST(event_id % 5 AS STRING) || ' end' ELSE 'tok' || CAST((event_id + 1) % 7 AS STRING) END AS new_string,
  event_type = 'click' AND k % 3 = 0 AS write_mode, {_COMMAND} AS command,
  CASE WHEN k % 10 = 0 THEN 1 WHEN k % 10 < 7 THEN 0 END AS exit_code, {_TEXT} AS test_text
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, row_number() OVER (PARTITION BY <key> ORDER BY ts, event_id) - 1 AS step FROM {{events}}) AS e) AS d
"""

EVENTS = _EVENTS.replace("<run>", "'user-' || CAST(user_id AS STRING)").replace("<key>", "user_id")
#: The same events as many short runs, of which most are clean: faults are injected into these.
SHORT = _EVENTS.replace("<run>", "'user-' || CAST(user_id AS STRING) || '-' || CAST(event_id % 20 AS STRING)").replace("<key>", "user_id, event_id % 20")

#: Chat histories: no speaker names here, so the role decides (human, user: message; terminal: not mapped; others: a call).
HISTORY = """
SELECT 'conv-' || CAST(conv_id AS STRING) AS run_id, 'history' AS source, CAST(turn AS INT) AS pos, CAST(turn AS INT) AS step_index, '' AS ts,
 CASE WHEN lower(trim(role)) IN ('human', 'user') THEN 'user_msg' WHEN lower(trim(role)) IN ('assistant', 'computer_terminal', '') THEN 'unmapped' ELSE 'llm_call' END AS kind,
 CAST(NULL AS STRING) AS tool_name, CAST(NULL AS STRING) AS target, CASE WHEN turn > 0 THEN CAST(turn AS INT) - 1 END AS parent_step,
 '{"role":"' || role || '"}' AS inputs_json, '{"length":' || CAST(length(text) AS STRING) || '}' AS outputs_json
FROM {conversations}
"""

#: As CTE text for an oracle: j is the events' journal, h the histories'.
J = EVENTS.replace("{events}", "events")
S = SHORT.replace("{events}", "events")
H = HISTORY.replace("{conversations}", "conversations")


def _read(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"stridelog_{name}")
    return complete(spark.sql(text.replace("{" + name + "}", f"stridelog_{name}")))


def events_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", EVENTS)


def short_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", SHORT)


def history_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations", HISTORY)
