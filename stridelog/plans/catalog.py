"""Registered queries of the run-analysis engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gates, graph, hashing, inject, labels, levels, localize, regexdiff, reports
from ..schema import KINDS
from ..scratch import materialize
from ..sources import files
from . import commands, journal, readings
from . import oracle as o

ACTIONS = "('tool_call','file_edit','test_run','opaque_shell','unmapped')"
QUERIES: dict = readings.QUERIES | {"shell_forms": commands.shell_forms}
SQL: dict[str, str] = readings.SQL | {"shell_forms": commands.SHELL_FORMS_SQL}


def query(sql: str | None = None, source=journal.events_journal):
    """Registers a function of the journal under its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(source(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def raw(sql: str | None = None):
    """Registers a function of the session and the tables' folder."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _gates(body: str, **more: str) -> str:
    return o.with_(body, j=o.J, **o.gates(), **more)


_J = {"j": o.J}


@query(o.with_("SELECT kind, count(*) AS n FROM j GROUP BY kind", False, **_J))
def kind_counts(j: DataFrame) -> DataFrame:
    return reports.kind_counts(j)


@query(o.with_(f"SELECT run_id, structured, actions, CASE WHEN actions > 0 THEN structured / actions END AS fraction FROM (SELECT run_id, count(*) FILTER (kind IN ('tool_call','file_edit','test_run')) AS structured, count(*) FILTER (kind IN {ACTIONS}) AS actions FROM j GROUP BY run_id)", False, **_J))
def structured_fraction(j: DataFrame) -> DataFrame:
    return reports.structured_fraction(j)


@query(_gates("SELECT gate, status, count(*) AS n FROM r GROUP BY gate, status"))
def gate_tallies(j: DataFrame) -> DataFrame:
    return reports.gate_tallies(gates.gate_results(j))


@query(o.with_(o.g1(), False, **_J))
def g1_status(j: DataFrame) -> DataFrame:
    return gates.g1(j)


@query(o.with_(o.g2(), j=o.J, f=o.g2_fold()))
def g2_status(j: DataFrame) -> DataFrame:
    return gates.g2(j)


@query(o.with_(o.g3(), False, **_J))
def g3_status(j: DataFrame) -> DataFrame:
    return gates.g3(j)


@query(_gates("SELECT j.run_id, j.pos, j.step_index, kind, coalesce(tool_name, '') AS tool_name, coalesce(target, '') AS target, parent_step, max(status) FILTER (gate = 'G1') AS G1, max(status) FILTER (gate = 'G2') AS G2, max(status) FILTER (gate = 'G3') AS G3 FROM j JOIN r USING (run_id, pos) GROUP BY ALL"))
def show_timeline(j: DataFrame) -> DataFrame:
    return reports.timeline(j, gates.gate_results(j))


@query(o.with_("SELECT run_id, pos, sha256(canonical) AS content_hash FROM c", False, **_J, c=o.CANON))
def content_hash(j: DataFrame) -> DataFrame:
    return hashing.with_content_hash(j).select("run_id", "pos", "content_hash")


@query(o.with_("SELECT * FROM k", **_J, c=o.CANON, k=o.CHAIN))
def chain_hash(j: DataFrame) -> DataFrame:
    return hashing.chain(j)


_TAMPERED = "SELECT run_id, 5 AS bad_pos, 'record_hash mismatch' AS reason FROM j WHERE pos = 5"


@query(o.with_(_TAMPERED, False, **_J))
def chain_verify_tampered(j: DataFrame) -> DataFrame:
    """Records stand, but step 5 of each run says something else now."""
    forged = j.withColumn("outputs_json", F.when(F.col("pos") == 5, '{"forged":true}').otherwise(F.col("outputs_json")))
    return hashing.verify(forged, hashing.chain(j))


@query(o.with_("SELECT run_id, max_by(record_hash, pos) AS tail_hash FROM k GROUP BY run_id", **_J, c=o.CANON, k=o.CHAIN))
def tail_hash(j: DataFrame) -> DataFrame:
    return hashing.tail_hash(hashing.chain(j))


@query(o.with_("SELECT run_id, substr(sha256(concat_ws(':', any_value(source), run_id, CAST(count(*) AS VARCHAR), min_by(sha256(canonical), pos))), 1, 16) AS run_key FROM c GROUP BY run_id", False, **_J, c=o.CANON))
def run_key(j: DataFrame) -> DataFrame:
    return hashing.run_key(j)


@query(o.with_("SELECT a.run_id, a.parent_step AS src, a.step_index AS dst FROM j a JOIN j b ON a.run_id = b.run_id AND a.parent_step = b.step_index", False, **_J))
def parent_edges(j: DataFrame) -> DataFrame:
    return graph.parent_edges(j)


@query(o.with_("SELECT run_id, src, dst, base FROM e", **_J, **o.GRAPH))
def graph_edges(j: DataFrame) -> DataFrame:
    return graph.edges(j)


@query(o.with_("SELECT run_id, src, dst FROM e WHERE NOT base", **_J, **o.GRAPH))
def heuristic_edges(j: DataFrame) -> DataFrame:
    return graph.edges(j).where("NOT base").select("run_id", "src", "dst")


@query(o.with_("SELECT r.run_id, dst AS step_index, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources FROM e r GROUP BY r.run_id, dst", **_J, **o.GRAPH))
def reverse_graph(j: DataFrame) -> DataFrame:
    return graph.edges(j).groupBy("run_id", F.col("dst").alias("step_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ",").alias("sources"))


@query(o.with_("SELECT run_id, count(*) FILTER (kind IN ('opaque_shell','test_run') AND command IS NOT NULL) AS shell_command_steps, count(said) FILTER (kind IN ('opaque_shell','test_run')) AS steps_with_targets, coalesce(any_value(n), 0) AS added_edges FROM j LEFT JOIN t ON command = said LEFT JOIN (SELECT run_id, count(*) AS n FROM e WHERE NOT base GROUP BY run_id) USING (run_id) GROUP BY run_id", **_J, **o.GRAPH))
def shell_coverage(j: DataFrame) -> DataFrame:
    return graph.shell_coverage(j)


@query(_gates("SELECT run_id, step_index, breaking_step FROM b", **o.GRAPH, **o.BROKEN))
def upstream_breaks(j: DataFrame) -> DataFrame:
    return localize.breaks(j, materialize(gates.gate_results(j))).select("run_id", "step_index", "breaking_step")


@query(_gates("SELECT b.run_id, breaking_step, any_value(fl.gate) AS breaking_gate, list(b.step_index ORDER BY b.step_index) FILTER (b.step_index <> breaking_step) AS c FROM b JOIN fl ON fl.run_id = b.run_id AND fl.step_index = b.breaking_step GROUP BY b.run_id, breaking_step", **o.GRAPH, **o.BROKEN).replace("list(b.step_index ORDER BY b.step_index) FILTER (b.step_index <> breaking_step) AS c", "coalesce(string_agg(CAST(b.step_index AS VARCHAR), ',' ORDER BY b.step_index) FILTER (b.step_index <> breaking_step), '') AS cascade"))
def cascades(j: DataFrame) -> DataFrame:
    return localize.localize(j).select("run_id", "breaking_step", "breaking_gate", F.array_join(F.transform("cascade", lambda x: x.cast("string")), ",").alias("cascade"))


def _as_text(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.withColumns({"cascade": text("cascade"), "candidates": text("candidates")})


_WHERE = "SELECT run_id, breaking_step, breaking_gate, cascade, confidence, coverage, candidates FROM w"


@query(_gates(_WHERE, **o.GRAPH, **o.BROKEN, **o.PATHS))
def localizations(j: DataFrame) -> DataFrame:
    return _as_text(localize.localize(j))


@query(o.with_(_WHERE, j=o.S, **o.gates(), **o.GRAPH, **o.BROKEN, **o.PATHS), journal.short_journal)
def localizations_by_levels(j: DataFrame) -> DataFrame:
    """By joins alone, as runs are whose links lead backward."""
    return _as_text(levels.localize(materialize(localize.step_rows(j))))


@query(_gates("SELECT r.run_id, r.step_index, r.gate, evidence, breaking_step FROM r LEFT JOIN b USING (run_id, step_index) WHERE status = 'FAIL' AND r.gate <> 'G1'", **o.GRAPH, **o.BROKEN))
def scan_failures(j: DataFrame) -> DataFrame:
    results = materialize(gates.gate_results(j))
    return reports.scan(results, localize.localize(j, results)).select("run_id", "step_index", "gate", "evidence", "breaking_step")


_GATES_OF = ", ".join(f"coalesce(sum({g}), 0)::BIGINT AS {g}_steps" for g in ("g1", "g2", "g3"))


@query(_gates(f"""SELECT coalesce(j.source, 'ALL') AS source, count(*) AS runs, count(*) FILTER (conf IS NULL) AS no_break_runs, count(*) FILTER (conf = 'HIGH') AS high_runs, count(*) FILTER (conf = 'LOW') AS low_runs,
 sum(n)::BIGINT AS activities, sum(actions)::BIGINT AS actions, sum(linked)::BIGINT AS linked_actions, sum(opaque)::BIGINT AS opaque, {_GATES_OF}, coalesce(sum(failing), 0)::BIGINT AS failing_steps,
 sum(commands)::BIGINT AS shell_command_steps, sum(known)::BIGINT AS steps_with_targets, coalesce(sum(added), 0)::BIGINT AS added_edges, median(CASE WHEN actions > 0 THEN oa / actions END) AS median_opaque_rate
 FROM (SELECT run_id, any_value(source) AS source, count(*) AS n, count(*) FILTER (kind IN {ACTIONS}) AS actions, count(*) FILTER (kind IN {ACTIONS} AND parent_step IS NOT NULL) AS linked, count(*) FILTER (kind IN ('opaque_shell','unmapped')) AS opaque, count(*) FILTER (kind IN {ACTIONS} AND kind IN ('opaque_shell','unmapped')) AS oa,
  count(*) FILTER (kind IN ('opaque_shell','test_run') AND command IS NOT NULL) AS commands, count(said) FILTER (kind IN ('opaque_shell','test_run')) AS known FROM j LEFT JOIN t ON command = said GROUP BY run_id) j
 LEFT JOIN (SELECT run_id, count(DISTINCT step_index) AS failing, count(DISTINCT step_index) FILTER (gate = 'G1') AS g1, count(DISTINCT step_index) FILTER (gate = 'G2') AS g2, count(DISTINCT step_index) FILTER (gate = 'G3') AS g3 FROM r WHERE status = 'FAIL' GROUP BY run_id) g USING (run_id)
 LEFT JOIN (SELECT run_id, max(confidence) AS conf FROM w GROUP BY run_id) c USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS added FROM e WHERE NOT base GROUP BY run_id) x USING (run_id) GROUP BY ROLLUP (j.source)""", **o.GRAPH, **o.BROKEN, **o.PATHS))
def study_by_source(j: DataFrame) -> DataFrame:
    return reports.study(reports.study_runs(j))


@query(_gates(f"""SELECT coalesce(source, 'ALL') AS source, count(*) AS runs, CAST(sum(n) AS BIGINT) AS activities, CAST(sum(actions) AS BIGINT) AS actions, CAST(sum(linked) AS BIGINT) AS linked_actions, CAST(sum(opaque) AS BIGINT) AS opaque, CAST(sum(failing) AS BIGINT) AS failing_steps, median(CASE WHEN actions > 0 THEN oa / actions END) AS median_opaque_rate
 FROM (SELECT j.run_id, any_value(source) AS source, count(*) AS n, count(*) FILTER (kind IN {ACTIONS}) AS actions, count(*) FILTER (kind IN {ACTIONS} AND parent_step IS NOT NULL) AS linked, count(*) FILTER (kind IN ('opaque_shell','unmapped')) AS opaque,
 count(*) FILTER (kind IN {ACTIONS} AND kind IN ('opaque_shell','unmapped')) AS oa, count(fl.gate) AS failing FROM j LEFT JOIN fl USING (run_id, step_index) GROUP BY j.run_id) GROUP BY ROLLUP (source)""", fl=o.FAILING))
def study_median(j: DataFrame) -> DataFrame:
    return reports.study(reports.study_runs(j)).select("source", "runs", "activities", "actions", "linked_actions", "opaque", "failing_steps", "median_opaque_rate")


_COUNTS = ", ".join(f"sum({c}) AS {c}" for c in ("g1_target", "g2_target", "g3_target", "control", "benign"))
_CENSUS = f"""SELECT coalesce(source, 'ALL') AS source, count(*) AS runs, CAST(sum(n) AS BIGINT) AS activities, count(*) FILTER (NOT dirty) AS clean_runs, {_COUNTS} FROM (SELECT run_id, any_value(source) AS source, count(*) AS n, run_id IN (SELECT run_id FROM r WHERE status = 'FAIL') AS dirty FROM j GROUP BY run_id)
 LEFT JOIN (SELECT run_id, {", ".join(f"count(*) FILTER (fault_class = '{c.upper()}') AS {c}" for c in ("g1_target", "g2_target", "g3_target", "control", "benign"))} FROM el GROUP BY run_id) USING (run_id) GROUP BY ROLLUP (source)"""
_CENSUS = _CENSUS.replace(_COUNTS, ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("g1_target", "g2_target", "g3_target", "control", "benign")))


@query(o.with_(_CENSUS, j=o.S, **o.gates(), el=o.ELIGIBLE), journal.short_journal)
def census(j: DataFrame) -> DataFrame:
    return reports.census(j, gates.gate_results(j))


@query(o.with_("SELECT DISTINCT run_id FROM j WHERE run_id NOT IN (SELECT run_id FROM r WHERE status = 'FAIL')", j=o.S, **o.gates()), journal.short_journal)
def clean_runs(j: DataFrame) -> DataFrame:
    return gates.clean_runs(j, gates.gate_results(j))


@query(o.with_("SELECT DISTINCT run_id FROM r WHERE status = 'FAIL'", j=o.S, **o.gates()), journal.short_journal)
def dirty_runs(j: DataFrame) -> DataFrame:
    return gates.dirty_runs(gates.gate_results(j))


@query(o.with_("SELECT run_id, step_index, fault_class FROM el", j=o.S, **o.gates(), el=o.ELIGIBLE), journal.short_journal)
def eligibility(j: DataFrame) -> DataFrame:
    return inject.eligible(j, gates.gate_results(j)).select("run_id", "step_index", "fault_class")


@query(o.with_("SELECT * FROM s", j=o.S, **o.gates(), el=o.ELIGIBLE, s=o.sample(40, 2)), journal.short_journal)
def sample_capped(j: DataFrame) -> DataFrame:
    return inject.sample(inject.eligible(j, gates.gate_results(j)), 40, 2)


@query(o.injected("SELECT case_id, fault_class, bucket FROM o"), journal.short_journal)
def injection_outcomes(j: DataFrame) -> DataFrame:
    return inject.run_injection(j)["outcomes"].select("case_id", "fault_class", "bucket")


@query(o.injected("""SELECT fault_class, injected, tp, na, fp, fn, clean, injected - na AS scored, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn + na > 0 THEN tp / injected END AS recall, CASE WHEN injected > na THEN fp / (injected - na) END AS fpr
 FROM (SELECT fault_class, count(*) AS injected, count(*) FILTER (bucket = 'tp') AS tp, count(*) FILTER (bucket = 'na') AS na, count(*) FILTER (bucket = 'fp') AS fp, count(*) FILTER (bucket = 'fn') AS fn, count(*) FILTER (bucket = 'clean') AS clean FROM o GROUP BY fault_class)"""), journal.short_journal)
def confusion(j: DataFrame) -> DataFrame:
    return inject.run_injection(j)["confusion"]


#: The cases' whole runs are located anew, by the same SQL as any journal.
_LOCATED = o.with_("SELECT * FROM w", j="SELECT * FROM m", r="SELECT * FROM r2", **o.GRAPH, **o.BROKEN, **o.PATHS)
_PREDICTED = f"""SELECT case_id, coalesce(any_value(p.confidence), 'NA') AS confidence, bool_or(p.exact) AS exact, bool_or(p.cascade) AS cascade, any_value(p.breaking_step IS NULL OR p.confidence = 'LOW') AS gap
 FROM (SELECT c.case_id, w.breaking_step, w.confidence, coalesce(w.breaking_step = c.step_index AND w.breaking_gate = c.expected, false) AS exact,
  coalesce((w.breaking_step = c.step_index OR list_contains(string_split(w.cascade, ','), CAST(c.step_index AS VARCHAR))) AND w.breaking_gate = c.expected, false) AS cascade,
  row_number() OVER (PARTITION BY c.case_id ORDER BY CASE WHEN w.breaking_step = c.step_index AND w.breaking_gate = c.expected THEN 0 WHEN w.breaking_gate = c.expected AND list_contains(string_split(w.cascade, ','), CAST(c.step_index AS VARCHAR)) THEN 1 ELSE 2 END, w.breaking_step, w.breaking_gate, w.confidence, w.coverage) AS n
  FROM o c LEFT JOIN ({_LOCATED}) w ON w.run_id = c.case_id WHERE c.expected IS NOT NULL) p WHERE n = 1 GROUP BY case_id"""
_RATE = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"


@query(o.injected(f"""SELECT confidence, cases, exact, cascade, coverage_gaps, {_RATE("exact", "cases")} AS exact_rate, {_RATE("cascade", "cases")} AS cascade_rate, {_RATE("cases", "total")} AS share, {_RATE("coverage_gaps", "cases")} AS gap_rate FROM (
 SELECT k.confidence, count(p.case_id) AS cases, count(*) FILTER (p.exact) AS exact, count(*) FILTER (p.cascade) AS cascade, count(*) FILTER (p.gap) AS coverage_gaps, (SELECT count(*) FROM o WHERE expected IS NOT NULL) AS total
 FROM (SELECT unnest(['HIGH', 'LOW', 'NA', 'ALL']) AS confidence) k LEFT JOIN ({_PREDICTED}) p ON k.confidence IN (p.confidence, 'ALL') GROUP BY k.confidence)"""), journal.short_journal)
def localization_accuracy(j: DataFrame) -> DataFrame:
    return inject.run_injection(j)["accuracy"]


@query(o.injected("SELECT source, " + ", ".join(f"count(*) FILTER (fault_class = '{c}') AS {c}" for c in inject.EXPECTED) + " FROM s GROUP BY source"), journal.short_journal)
def selected_by_source(j: DataFrame) -> DataFrame:
    return inject.selected_by_source(inject.run_injection(j)["cases"])


@query(_gates("SELECT run_id, " + ", ".join(f"count(*) FILTER (gate = '{g}' AND status = '{s}') AS {g.lower()}_{s.lower()}" for g in ("G1", "G2", "G3") for s in ("PASS", "FAIL", "NA")) + " FROM r GROUP BY run_id"))
def replay_tallies(j: DataFrame) -> DataFrame:
    results = materialize(gates.gate_results(j))
    out = reports.replay(j, results, localize.localize(j, results))
    return out.select("run_id", *[f"{g}_{s}".lower() for g in ("g1", "g2", "g3") for s in ("pass", "fail", "na")])


_BY_KIND = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS if k != "unmapped")
_COVER = f"SELECT coalesce(run_id, 'ALL') AS run_id, count(*) AS activities, count(*) FILTER (kind <> 'unmapped') AS mapped, count(*) FILTER (kind = 'unmapped') AS unmapped, count(*) FILTER (kind IN {ACTIONS}) AS actions, count(*) FILTER (kind IN {ACTIONS} AND parent_step IS NOT NULL) AS linked_actions, {_BY_KIND} FROM j GROUP BY ROLLUP (run_id)"


@query(o.with_(_COVER, False, **_J))
def coverage_report(j: DataFrame) -> DataFrame:
    return reports.coverage(j)


@query(SQL["shell_coverage"].replace("SELECT run_id, count(*) FILTER (kind IN ('opaque_shell','test_run') AND command", "SELECT coalesce(run_id, 'ALL') AS run_id, CAST(sum(shell_command_steps) AS BIGINT) AS shell_command_steps, CAST(sum(steps_with_targets) AS BIGINT) AS steps_with_targets, CAST(sum(added_edges) AS BIGINT) AS added_edges FROM (SELECT run_id, count(*) FILTER (kind IN ('opaque_shell','test_run') AND command", 1) + ") GROUP BY ROLLUP (run_id)")
def shell_lift(j: DataFrame) -> DataFrame:
    return reports.shell_lift(j)


@raw(f"WITH c AS ({readings.CALLS_SQL}) SELECT coalesce(run_id, 'ALL') AS run_id, 'function_call_output' AS type, count(*) AS n FROM c WHERE kind = 'unmapped' GROUP BY ROLLUP (run_id)")
def unmapped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unmapped_types(files.read_texts(readings.recordings(spark, sf_dir, "calls"), "calls").select("activity.*"))


@raw(f"""WITH {readings._E}, r AS (SELECT 'events/user-' || user_id || '.json' AS path, CASE t WHEN 'signup' THEN 'event_msg:user_message' WHEN 'view' THEN 'response_item:message' WHEN 'click' THEN 'response_item:function_call' WHEN 'purchase' THEN 'response_item:function_call_output'
 ELSE CASE WHEN k % 2 = 0 THEN 'event_msg:task_complete' ELSE 'response_item:custom_tool_call' END END AS family FROM e) SELECT coalesce(path, 'ALL') AS path, family, count(*) AS n FROM r GROUP BY GROUPING SETS ((family), (family, path))""")
def record_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readings.recordings(spark, sf_dir, "calls").select("path", F.explode(F.split("value", "\n")).alias("record"))
    return reports.record_families(lines)


#: Paths made up of an event's numbers.
_PATH = "CASE event_id % 7 WHEN 0 THEN '/home/u/.codex/s' WHEN 1 THEN 'C:\\\\u\\\\.Claude\\\\p' WHEN 2 THEN 'tests/fixtures/mini-swe-agent-' WHEN 3 THEN 'a/tests/fixtures/SWE_agent' WHEN 4 THEN 'a/tests/fixtures/openhands' WHEN 5 THEN 'tests/fixtures/plain' ELSE 'data/openhands' END || event_id || CASE event_id % 3 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.json' ELSE '.traj.json' END"
_CLASSES = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'foreign-mini-swe-agent' WHEN 3 THEN 'foreign-swe-agent' WHEN 4 THEN 'foreign-openhands' WHEN 5 THEN 'fixture' ELSE 'journal' END AS source,
 CASE event_id % 7 WHEN 2 THEN 'mini-swe-agent' WHEN 3 THEN 'swe-agent' WHEN 4 THEN 'openhands' WHEN 6 THEN 'openhands' END AS history, event_id % 3 = 0 OR event_id % 7 IN (2, 3, 4, 5) AS candidate FROM events"""


@raw(_CLASSES)
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(_PATH)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.source_of(path).alias("source"), text.history_of(path).alias("history"), text.is_candidate(path).alias("candidate"))


@query(o.with_(f"SELECT run_id, count(*) AS activities, count(*) FILTER (kind IN {ACTIONS} AND parent_step IS NULL AND step_index <> first) AS unlinked_actions FROM j JOIN (SELECT run_id, min(step_index) FILTER (kind IN {ACTIONS}) AS first FROM j GROUP BY run_id) USING (run_id) GROUP BY run_id", False, **_J))
def sweep_runs(j: DataFrame) -> DataFrame:
    return reports.sweep(j, localize.localize(j)).select("run_id", "activities", "unlinked_actions")


_H = {"j": o.H}


@query(o.with_("SELECT kind, count(*) AS n FROM j GROUP BY kind", False, **_H), journal.history_journal)
def history_kinds(j: DataFrame) -> DataFrame:
    return reports.kind_counts(j)


@query(o.with_("SELECT run_id, step_index, parent_step, kind FROM j", False, **_H), journal.history_journal)
def history_activities(j: DataFrame) -> DataFrame:
    return j.select("run_id", "step_index", "parent_step", "kind")


#: External labels made up from the table itself: some in range, some not, some no number.
_LABELS = "SELECT run_id, 'c' || CAST(n % 2 AS VARCHAR) AS config, CASE WHEN n % 7 = 0 THEN 'x' || CAST(n AS VARCHAR) ELSE CAST(n % 9 AS VARCHAR) END AS mistake_step FROM (SELECT DISTINCT run_id, CAST(substr(run_id, 6) AS BIGINT) AS n FROM j)"
_READ = "SELECT run_id AS case_id, config, CASE WHEN regexp_full_match(mistake_step, '[0-9]+') AND CAST(mistake_step AS INT) < length THEN CAST(mistake_step AS INT) END AS expected_step, CASE WHEN NOT regexp_full_match(mistake_step, '[0-9]+') THEN 'step not a number' WHEN CAST(mistake_step AS INT) >= length THEN 'step out of range' END AS exclusion FROM l JOIN (SELECT run_id, count(*) AS length FROM j GROUP BY run_id) USING (run_id)"


def _labels(j: DataFrame) -> DataFrame:
    n = F.expr("CAST(substr(run_id, 6) AS BIGINT)")
    rows = j.select("run_id").distinct().select("run_id", F.concat(F.lit("c"), (n % 2).cast("string")).alias("config"), F.when(n % 7 == 0, F.concat(F.lit("x"), n.cast("string"))).otherwise((n % 9).cast("string")).alias("mistake_step"))
    return labels.read_labels(rows, j)


_READ = _READ.replace("CAST(mistake_step AS INT)", "TRY_CAST(mistake_step AS INT)")


@query(o.with_(_READ, False, **_H, l=_LABELS), journal.history_journal)
def history_labels(j: DataFrame) -> DataFrame:
    return _labels(j).drop("expected_gate")


@query(_gates("SELECT case_id, config, expected_step, exclusion IS NULL AND coalesce(bool_or(b.breaking_step = expected_step), false) AS exact, exclusion IS NULL AND coalesce(bool_or(b.breaking_step = expected_step OR b.step_index = expected_step), false) AS cascade FROM x LEFT JOIN b ON b.run_id = case_id GROUP BY case_id, config, expected_step, exclusion", **o.GRAPH, **o.BROKEN, l=_LABELS, x=_READ))
def label_score(j: DataFrame) -> DataFrame:
    return labels.score(_labels(j), localize.localize(j)).select("case_id", "config", "expected_step", "exact", "cascade")


@query(_gates("SELECT coalesce(config, 'ALL') AS config, count(*) AS rows, count(*) FILTER (exclusion IS NULL) AS included, count(*) FILTER (exclusion IS NOT NULL) AS excluded FROM x GROUP BY ROLLUP (config)", l=_LABELS, x=_READ))
def label_score_by_config(j: DataFrame) -> DataFrame:
    return labels.score_by_config(labels.score(_labels(j), localize.localize(j))).select("config", "rows", "included", "excluded")


@query(o.with_("SELECT exclusion, count(*) AS n FROM x WHERE exclusion IS NOT NULL GROUP BY exclusion", False, **_H, l=_LABELS, x=_READ), journal.history_journal)
def label_exclusions(j: DataFrame) -> DataFrame:
    return labels.exclusions(_labels(j))


@raw("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.first_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source"), "source", "doc_id")


@raw("SELECT doc_id, length(text) AS length, sha256(text) AS text_hash FROM documents")
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length("text").cast("bigint").alias("length"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


#: Within what Java's and RE2's dialects share.
PATTERNS = [("p0", "[a-z]+"), ("p1", "[a-z ]+"), ("p2", "red|green|blue"), ("p3", "^[A-Za-z ]+$")]
_PAIRS = "SELECT pattern_id, pattern, CAST(p_partkey AS BIGINT) AS pos, p_name AS input, regexp_matches(p_name, pattern) AS search, regexp_full_match(p_name, pattern) AS full FROM part, (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PATTERNS) + ") AS v(pattern_id, pattern)"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("input"))
    return regexdiff.observations(spark.createDataFrame(PATTERNS, "pattern_id string, pattern string"), inputs, "native")


@raw(o.with_('SELECT pattern_id, pos, search, "full", search = "full" AS agree FROM v', False, v=_PAIRS.replace("AS full FROM", 'AS "full" FROM')))
def regex_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).select("pattern_id", "pos", "search", "full", "agree")


@raw(o.with_("""SELECT pattern_id, count(*) AS inputs, count(*) FILTER (search = "full") AS agreeing, min(pos) FILTER (search <> "full") AS first_divergence, CASE WHEN count(*) FILTER (search <> "full") > 0 THEN 'divergent' ELSE 'agree' END AS status FROM v GROUP BY pattern_id""", False, v=_PAIRS.replace("AS full FROM", 'AS "full" FROM')))
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regexdiff.summary(_observed(spark, sf_dir))


@query(o.with_("SELECT run_id, step_index, last_value(CASE WHEN kind = 'tool_call' THEN file_path END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_file FROM j", False, **_J))
def open_file(j: DataFrame) -> DataFrame:
    """The file opened last before each step."""
    w = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return j.select("run_id", "step_index", F.last(F.when(F.col("kind") == "tool_call", F.col("file_path")), ignorenulls=True).over(w).alias("open_file"))


@query(o.with_("SELECT run_id, step_index, coalesce(last_value(step_index) OVER (PARTITION BY run_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lag(step_index) OVER (PARTITION BY run_id ORDER BY pos)) AS parent FROM (SELECT *, CAST(ts AS BIGINT) % 4 AS turn FROM j)", False, **_J))
def turn_parent(j: DataFrame) -> DataFrame:
    """The last step of the same turn, else the run's last step."""
    rows = j.withColumn("turn", F.col("ts").cast("bigint") % 4)
    run, turn = Window.partitionBy("run_id").orderBy("pos"), Window.partitionBy("run_id", "turn").orderBy("pos")
    return rows.select("run_id", "step_index", F.coalesce(F.lag("step_index").over(turn), F.lag("step_index").over(run)).alias("parent"))


_CALLED = "SELECT run_id, step_index, CASE WHEN exit_code IS NULL THEN test_text ELSE 'Exit code: ' || exit_code || chr(10) || test_text END AS said FROM j WHERE kind = 'test_run'"
_CODE = "TRY_CAST(regexp_extract(said, '(?i)\\bExit code:\\s*(-?\\d+)\\b', 1) AS INT)"


def _called(j: DataFrame) -> DataFrame:
    return j.where("kind = 'test_run'").select("run_id", "step_index", F.when(F.col("exit_code").isNull(), F.col("test_text")).otherwise(F.concat(F.lit("Exit code: "), F.col("exit_code").cast("string"), F.lit("\n"), F.col("test_text"))).alias("said"))


@query(o.with_(f"SELECT run_id, step_index, {_CODE} AS exit_code FROM x", False, **_J, x=_CALLED))
def exit_text(j: DataFrame) -> DataFrame:
    return _called(j).select("run_id", "step_index", text.exit_code_of(F.col("said")).alias("exit_code"))


@query(o.with_(f"SELECT run_id, step_index, CASE WHEN regexp_matches(lower(said), '\\b\\d+\\s+passed\\b') THEN regexp_extract(lower(said), '\\b(\\d+)\\s+passed\\b', 1) || ' passed' WHEN regexp_matches(lower(said), '\\b\\d+\\s+(failed|failures|errors?)\\b') THEN regexp_extract(lower(said), '\\b(\\d+)\\s+(?:failed|failures|errors?)\\b', 1) || ' failed' WHEN coalesce({_CODE}, 0) <> 0 THEN '1 failed' ELSE '' END AS signal FROM x", False, **_J, x=_CALLED))
def test_signal(j: DataFrame) -> DataFrame:
    return _called(j).select("run_id", "step_index", text.test_signal(F.col("said"), text.exit_code_of(F.col("said"))).alias("signal"))


test_signal.__test__ = False
_PATCH = "SELECT run_id, step_index, '*** Begin' || chr(10) || '*** Update File: ' || coalesce(file_path, '') || chr(10) || old_string || chr(10) || '*** Move to: repo/' || step_index % 3 || '.py' AS patch FROM j WHERE kind = 'file_edit'"


@query(o.with_("SELECT run_id, step_index, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(patch, '(?m)^\\*\\*\\* (?:Add File|Update File|Delete File|Move to): ([^\\r\\n]*)', 1), lambda y: y <> ''))), ',') AS targets FROM x", False, **_J, x=_PATCH))
def patch_targets(j: DataFrame) -> DataFrame:
    patch = F.concat(F.lit("*** Begin\n*** Update File: "), F.coalesce("file_path", F.lit("")), F.lit("\n"), "old_string", F.lit("\n*** Move to: repo/"), (F.col("step_index") % 3).cast("string"), F.lit(".py"))
    return j.where("kind = 'file_edit'").select("run_id", "step_index", F.array_join(text.patch_targets(patch), ",").alias("targets"))


@query(_gates(f"SELECT source, count(*) AS steps, count(*) FILTER (kind IN {ACTIONS}) AS actions, count(*) FILTER (kind IN ('tool_call','file_edit','test_run')) AS structured, count(*) FILTER (kind = 'file_edit') AS edits, count(*) FILTER (r.status <> 'NA') AS judged_edits, count(*) FILTER (kind IN ('tool_call','file_edit','test_run')) / count(*) FILTER (kind IN {ACTIONS}) AS structured_fraction, count(*) FILTER (r.status <> 'NA') / count(*) FILTER (kind = 'file_edit') AS judged_fraction FROM j JOIN r ON r.run_id = j.run_id AND r.pos = j.pos AND r.gate = 'G2' GROUP BY source"))
def source_counts(j: DataFrame) -> DataFrame:
    return reports.source_counts(j, gates.gate_results(j))


@query(o.with_(f"SELECT source, count(*) AS runs, CAST(sum(activities) AS BIGINT) AS activities, CAST(sum(u) AS BIGINT) AS unlinked_actions FROM (SELECT run_id, any_value(source) AS source, count(*) AS activities, count(*) FILTER (kind IN {ACTIONS} AND parent_step IS NULL AND step_index <> first) AS u FROM j JOIN (SELECT run_id, min(step_index) FILTER (kind IN {ACTIONS}) AS first FROM j GROUP BY run_id) USING (run_id) GROUP BY run_id) GROUP BY source", False, **_J))
def sweep_by_source(j: DataFrame) -> DataFrame:
    runs = j.groupBy("run_id").agg(F.first("source").alias("source"))
    return reports.sweep_by(reports.sweep(j, localize.localize(j)), runs, "source").select("source", "runs", "activities", "unlinked_actions")


#: Where runs are from, made up from their numbers: some share an instance, some name none, some lack altogether.
_FROM = """SELECT run_id, CASE WHEN n % 5 = 0 THEN '' ELSE 'i' || CAST(n % 7 AS VARCHAR) END AS instance_id, 'r' || CAST(n % 3 AS VARCHAR) AS repo, CASE WHEN n % 4 <> 1 THEN 'c' || CAST(n % 2 AS VARCHAR) END AS "commit"
 FROM (SELECT DISTINCT run_id, CAST(substr(run_id, 6) AS BIGINT) AS n FROM j) WHERE n % 11 <> 0"""
_SWEPT = f"""SELECT run_id, coalesce(nullif(instance_id, ''), 'local:' || run_id) AS instance_id, coalesce(repo, '') AS repo, coalesce("commit", '') AS "commit", activities, actions, coalesce(failing, 0) AS failing_steps, coalesce(high, 0) AS high_steps, coalesce(low, 0) AS low_steps, coalesce(failing - high - low, 0) AS na_steps,
 opaque AS opaque_shell_actions, unmapped AS unmapped_actions, lone AS unlinked_actions, opaque + unmapped AS opaque_or_unmapped
 FROM (SELECT run_id, count(*) AS activities, count(*) FILTER (kind IN {ACTIONS}) AS actions, count(*) FILTER (kind = 'opaque_shell') AS opaque, count(*) FILTER (kind = 'unmapped') AS unmapped, count(*) FILTER (kind IN {ACTIONS} AND parent_step IS NULL AND step_index <> first) AS lone
  FROM j JOIN (SELECT run_id, min(step_index) FILTER (kind IN {ACTIONS}) AS first FROM j GROUP BY run_id) USING (run_id) GROUP BY run_id)
 LEFT JOIN (SELECT b.run_id, count(*) AS failing, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'LOW') AS low FROM b LEFT JOIN w ON w.run_id = b.run_id AND w.breaking_step = b.breaking_step GROUP BY b.run_id) USING (run_id) LEFT JOIN s USING (run_id)"""
_RATES = ", ".join(f"CASE WHEN sum({b}) > 0 THEN sum({a}) / sum({b}) END AS {name}" for name, a, b in reports.SHARES)
_TOTALS = "SELECT {keys}count(*) AS runs, count(DISTINCT instance_id) FILTER (NOT starts_with(instance_id, 'local:')) AS instances, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in reports.SWEPT) + f", {_RATES} FROM x{{by}}"
_SWEEP = {**o.GRAPH, **o.BROKEN, **o.PATHS, "s": _FROM, "x": _SWEPT}


def _swept(j: DataFrame) -> DataFrame:
    results, n = materialize(gates.gate_results(j)), F.expr("CAST(substr(run_id, 6) AS BIGINT)")
    sources = j.select("run_id").distinct().where(n % 11 != 0).select(
        "run_id", F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("i"), (n % 7).cast("string"))).alias("instance_id"), F.concat(F.lit("r"), (n % 3).cast("string")).alias("repo"), F.when(n % 4 != 1, F.concat(F.lit("c"), (n % 2).cast("string"))).alias("commit"),
    )
    return reports.sweep_runs(j, results, localize.localize(j, results), sources)


@query(_gates("SELECT * FROM x", **_SWEEP))
def sweep_by_run(j: DataFrame) -> DataFrame:
    return _swept(j)


@query(_gates(_TOTALS.format(keys="", by=""), **_SWEEP))
def sweep_report(j: DataFrame) -> DataFrame:
    return reports.sweep_totals(_swept(j))


@query(_gates(_TOTALS.format(keys="instance_id, ", by=" GROUP BY instance_id"), **_SWEEP))
def sweep_by_instance(j: DataFrame) -> DataFrame:
    return reports.sweep_totals(_swept(j), "instance_id")


@query(_gates(_TOTALS.format(keys='repo, "commit", ', by=' GROUP BY repo, "commit"'), **_SWEEP))
def sweep_by_commit(j: DataFrame) -> DataFrame:
    return reports.sweep_totals(_swept(j), "repo", "commit")
