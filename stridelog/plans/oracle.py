"""DuckDB SQL for the registered queries, written against table names only.

Every function returns SQL text over a CTE of activities; ``with_`` puts CTEs together.
"""

from __future__ import annotations

from ..operators.gates import FAIL_SIGNALS, NOISE, PASS_SIGNALS
from ..operators.inject import EXPECTED, FAILING_TEXT, SEED
from ..operators.levels import NOTES
from .journal import H, J, S


def with_(body: str, recursive: bool = True, **ctes: str) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " + body


def _missing(*names: str) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n} missing/not str' END" for n in names) + ")"


def g1(j: str = "j") -> str:
    return f"""SELECT run_id, pos, step_index, 'G1' AS gate,
 CASE WHEN kind NOT IN ('file_edit','tool_call','test_run','verdict') THEN 'NA' WHEN bad <> '' THEN 'FAIL' ELSE 'PASS' END AS status,
 CASE WHEN kind NOT IN ('file_edit','tool_call','test_run','verdict') THEN 'not a structured activity' WHEN bad <> '' THEN kind || ' malformed: ' || bad
  WHEN kind = 'verdict' THEN 'verdict activity schema ok' ELSE kind || ' schema ok' END AS evidence
 FROM (SELECT *, CASE kind WHEN 'file_edit' THEN {_missing("file_path", "old_string", "new_string")}
  WHEN 'tool_call' THEN CASE WHEN coalesce(tool_name, '') = '' THEN 'missing tool_name' WHEN tool_name = 'Read' THEN {_missing("file_path")} ELSE '' END
  WHEN 'test_run' THEN CASE WHEN coalesce(tool_name, '') NOT IN ('Bash', 'PowerShell') THEN 'tool_name must be Bash or PowerShell' ELSE {_missing("command")} END ELSE '' END AS bad FROM {j})"""


def g2_fold(j: str = "j") -> str:
    """Recursive: one row per edit with the content before and after it."""
    rows = f"(SELECT *, row_number() OVER (PARTITION BY run_id, file_path ORDER BY pos) AS n FROM {j} WHERE kind = 'file_edit' AND coalesce(file_path, '') <> '')"
    after = "CASE WHEN e.tool_name = 'Write' OR e.write_mode THEN coalesce(e.new_string, {s}) WHEN {s} IS NULL OR coalesce(e.old_string, '') = '' OR e.new_string IS NULL THEN {s} WHEN (length({s}) - length(replace({s}, e.old_string, ''))) // length(e.old_string) = 1 THEN replace({s}, e.old_string, e.new_string) ELSE {s} END"
    null = "CAST(NULL AS VARCHAR)"
    return f"""SELECT e.run_id, e.file_path, e.n, e.pos, e.step_index, e.tool_name, e.write_mode, e.old_string, e.new_string, {null} AS before, {after.format(s=null)} AS state FROM {rows} e WHERE e.n = 1
 UNION ALL SELECT e.run_id, e.file_path, e.n, e.pos, e.step_index, e.tool_name, e.write_mode, e.old_string, e.new_string, f.state, {after.format(s="f.state")} FROM f JOIN {rows} e ON e.run_id = f.run_id AND e.file_path = f.file_path AND e.n = f.n + 1"""


def g2(j: str = "j") -> str:
    times = "(length(before) - length(replace(before, old_string, ''))) // length(old_string)"
    write = "(tool_name = 'Write' OR write_mode)"
    return f"""SELECT run_id, pos, step_index, 'G2' AS gate,
 CASE WHEN {write} THEN CASE WHEN new_string IS NULL THEN 'FAIL' ELSE 'PASS' END WHEN before IS NULL THEN 'NA' WHEN old_string IS NULL OR new_string IS NULL OR old_string = '' THEN 'FAIL' WHEN {times} = 1 THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN {write} THEN CASE WHEN new_string IS NULL THEN 'write malformed: missing content' ELSE 'full-content anchor established' END WHEN before IS NULL THEN 'no full-content anchor' WHEN old_string IS NULL OR new_string IS NULL THEN 'edit 1 malformed'
  WHEN old_string = '' THEN 'edit 1 empty old_string' WHEN {times} = 0 THEN 'edit 1 old_string not found' WHEN {times} = 1 THEN 'old_string matched uniquely' ELSE 'edit 1 old_string ambiguous' END AS evidence FROM f
 UNION ALL SELECT run_id, pos, step_index, 'G2', CASE WHEN kind = 'file_edit' THEN 'FAIL' ELSE 'NA' END, CASE WHEN kind = 'file_edit' THEN 'file_edit malformed: missing file_path' ELSE 'not a file_edit' END FROM {j} WHERE kind <> 'file_edit' OR coalesce(file_path, '') = ''"""


def g3(j: str = "j") -> str:
    text = "coalesce(test_text, '')"
    for pattern, by in NOISE:
        text = f"regexp_replace({text}, '{pattern}', {chr(39) + by + chr(39) if by != chr(10) else 'chr(10)'}, 'g')"
    said = lambda p: f"regexp_matches(said, '(?m)(?:{'|'.join(p)})')"
    return f"""SELECT run_id, pos, step_index, 'G3' AS gate,
 CASE WHEN kind <> 'test_run' THEN 'NA' WHEN coalesce(exit_code, 0) <> 0 OR {said(FAIL_SIGNALS)} THEN 'FAIL' WHEN {said(PASS_SIGNALS)} THEN 'PASS' ELSE 'NA' END AS status,
 CASE WHEN kind <> 'test_run' THEN 'not a test_run' WHEN coalesce(exit_code, 0) <> 0 THEN 'non-zero exit code' WHEN {said(FAIL_SIGNALS)} THEN 'test failure signal' WHEN {said(PASS_SIGNALS)} THEN 'test pass signal' ELSE 'unparseable test output' END AS evidence
 FROM (SELECT *, lower(trim({text})) AS said FROM {j})"""


def gates(j: str = "j") -> dict[str, str]:
    return {"f": g2_fold(j), "r": f"{g1(j)} UNION ALL {g2(j)} UNION ALL {g3(j)}"}


#: What the journal's commands read and write.
TARGETS = """SELECT * FROM (VALUES ('pytest repo/f1.py -q', ['repo/f1.py'], CAST([] AS VARCHAR[])), ('cat repo/f2.py > repo/out.txt', ['repo/f2.py'], ['repo/out.txt']),
 ('cp repo/f0.py repo/f3.py', ['repo/f0.py'], ['repo/f3.py']), ('sed -i s/a/b/ repo/f4.py', ['repo/f4.py'], ['repo/f4.py']),
 ('python repo/f0.py', ['repo/f0.py'], []), ('rm -f repo/f2.py', [], ['repo/f2.py'])) AS t(said, reads, writes)"""
#: A structured step refers to its file; only edits produce it. A shell or test step refers to and produces what its command names.
REFS = """SELECT run_id, step_index, file_path AS file, kind = 'file_edit' AS produces, false AS by_shell FROM j WHERE file_path IS NOT NULL
 UNION ALL SELECT run_id, step_index, unnest(list_distinct(list_concat(reads, writes))), NULL, true FROM j JOIN t ON command = said WHERE kind IN ('opaque_shell', 'test_run')"""
EDGES = """SELECT run_id, src, dst, bool_or(base) AS base FROM (
 SELECT a.run_id, a.parent_step AS src, a.step_index AS dst, true AS base FROM j a JOIN j b ON a.run_id = b.run_id AND a.parent_step = b.step_index
 UNION ALL SELECT p.run_id, p.step_index, c.step_index, NOT p.by_shell AND NOT c.by_shell FROM refs2 p JOIN refs2 c ON p.run_id = c.run_id AND p.file = c.file AND p.step_index < c.step_index WHERE p.produces) GROUP BY ALL"""
EDGES = EDGES.replace(" GROUP BY ALL", " GROUP BY run_id, src, dst")
REFS2 = "SELECT r.run_id, r.step_index, r.file, CASE WHEN by_shell THEN list_contains(t.writes, r.file) ELSE r.produces END AS produces, by_shell FROM refs r JOIN j USING (run_id, step_index) LEFT JOIN t ON command = said"
GRAPH = {"t": TARGETS, "refs": REFS, "refs2": REFS2, "e": EDGES}
FAILING = "SELECT run_id, step_index, min(gate) AS gate FROM r WHERE status = 'FAIL' GROUP BY run_id, step_index"
UP = "SELECT run_id, step_index, step_index AS anc FROM fl UNION SELECT up.run_id, up.step_index, e.src FROM up JOIN e ON e.run_id = up.run_id AND e.dst = up.anc"
BREAKS = "SELECT up.run_id, up.step_index, min(anc) AS breaking_step FROM up JOIN fl ON fl.run_id = up.run_id AND fl.step_index = anc GROUP BY up.run_id, up.step_index"
BROKEN = {"fl": FAILING, "up": UP, "b": BREAKS}

#: Paths: every step below a failing one belongs to the smallest such; levels within its part; the smallest path of each level.
DOWN = "SELECT run_id, step_index AS anc, step_index AS node FROM fl UNION SELECT d.run_id, d.anc, e.dst FROM down d JOIN e ON e.run_id = d.run_id AND e.src = d.node"
PART = "SELECT run_id, node, min(anc) AS label FROM down GROUP BY run_id, node"
INNER = "SELECT e.run_id, e.src, e.dst, e.base, p.label FROM e JOIN part p ON p.run_id = e.run_id AND p.node = e.dst JOIN part q ON q.run_id = e.run_id AND q.node = e.src AND q.label = p.label"
WALKS = "SELECT run_id, node, 0 AS n FROM part WHERE node = label UNION SELECT i.run_id, i.dst, w.n + 1 FROM walks w JOIN inside i ON i.run_id = w.run_id AND i.src = w.node"
FAR = "SELECT run_id, node, min(n) AS n FROM walks GROUP BY run_id, node"
BEST = """SELECT run_id, node AS label, node, [node] AS path FROM part WHERE node = label
 UNION ALL SELECT run_id, label, node, min(path) FROM (SELECT i.run_id, i.label, i.dst AS node, list_append(b.path, i.dst) AS path FROM best b JOIN inside i ON i.run_id = b.run_id AND i.src = b.node JOIN far f ON f.run_id = i.run_id AND f.node = i.dst AND f.n = len(b.path)) GROUP BY run_id, label, node"""
CASC = "SELECT best.run_id, best.label, best.node, best.path FROM best JOIN fl ON fl.run_id = best.run_id AND fl.step_index = best.node WHERE best.node <> best.label"
ON = "SELECT DISTINCT c.run_id, c.label, j.step_index AS node, j.kind IN ('opaque_shell', 'unmapped') AS opaque, j.step_index <> c.label AND j.parent_step IS NULL AS unlinked, said IS NOT NULL AS targets FROM (SELECT run_id, label, unnest(path) AS node FROM casc) c JOIN j ON j.run_id = c.run_id AND j.step_index = c.node LEFT JOIN t ON j.command = t.said"
HOPS = "SELECT DISTINCT run_id, label, path[i] AS src, path[i + 1] AS dst FROM (SELECT run_id, label, path, unnest(generate_series(1, len(path) - 1)) AS i FROM casc)"
GUESS = "SELECT h.run_id, h.label, h.src, h.dst FROM hops h JOIN e USING (run_id, src, dst) WHERE NOT e.base"
NOTED = """SELECT run_id, label, sum(k)::BIGINT AS known, sum(p)::BIGINT AS plain, sum(u)::BIGINT AS unlinked, sum(g)::BIGINT AS guessed, string_agg(DISTINCT CAST(c AS VARCHAR), ',') AS seen, list_sort(list_distinct(list(c) FILTER (c IS NOT NULL))) AS candidates FROM (
 SELECT run_id, label, (opaque AND targets)::INT AS k, (opaque AND NOT targets)::INT AS p, unlinked::INT AS u, 0 AS g, CASE WHEN opaque OR unlinked THEN node END AS c FROM onpath
 UNION ALL SELECT run_id, label, 0, 0, 0, 1, NULL FROM guess
 UNION ALL SELECT g.run_id, g.label, 0, 0, 0, 0, j.step_index FROM guess g JOIN j ON j.run_id = g.run_id AND j.step_index IN (g.src, g.dst) JOIN t ON j.command = t.said) GROUP BY run_id, label"""
_NOTE = lambda n, noun: f"CASE WHEN {n} > 0 THEN {n} || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END END"
_COVER = "concat_ws('; ', " + ", ".join(_NOTE(n, noun) for n, noun in zip(("known", "plain", "unlinked", "guessed"), NOTES)) + ")"
WHERE = f"""SELECT b.run_id, b.breaking_step, fl.gate AS breaking_gate, coalesce(string_agg(CAST(b.step_index AS VARCHAR), ',' ORDER BY b.step_index) FILTER (b.step_index <> b.breaking_step), '') AS cascade,
 CASE WHEN any_value(known + plain + unlinked + guessed) > 0 THEN 'LOW' ELSE 'HIGH' END AS confidence, CASE WHEN any_value(known + plain + unlinked + guessed) > 0 THEN any_value({_COVER}) || ' on path' ELSE 'structured path' END AS coverage,
 coalesce(array_to_string(any_value(candidates), ','), '') AS candidates
 FROM b JOIN fl ON fl.run_id = b.run_id AND fl.step_index = b.breaking_step LEFT JOIN noted ON noted.run_id = b.run_id AND noted.label = b.breaking_step GROUP BY b.run_id, b.breaking_step, fl.gate"""
PATHS = {"down": DOWN, "part": PART, "inside": INNER, "walks": WALKS, "far": FAR, "best": BEST, "casc": CASC, "onpath": ON, "hops": HOPS, "guess": GUESS, "noted": NOTED, "w": WHERE}

#: The canonical payload of an activity of this journal.
CANON = """SELECT *, '{"inputs":' || inputs_json || ',"kind":"' || kind || '","outputs":' || outputs_json || ',"parent_step":' || coalesce(CAST(parent_step AS VARCHAR), 'null') || ',"run_id":"' || run_id || '","step_index":' || step_index
 || ',"target":' || coalesce('"' || target || '"', 'null') || ',"tool_name":' || coalesce('"' || tool_name || '"', 'null') || ',"ts":"' || ts || '"}' AS canonical FROM j"""
_SEAL = """sha256('{"activity":{"content_hash":"' || sha256(c.canonical) || '",' || substr(c.canonical, 2) || ',"prev_hash":"' || %s || '"}')"""
CHAIN = f"""SELECT c.run_id, c.pos, sha256(c.canonical) AS content_hash, repeat('0', 64) AS prev_hash, {_SEAL % "repeat('0', 64)"} AS record_hash FROM c WHERE c.pos = 0
 UNION ALL SELECT c.run_id, c.pos, sha256(c.canonical), k.record_hash, {_SEAL % "k.record_hash"} FROM k JOIN c ON c.run_id = k.run_id AND c.pos = k.pos + 1"""

ELIGIBLE = """SELECT run_id, source, step_index, unnest(list_filter([
  CASE WHEN kind IN ('file_edit','test_run','tool_call') AND p1 THEN 'G1_TARGET' END, CASE WHEN tool_name = 'Edit' AND old_string <> '' AND p2 THEN 'G2_TARGET' END,
  CASE WHEN kind = 'test_run' AND test_text IS NOT NULL AND p3 THEN 'G3_TARGET' END, CASE WHEN kind = 'llm_call' THEN 'CONTROL' END, CASE WHEN kind = 'test_run' AND test_text IS NOT NULL AND p3 THEN 'BENIGN' END], lambda x: x IS NOT NULL)) AS fault_class
 FROM (SELECT j.*, coalesce(p.p1, false) AS p1, coalesce(p.p2, false) AS p2, coalesce(p.p3, false) AS p3 FROM j LEFT JOIN (SELECT run_id, pos, bool_or(gate = 'G1') AS p1, bool_or(gate = 'G2') AS p2, bool_or(gate = 'G3') AS p3 FROM r WHERE status = 'PASS' GROUP BY run_id, pos) p USING (run_id, pos))"""


def sample(per_class: int, max_per_run: int) -> str:
    draw = f"sha256(concat_ws('|', '{SEED}', fault_class, run_id, CAST(step_index AS VARCHAR)))"
    return f"""SELECT concat_ws('|', fault_class, run_id, CAST(step_index AS VARCHAR)) AS case_id, fault_class, run_id, source, step_index FROM (SELECT *, row_number() OVER (PARTITION BY fault_class ORDER BY draw, run_id, step_index) AS m FROM (
 SELECT *, row_number() OVER (PARTITION BY fault_class, run_id ORDER BY draw, run_id, step_index) AS n FROM (SELECT *, {draw} AS draw FROM el)) WHERE n <= {max_per_run}) WHERE m <= {per_class}"""


CLEAN = "SELECT * FROM j WHERE run_id NOT IN (SELECT run_id FROM r WHERE status = 'FAIL')"
#: The cases' runs, each under its case's id, with one step changed. The stale marker's text does not matter to any gate.
MUTATED = f"""SELECT s.case_id AS run_id, c.pos, c.step_index, c.kind, c.tool_name, c.parent_step, c.write_mode, c.new_string, c.target,
 CASE WHEN here AND s.fault_class = 'G1_TARGET' AND (kind = 'file_edit' OR tool_name = 'Read') THEN NULL ELSE file_path END AS file_path,
 CASE WHEN here AND s.fault_class = 'G1_TARGET' AND kind = 'test_run' THEN NULL ELSE command END AS command,
 CASE WHEN here AND s.fault_class = 'G2_TARGET' THEN 'stale-0123456789' ELSE old_string END AS old_string,
 CASE WHEN here AND s.fault_class = 'G3_TARGET' THEN 1 ELSE exit_code END AS exit_code,
 CASE WHEN here AND s.fault_class = 'G3_TARGET' THEN '{FAILING_TEXT}' WHEN here AND s.fault_class = 'BENIGN' THEN test_text || ' in 9.99s' ELSE test_text END AS test_text
 FROM (SELECT s.*, c.pos AS p, c.step_index = s.step_index AS here FROM s JOIN cl c USING (run_id)) s JOIN cl c ON c.run_id = s.run_id AND c.pos = s.p"""
_EXP = "CASE fault_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPECTED.items() if v) + " END"
OUTCOMES = f"""SELECT x.case_id, x.fault_class, x.run_id, x.source, x.step_index, x.expected, CASE WHEN x.expected IS NULL THEN CASE WHEN bad THEN 'fp' ELSE 'clean' END WHEN g.status = 'FAIL' THEN 'tp' WHEN g.status = 'NA' THEN 'na' WHEN bad THEN 'fp' ELSE 'fn' END AS bucket
 FROM (SELECT *, {_EXP} AS expected, case_id IN (SELECT run_id FROM r2 WHERE status = 'FAIL') AS bad FROM s) x LEFT JOIN r2 g ON g.run_id = x.case_id AND g.step_index = x.step_index AND g.gate = x.expected"""


def injected(body: str) -> str:
    first = gates("j")
    again = {"f2": g2_fold("m").replace(" FROM f JOIN", " FROM f2 JOIN").replace("f.state", "f2.state").replace("f.run_id", "f2.run_id").replace("f.file_path", "f2.file_path").replace("= f.n", "= f2.n"), "r2": f"{g1('m')} UNION ALL {g2('m').replace(' FROM f', ' FROM f2', 1)} UNION ALL {g3('m')}"}
    return with_(body, j=S, **first, cl=CLEAN, el0=ELIGIBLE, el="SELECT * FROM el0 WHERE run_id IN (SELECT run_id FROM cl)", s=sample(1000, 3), m=MUTATED, **again, o=OUTCOMES)


__all__ = ["BROKEN", "PATHS", "CANON", "CHAIN", "ELIGIBLE", "GRAPH", "H", "J", "S", "gates", "injected", "sample", "with_"]
