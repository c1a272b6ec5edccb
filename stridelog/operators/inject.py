"""Seeded fault injection and how often localization finds the fault.

Eligible steps are ranked by a hash of seed, class, run and step: the sample is
reproducible anywhere and needs no generator's state. Every case is a copy of its
run under the case's own id, so all cases pass the same pipeline together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from . import gates, hashing
from .localize import localize

SEED = 260628
#: Fault class and the gate that must notice it.
EXPECTED = {"G1_TARGET": "G1", "G2_TARGET": "G2", "G3_TARGET": "G3", "CONTROL": None, "BENIGN": None}
CONFIDENCES = ("HIGH", "LOW", "NA", "ALL")
FAILING_TEXT = "1 failed in 0.01s"


def eligible(activities: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, step_index, fault_class: a row per step and class that it can take."""
    passed = results.where("status = 'PASS'").groupBy("run_id", "pos").agg(F.collect_set("gate").alias("passed"))
    rows = activities.join(passed, ["run_id", "pos"], "left")
    ok = lambda g: F.coalesce(F.array_contains("passed", g), F.lit(False))
    kind = F.col("kind")
    test = (kind == "test_run") & F.col("test_text").isNotNull() & ok("G3")
    classes = F.array_compact(
        F.array(
            F.when(kind.isin("file_edit", "test_run", "tool_call") & ok("G1"), "G1_TARGET"),
            F.when((F.col("tool_name") == "Edit") & (F.col("old_string") != "") & ok("G2"), "G2_TARGET"),
            F.when(test, "G3_TARGET"),
            F.when(kind == "llm_call", "CONTROL"),
            F.when(test, "BENIGN"),
        )
    )
    return rows.select("run_id", "source", "step_index", F.explode(classes).alias("fault_class"))


def _draw(seed: int):
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "fault_class", "run_id", F.col("step_index").cast("string")), 256)


def least(rows: DataFrame, group: str, draw: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, of which ``draw``, evenly spread hexadecimal digits, is the first key.

    Rows are counted by the draw's first digits, which map-side sums do; the digits at which a group's count passes k are its edge.
    Below the edge all rows stay, unsorted and where they are; only those that share the edge's digits, one of 65,536 parts, are ranked.
    ``group`` has few values: one edge each is broadcast. Null groups give no rows; a k below 1 none at all.
    """
    rows = materialize(rows.where(F.col(group).isNotNull()).withColumn("digits", F.substring(draw, 1, 4)))
    counts = rows.groupBy(group, "digits").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(group).orderBy("digits")) - F.col("n")
    edges = counts.withColumn("below", below).where(F.col("below") < k).groupBy(F.col(group).alias("edge_group")).agg(F.max(F.struct("digits", "below")).alias("edge"))
    placed = rows.join(F.broadcast(edges), F.col(group) == F.col("edge_group")).drop("edge_group")
    at_edge = placed.where(F.col("digits") == F.col("edge.digits"))
    ranked = at_edge.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k - F.col("edge.below"))
    return placed.where(F.col("digits") < F.col("edge.digits")).unionByName(ranked.drop("rank")).drop("digits", "edge")


def sample(candidates: DataFrame, per_class: int = 1000, max_per_run: int = 3, seed: int = SEED) -> DataFrame:
    """At most ``max_per_run`` cases of a class from a run (no cap if not positive), then ``per_class`` of a class."""
    rows = candidates.withColumn("draw", _draw(seed))
    order = [F.col("draw"), F.col("run_id"), F.col("step_index")]
    if max_per_run > 0:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("fault_class", "run_id").orderBy(*order))).where(F.col("nth") <= max_per_run)
    rows = least(rows, "fault_class", "draw", order, per_class)
    return rows.select(F.concat_ws("|", "fault_class", "run_id", F.col("step_index").cast("string")).alias("case_id"), "fault_class", "run_id", "source", "step_index")


def mutate(activities: DataFrame, cases: DataFrame, only_changed: bool = False) -> DataFrame:
    """Every case's run under the case's id, with its one step changed and hashed anew; or that step alone."""
    own = cases.select("case_id", "fault_class", F.col("run_id").alias("case_run"), F.col("step_index").alias("at"))
    rows = activities.join(own, F.col("run_id") == F.col("case_run"))
    here = F.col("step_index") == F.col("at")
    rows = rows.where(here) if only_changed else rows
    cls, kind, tool = F.col("fault_class"), F.col("kind"), F.col("tool_name")
    g1 = here & (cls == "G1_TARGET")
    path = (kind == "file_edit") | (tool == "Read")
    g3 = here & (cls == "G3_TARGET")
    benign = here & (cls == "BENIGN")
    stale = F.concat(F.lit("stale-"), F.substring(F.sha2(F.concat_ws("|", "case_id", F.coalesce("content_hash", F.lit(""))), 256), 1, 16))
    changed = {
        "file_path": F.when(g1 & path, None).otherwise(F.col("file_path")),
        "command": F.when(g1 & (kind == "test_run"), None).otherwise(F.col("command")),
        "pattern": F.when(g1 & ~path & (kind == "tool_call"), None).otherwise(F.col("pattern")),
        "old_string": F.when(here & (cls == "G2_TARGET"), stale).otherwise(F.col("old_string")),
        "exit_code": F.when(g3, 1).otherwise(F.col("exit_code")),
        "test_text": F.when(g3, FAILING_TEXT).when(benign, F.concat("test_text", F.lit(" in 9.99s"))).otherwise(F.col("test_text")),
        "outputs_json": F.when(here & (cls == "CONTROL"), F.concat(F.lit('{"control":"'), F.sha2("case_id", 256), F.lit('"}'))).when(g3 | benign, F.concat(F.lit('{"changed":"'), F.col("case_id"), F.lit('"}'))).otherwise(F.col("outputs_json")),
    }
    out = rows.withColumns(changed).withColumn("run_id", F.col("case_id")).select(*activities.columns)
    return hashing.with_content_hash(out)


def outcomes(cases: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, fault_class, expected, bucket: tp, na, fp, fn or clean.

    With an expected gate, its status at the changed step decides; otherwise any
    failing step of the case is a false positive.
    """
    expected = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.lit(v))])[F.col("fault_class")]
    rows = cases.withColumn("expected", expected)
    at = results.select(F.col("run_id").alias("case_id"), "step_index", F.col("gate").alias("expected"), "status")
    failed = results.where("status = 'FAIL'").select(F.col("run_id").alias("case_id")).distinct().withColumn("failed", F.lit(True))
    joined = rows.join(at, ["case_id", "step_index", "expected"], "left").join(failed, "case_id", "left")
    bad = F.col("failed").isNotNull()
    bucket = F.when(F.col("expected").isNull(), F.when(bad, "fp").otherwise("clean")).when(F.col("status") == "FAIL", "tp").when(F.col("status") == "NA", "na").when(bad, "fp").otherwise("fn")
    return joined.select("case_id", "fault_class", "run_id", "source", "step_index", "expected", bucket.alias("bucket"))


def confusion(found: DataFrame) -> DataFrame:
    """Per class: counts, precision, recall and false-positive rate; null where nothing divides."""
    counts = found.groupBy("fault_class").agg(F.count(F.lit(1)).alias("injected"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("tp", "na", "fp", "fn", "clean")])
    seen = F.col("tp") + F.col("fn") + F.col("na")
    return counts.select("*", (F.col("injected") - F.col("na")).alias("scored"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.when(seen > 0, F.col("tp") / F.col("injected")).alias("recall"), F.try_divide("fp", F.col("injected") - F.col("na")).alias("fpr"))


def predictions(localizations: DataFrame, cases: DataFrame, use_gate: bool = True) -> DataFrame:
    """What localization said of each case: exact, cascade, or the first break; and why it may not count.

    ``cases``: case_id, expected_step, expected_gate (null: any).
    """
    said = localizations.select(F.col("run_id").alias("case_id"), "breaking_step", "breaking_gate", "cascade", "confidence", "coverage")
    rows = cases.join(said, "case_id", "left")
    gate = (F.col("expected_gate").isNull() | (F.col("expected_gate") == F.col("breaking_gate"))) if use_gate else F.lit(True)
    exact = F.coalesce((F.col("breaking_step") == F.col("expected_step")) & gate, F.lit(False))
    within = F.coalesce(((F.col("breaking_step") == F.col("expected_step")) | F.array_contains("cascade", F.col("expected_step"))) & gate, F.lit(False))
    order = F.struct(F.when(exact, 0).when(within, 1).otherwise(2).alias("rank"), "breaking_step", "breaking_gate", "confidence", "coverage")
    best = rows.groupBy(*cases.columns).agg(F.min_by(F.struct("breaking_step", "breaking_gate", "confidence", "coverage"), order).alias("p"), F.max(exact).alias("exact"), F.max(within).alias("cascade"), F.count("breaking_step").cast("int").alias("prediction_count"))
    vague = F.lower("p.coverage").rlike("opaque|unmapped|unlinked|heuristic")
    why = F.when(F.col("p.breaking_step").isNull(), "no_prediction").when((F.col("p.confidence") == "LOW") | vague, F.col("p.coverage")).otherwise("")
    return best.select(*cases.columns, F.col("p.breaking_step").alias("predicted_step"), F.col("p.breaking_gate").alias("predicted_gate"), F.coalesce("p.confidence", F.lit("NA")).alias("confidence"), "exact", "cascade", "prediction_count", (why != "").alias("coverage_gap"), why.alias("gap_reason"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """By confidence (HIGH, LOW, NA, also where no case has it) and over all (ALL)."""
    counts = predicted.rollup("confidence").agg(F.grouping("confidence").alias("overall"), F.count(F.lit(1)).alias("cases"), F.count_if("exact").alias("exact"), F.count_if("cascade").alias("cascade"), F.count_if("coverage_gap").alias("coverage_gaps"))
    counts = counts.select(F.when(F.col("overall") == 1, "ALL").otherwise(F.col("confidence")).alias("c"), "cases", "exact", "cascade", "coverage_gaps")
    each = predicted.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CONFIDENCES))).alias("confidence"))
    out = each.join(counts, F.col("confidence") == F.col("c"), "left").drop("c").fillna(0)
    total = F.max(F.when(F.col("confidence") == "ALL", F.col("cases"))).over(Window.partitionBy(F.lit(1)))  # four rows
    return out.select("*", F.try_divide("exact", "cases").alias("exact_rate"), F.try_divide("cascade", "cases").alias("cascade_rate"), F.try_divide("cases", total).alias("share"), F.try_divide("coverage_gaps", "cases").alias("gap_rate"))


def judge(clean: DataFrame, cases: DataFrame) -> DataFrame:
    """Gate results under the cases' ids that a change can alter: all of the changed step's, and G2 of the same run's edits of its file. All others stand as they were.

    ``clean`` has no failing step, so a case fails where this says so and nowhere else.
    """
    own = cases.select("case_id", "fault_class", "run_id", F.col("step_index").alias("at"))
    touched = own.join(clean.select("run_id", F.col("step_index").alias("at"), F.when(F.col("kind") == "file_edit", F.col("file_path")).alias("touched")), ["run_id", "at"]).select("case_id", "touched", F.col("run_id").alias("case_run"), "at")
    edits = clean.where("kind = 'file_edit'").join(touched, (F.col("run_id") == F.col("case_run")) & (F.col("file_path") == F.col("touched")) & (F.col("step_index") != F.col("at")))
    others = edits.select(F.col("case_id").alias("run_id"), *[F.col(c) for c in clean.columns if c != "run_id"])
    steps = materialize(mutate(clean, cases, only_changed=True))
    results = gates.g1(steps).unionByName(gates.g3(steps)).unionByName(gates.g2(steps.unionByName(others)))
    return results


def localize_cases(clean: DataFrame, cases: DataFrame, results: DataFrame) -> DataFrame:
    """Localizations of the cases' runs. A case of one failing step is its own break; only the others need their run."""
    failing = materialize(gates.failures(results))
    many = failing.groupBy(F.col("run_id").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.min("step_index").alias("step"), F.min_by("gate", "step_index").alias("gate"))
    none = F.array().cast("array<int>")
    alone = many.where("n = 1").select(F.col("case_id").alias("run_id"), F.col("step").alias("breaking_step"), F.col("gate").alias("breaking_gate"), none.alias("cascade"), F.lit("HIGH").alias("confidence"), F.lit("structured path").alias("coverage"), none.alias("candidates"))
    chained = cases.join(many.where("n > 1").select("case_id"), "case_id", "left_semi")
    return alone.unionByName(localize(mutate(clean, chained), results.join(chained.select(F.col("case_id").alias("run_id")), "run_id", "left_semi")))


def run_injection(activities: DataFrame, per_class: int = 1000, max_per_run: int = 3, seed: int = SEED) -> dict[str, DataFrame]:
    """Clean runs only: cases, outcomes, confusion, predictions, accuracy. What a case changes is judged again, and its run is copied only where failures may cascade."""
    # each of these is read several times below
    results = materialize(gates.gate_results(activities))
    clean = hashing.with_content_hash(activities.join(gates.dirty_runs(results), "run_id", "left_anti"))
    cases = materialize(sample(eligible(clean, results), per_class, max_per_run, seed))
    again = materialize(judge(clean, cases))
    found = outcomes(cases, again)
    targets = found.where("expected IS NOT NULL").select("case_id", F.col("step_index").alias("expected_step"), F.col("expected").alias("expected_gate"))

    def predicted() -> DataFrame:
        return predictions(localize_cases(clean, cases, again), targets)

    return _Found({"cases": lambda: cases, "outcomes": lambda: found, "confusion": lambda: confusion(found), "predictions": predicted, "accuracy": lambda: accuracy(predicted())})


class _Found(dict):
    """Results by name; each is planned when it is asked for first."""

    def __init__(self, made: dict):
        super().__init__()
        self.made = made

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.made[name]()
        return self[name]


def selected_by_source(cases: DataFrame) -> DataFrame:
    return cases.groupBy("source").pivot("fault_class", list(EXPECTED)).count().fillna(0)
