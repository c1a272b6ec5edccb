"""Corpus-level aggregates over activities, gate results and localizations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACTION_KINDS, KINDS
from ..scratch import materialize
from . import gates, graph
from .localize import localize

STRUCTURED = ("tool_call", "file_edit", "test_run")
OPAQUE = ("opaque_shell", "unmapped")


def kind_counts(activities: DataFrame) -> DataFrame:
    return activities.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def structured_fraction(activities: DataFrame) -> DataFrame:
    """Share of action steps that are structured; null where a run has none."""
    action, structured = F.col("kind").isin(*ACTION_KINDS), F.col("kind").isin(*STRUCTURED)
    return activities.groupBy("run_id").agg(F.count_if(structured).alias("structured"), F.count_if(action).alias("actions")).withColumn("fraction", F.try_divide("structured", "actions"))


def gate_tallies(results: DataFrame) -> DataFrame:
    return results.groupBy("gate", "status").agg(F.count(F.lit(1)).alias("n"))


def timeline(activities: DataFrame, results: DataFrame) -> DataFrame:
    """The steps of each run with their three statuses."""
    flat = lambda c: F.translate(F.coalesce(c, F.lit("")), "\t\r\n", "   ")
    return activities.join(gates.status_matrix(results).drop("step_index"), ["run_id", "pos"], "left").select("run_id", "pos", "step_index", "kind", flat(F.col("tool_name")).alias("tool_name"), flat(F.col("target")).alias("target"), "parent_step", "G1", "G2", "G3")


def scan(results: DataFrame, localizations: DataFrame) -> DataFrame:
    """Failing G2 and G3 results with the break that explains them; G1 is not reported here."""
    where = localizations.select("run_id", "breaking_step", "confidence", F.explode(F.concat(F.array("breaking_step"), "cascade")).alias("step_index"))
    return results.where("status = 'FAIL' AND gate <> 'G1'").select("run_id", "step_index", "gate", "evidence").join(where, ["run_id", "step_index"], "left")


def study_runs(activities: DataFrame, results: DataFrame | None = None, localizations: DataFrame | None = None) -> DataFrame:
    """A row per run: sizes, linking, opacity, failing steps by gate, and its bucket."""
    results = materialize(gates.gate_results(activities)) if results is None else results
    localizations = localize(activities, results) if localizations is None else localizations
    action, opaque = F.col("kind").isin(*ACTION_KINDS), F.col("kind").isin(*OPAQUE)
    runs = activities.groupBy("run_id").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("activities"), F.count_if(action).alias("actions"),
        F.count_if(action & F.col("parent_step").isNotNull()).alias("linked_actions"), F.count_if(opaque).alias("opaque"), F.count_if(action & opaque).alias("opaque_actions"),
    )
    failed = results.where("status = 'FAIL'").groupBy("run_id").agg(*[F.countDistinct(F.when(F.col("gate") == g, F.col("step_index"))).alias(f"{g.lower()}_steps") for g in ("G1", "G2", "G3")], F.countDistinct("step_index").alias("failing_steps"))
    sure = localizations.groupBy("run_id").agg(F.when(F.bool_or(F.col("confidence") == "LOW"), "LOW").otherwise("HIGH").alias("bucket"), F.count(F.lit(1)).alias("breaks"))
    out = runs.join(failed, "run_id", "left").join(sure, "run_id", "left").join(graph.shell_coverage(activities), "run_id", "left")
    return out.fillna(0).fillna("no_break", ["bucket"]).withColumn("opaque_rate", F.try_divide("opaque_actions", "actions"))


def study(runs: DataFrame) -> DataFrame:
    """Per source and overall (source ALL), with the exact median of runs' opaque rates."""
    sums = ["activities", "actions", "linked_actions", "opaque", "g1_steps", "g2_steps", "g3_steps", "failing_steps", "shell_command_steps", "steps_with_targets", "added_edges"]
    out = runs.rollup("source").agg(
        F.grouping("source").alias("overall"), F.count(F.lit(1)).alias("runs"), *[F.count_if(F.col("bucket") == b).alias(f"{b.lower()}_runs") for b in ("no_break", "HIGH", "LOW")],
        *[F.sum(c).alias(c) for c in sums], F.median("opaque_rate").alias("median_opaque_rate"),
    )
    return out.withColumn("source", F.when(F.col("overall") == 1, "ALL").otherwise(F.col("source"))).drop("overall")


def census(activities: DataFrame, results: DataFrame) -> DataFrame:
    """Per source and over all: runs, activities, clean runs, steps eligible for each fault class."""
    from .inject import eligible

    dirty = gates.dirty_runs(results).withColumn("dirty", F.lit(True))
    runs = activities.groupBy("run_id").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("activities")).join(dirty, "run_id", "left")
    steps = eligible(activities, results).groupBy("run_id").pivot("fault_class", ["G1_TARGET", "G2_TARGET", "G3_TARGET", "CONTROL", "BENIGN"]).count()
    out = runs.join(steps, "run_id", "left").fillna(0).rollup("source").agg(
        F.grouping("source").alias("overall"), F.count(F.lit(1)).alias("runs"), F.sum("activities").alias("activities"), F.count_if(F.col("dirty").isNull()).alias("clean_runs"),
        *[F.sum(c).alias(c.lower()) for c in ("G1_TARGET", "G2_TARGET", "G3_TARGET", "CONTROL", "BENIGN")],
    )
    return out.withColumn("source", F.when(F.col("overall") == 1, "ALL").otherwise(F.col("source"))).drop("overall")


def replay(activities: DataFrame, results: DataFrame, localizations: DataFrame) -> DataFrame:
    """A row per run: steps by kind, statuses by gate, breaks by confidence."""
    kinds = activities.groupBy("run_id").pivot("kind", ["user_msg", "llm_call", "tool_call", "file_edit", "test_run", "opaque_shell", "unmapped", "verdict"]).count()
    tally = results.groupBy("run_id").agg(*[F.count_if((F.col("gate") == g) & (F.col("status") == s)).alias(f"{g}_{s}".lower()) for g in ("G1", "G2", "G3") for s in ("PASS", "FAIL", "NA")])
    sure = localizations.groupBy("run_id").agg(F.count_if(F.col("confidence") == "HIGH").alias("high"), F.count_if(F.col("confidence") == "LOW").alias("low"))
    return kinds.join(tally, "run_id").join(sure, "run_id", "left").fillna(0)


def coverage(activities: DataFrame) -> DataFrame:
    """By run and in total (run_id ALL): activities, mapped and not, opaque and linked actions, steps of each kind."""
    action, count_of = F.col("kind").isin(*ACTION_KINDS), lambda k: F.count_if(F.col("kind") == k)
    out = activities.rollup("run_id").agg(
        F.grouping("run_id").alias("overall"), F.count(F.lit(1)).alias("activities"), F.count_if(F.col("kind") != "unmapped").alias("mapped"), count_of("unmapped").alias("unmapped"), F.count_if(action).alias("actions"),
        F.count_if(action & F.col("parent_step").isNotNull()).alias("linked_actions"), *[count_of(k).alias(k) for k in KINDS if k != "unmapped"],
    )
    return out.withColumn("run_id", F.when(F.col("overall") == 1, "ALL").otherwise(F.col("run_id"))).drop("overall")


def shell_lift(activities: DataFrame) -> DataFrame:
    """By run and in total (run_id ALL): shell commands, those whose files are known, and the edges that these add."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("shell_command_steps", "steps_with_targets", "added_edges")]
    out = graph.shell_coverage(activities).rollup("run_id").agg(F.grouping("run_id").alias("overall"), *sums)
    return out.withColumn("run_id", F.when(F.col("overall") == 1, "ALL").otherwise(F.col("run_id"))).drop("overall")


def unmapped_types(activities: DataFrame) -> DataFrame:
    """By run and in total (run_id ALL): what the records that no activity stands for are called by their payload, else by themselves."""
    said = F.coalesce(*[F.nullif(F.get_json_object("inputs_json", f"$.{k}"), F.lit("")) for k in ("payload_type", "record_type")], F.lit("<missing>"))
    out = activities.where("kind = 'unmapped'").select("run_id", said.alias("type")).rollup("type", "run_id").agg(F.grouping("run_id").alias("overall"), F.grouping("type").alias("all_types"), F.count(F.lit(1)).alias("n"))
    return out.where("all_types = 0").select(F.when(F.col("overall") == 1, "ALL").otherwise(F.col("run_id")).alias("run_id"), "type", "n")


def record_families(records: DataFrame) -> DataFrame:
    """By file and in total (path ALL): records by their type and their payload's. ``records``: path, record (JSON text)."""
    of = lambda k: F.coalesce(F.get_json_object("record", k), F.lit("<missing>"))
    out = records.where(F.trim("record").startswith("{")).select("path", F.concat_ws(":", of("$.type"), of("$.payload.type")).alias("family")).rollup("family", "path").agg(F.grouping("path").alias("overall"), F.grouping("family").alias("all_families"), F.count(F.lit(1)).alias("n"))
    return out.where("all_families = 0").select(F.when(F.col("overall") == 1, "ALL").otherwise(F.col("path")).alias("path"), "family", "n")


def sweep(activities: DataFrame, localizations: DataFrame) -> DataFrame:
    """Per run: actions without a parent, the run's first action apart, and breaks by confidence."""
    action = F.col("kind").isin(*ACTION_KINDS)
    first = activities.where(action).groupBy("run_id").agg(F.min("step_index").alias("first_action"))
    runs = activities.join(first, "run_id", "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("activities"), F.count_if(action & F.col("parent_step").isNull() & (F.col("step_index") != F.col("first_action"))).alias("unlinked_actions"), F.count_if(F.col("kind") == "unmapped").alias("unmapped"))
    sure = localizations.groupBy("run_id").agg(F.sum(F.when(F.col("confidence") == "HIGH", F.size("cascade") + 1).otherwise(0)).alias("high_steps"), F.sum(F.when(F.col("confidence") == "LOW", F.size("cascade") + 1).otherwise(0)).alias("low_steps"))
    return runs.join(sure, "run_id", "left").fillna(0)


#: What a sweep adds up, and its shares: name, part, whole.
SWEPT = ("activities", "actions", "failing_steps", "high_steps", "low_steps", "na_steps", "opaque_shell_actions", "unmapped_actions", "unlinked_actions", "opaque_or_unmapped")
SHARES = (
    ("high_rate", "high_steps", "failing_steps"), ("low_rate", "low_steps", "failing_steps"), ("na_rate", "na_steps", "failing_steps"), ("opaque_shell_fraction", "opaque_shell_actions", "actions"),
    ("unmapped_fraction", "unmapped_actions", "actions"), ("unlinked_fraction", "unlinked_actions", "actions"), ("opaque_or_unmapped_fraction", "opaque_or_unmapped", "activities"),
)


def sweep_runs(activities: DataFrame, results: DataFrame, localizations: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per run: who it is by ``sources`` (run_id, instance_id, repo, commit; any may lack or be empty) and what SWEPT counts.

    A failing step has the confidence of the break that explains it, NA without one. A run without an instance is one of its own.
    """
    action, kind = F.col("kind").isin(*ACTION_KINDS), F.col("kind")
    first = F.min(F.when(action, F.col("step_index"))).alias("first")
    runs = activities.groupBy("run_id").agg(first, F.count(F.lit(1)).alias("activities"), F.count_if(action).alias("actions"), F.count_if(kind == "opaque_shell").alias("opaque_shell_actions"), F.count_if(kind == "unmapped").alias("unmapped_actions"), F.count_if(action & F.col("parent_step").isNull()).alias("parentless"))
    # the first action needs no parent
    lone = activities.where(action & F.col("parent_step").isNull()).groupBy("run_id", F.col("step_index").alias("first")).agg(F.count(F.lit(1)).alias("excused"))
    runs = runs.join(lone, ["run_id", "first"], "left").withColumn("unlinked_actions", F.col("parentless") - F.coalesce("excused", F.lit(0)))
    failing = results.where("status = 'FAIL'").select("run_id", "step_index").distinct()
    sure = localizations.select("run_id", F.explode(F.array_union(F.array("breaking_step"), "cascade")).alias("step_index"), "confidence")
    sure = sure.groupBy("run_id", "step_index").agg(F.max("confidence").alias("confidence"))
    of = lambda c: F.count_if(F.coalesce("confidence", F.lit("NA")) == c)
    judged = failing.join(sure, ["run_id", "step_index"], "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("failing_steps"), of("HIGH").alias("high_steps"), of("LOW").alias("low_steps"), of("NA").alias("na_steps"))
    said = lambda c: F.coalesce(c, F.lit(""))
    out = runs.join(judged, "run_id", "left").join(sources.select("run_id", "instance_id", "repo", "commit"), "run_id", "left").withColumn("opaque_or_unmapped", F.col("opaque_shell_actions") + F.col("unmapped_actions"))
    instance = F.coalesce(F.nullif("instance_id", F.lit("")), F.concat(F.lit("local:"), "run_id"))
    return out.select("run_id", instance.alias("instance_id"), said("repo").alias("repo"), said("commit").alias("commit"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in SWEPT])


def sweep_totals(runs: DataFrame, *keys: str) -> DataFrame:
    """Totals and shares of ``sweep_runs`` by keys (an instance, or repo and commit), or over all without any."""
    out = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(F.when(~F.startswith("instance_id", F.lit("local:")), F.col("instance_id"))).alias("instances"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SWEPT])
    return out.withColumns({name: F.try_divide(a, b) for name, a, b in SHARES})


def source_counts(activities: DataFrame, results: DataFrame) -> DataFrame:
    """Per source: steps, structured share of actions, and edits that G2 could judge."""
    judged = results.where("gate = 'G2' AND status <> 'NA'").select("run_id", "pos", F.lit(1).alias("judged"))
    rows = activities.join(judged, ["run_id", "pos"], "left")
    action, structured, is_edit = F.col("kind").isin(*ACTION_KINDS), F.col("kind").isin(*STRUCTURED), F.col("kind") == "file_edit"
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("steps"), F.count_if(action).alias("actions"), F.count_if(structured).alias("structured"), F.count_if(is_edit).alias("edits"), F.count("judged").alias("judged_edits"))
    return out.withColumn("structured_fraction", F.try_divide("structured", "actions")).withColumn("judged_fraction", F.try_divide("judged_edits", "edits"))


def sweep_by(swept: DataFrame, runs: DataFrame, *keys: str) -> DataFrame:
    """A sweep's totals by keys that ``runs`` (run_id and keys) gives, and the share of failing steps of high confidence."""
    out = swept.join(runs, "run_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in ("activities", "unlinked_actions", "unmapped", "high_steps", "low_steps")])
    return out.withColumn("high_share", F.try_divide("high_steps", F.col("high_steps") + F.col("low_steps")))
