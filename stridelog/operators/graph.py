"""The causality graph of a run: parent links and file dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shell import with_targets

_NONE = "array<string>"


def with_refs(activities: DataFrame) -> DataFrame:
    """Adds refs: the files that each step touches, whether it may change them (produces), and what of that stands without shell targets (base, base_produces)."""
    rows = activities if "shell" in activities.columns else with_targets(activities)
    kind = F.col("kind")
    none = F.array().cast(_NONE)
    is_shell = kind.isin("opaque_shell", "test_run")
    own = F.when(kind != "unmapped", F.array_compact(F.array(F.when((F.col("target") != "") & (F.col("target") != "shell"), F.col("target")), F.when(F.col("file_path") != "", F.col("file_path"))))).otherwise(none)
    reads, writes = (F.coalesce(F.when(is_shell, F.col(f"shell.{c}")), none) for c in ("reads", "writes"))
    edit, has = kind == "file_edit", F.array_contains
    ref = lambda f: F.struct(f.alias("file"), (edit | has(writes, f)).alias("produces"), ((kind != "opaque_shell") & has(own, f)).alias("base"), edit.alias("base_produces"))
    return rows.withColumn("refs", F.transform(F.array_union(own, F.array_union(reads, writes)), ref))


def file_refs(activities: DataFrame) -> DataFrame:
    """run_id, step_index, and the fields of each of its refs."""
    return with_refs(activities).select("run_id", "step_index", F.inline("refs"))


def parent_edges(activities: DataFrame) -> DataFrame:
    """run_id, src, dst for parents that are steps of the run."""
    steps = activities.select(F.col("run_id"), F.col("step_index").alias("src")).distinct()
    return activities.where("parent_step IS NOT NULL").select("run_id", F.col("parent_step").alias("src"), F.col("step_index").alias("dst")).join(steps, ["run_id", "src"], "left_semi")


def edges(activities: DataFrame) -> DataFrame:
    """run_id, src, dst, base: the full graph; ``base`` marks edges that stand without shell targets.

    Every earlier producer of a file, not only the latest, has an edge to each later step that touches it:
    as many edges as the result names. Localization does without them, from the references themselves.
    """
    rows = activities if "shell" in activities.columns else with_targets(activities)
    refs = file_refs(rows)
    p = refs.where("produces").select("run_id", "file", F.col("step_index").alias("src"), "base_produces")
    c = refs.select("run_id", "file", F.col("step_index").alias("dst"), F.col("base").alias("base_ref"))
    linked = p.join(c, ["run_id", "file"]).where("src < dst").select("run_id", "src", "dst", (F.col("base_produces") & F.col("base_ref")).alias("base"))
    return linked.unionByName(parent_edges(rows).withColumn("base", F.lit(True))).groupBy("run_id", "src", "dst").agg(F.max("base").alias("base"))


def shell_coverage(activities: DataFrame) -> DataFrame:
    """run_id, shell_command_steps, steps_with_targets, added_edges."""
    rows = with_targets(activities)
    command = F.col("kind").isin("opaque_shell", "test_run") & F.col("command").isNotNull()
    steps = rows.groupBy("run_id").agg(F.count_if(command).alias("shell_command_steps"), F.count_if(command & F.col("shell").isNotNull()).alias("steps_with_targets"))
    added = edges(rows).where("NOT base").groupBy("run_id").agg(F.count(F.lit(1)).alias("added_edges"))
    return steps.join(added, "run_id", "left").fillna(0, ["added_edges"])
