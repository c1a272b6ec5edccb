"""Localization by joins, level by level, whatever way links lead.

References stay bipartite (step, file, step) and edges are never written: what a step
receives through a file is a running minimum over the file's earlier producers, so a level
costs a sort of the references and not their pairs. First labels: each step takes the
smallest failing step that reaches it, in rounds until none changes. Then paths: every
breaking step's part of the graph is searched from its own root in levels, all runs
at once, and a step keeps the smallest path among those that come to it in its level.
Every round is a table in the shared folder; the one before goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, release

# What evidence on a path is called; plurals end in s.
NOTES = ["opaque_shell node (heuristic shell target)", "opaque_shell node", "unlinked step", "heuristic shell-target edge"]
STEP = ["run_id", "step_index"]


def joined(notes: list[str]) -> str:
    return "; ".join(notes) + " on path" if notes else "structured path"


def _coverage(counts: list[Column]) -> Column:
    noted = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))) for n, noun in zip(counts, NOTES)]
    said = F.concat_ws("; ", *noted)
    return F.when(said == "", "structured path").otherwise(F.concat(said, F.lit(" on path")))


def _earlier(value: Column, *keys: str) -> Column:
    """The smallest value of steps before this one that touch the same file."""
    return F.min(value).over(Window.partitionBy("run_id", "file", *keys).orderBy("step_index").rangeBetween(Window.unboundedPreceding, -1))


def _tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes; links from parents (run_id, src, step_index); refs (run_id, step_index, file, ...). A repeated step is one node: its last row's, with the links and files of all."""
    last = lambda c: F.max_by(c, "pos").alias(c)
    nodes = materialize(rows.groupBy(*STEP).agg(last("kind"), last("parent_step"), last("targets"), F.min("gate").alias("gate")))
    links = rows.where("parent_step IS NOT NULL").select("run_id", F.col("parent_step").alias("src"), "step_index").distinct()
    links = materialize(links.join(nodes.select("run_id", F.col("step_index").alias("src")), ["run_id", "src"], "left_semi"))
    refs = rows.select(*STEP, F.inline("refs")).groupBy(*STEP, "file").agg(*[F.bool_or(c).alias(c) for c in ("produces", "base", "base_produces")])
    return nodes, links, materialize(refs)


def labels(nodes: DataFrame, links: DataFrame, refs: DataFrame) -> DataFrame:
    """run_id, step_index, label: the smallest failing step upstream, itself included; only steps that have one."""
    held = materialize(nodes.select(*STEP, F.when(F.col("gate").isNotNull(), F.col("step_index")).alias("label")))
    while True:
        by_parent = links.join(held.where("label IS NOT NULL").select("run_id", F.col("step_index").alias("src"), F.col("label").alias("up")), ["run_id", "src"])
        by_file = refs.join(held, STEP).withColumn("up", _earlier(F.when(F.col("produces"), F.col("label"))))
        ups = by_parent.select(*STEP, "up").unionByName(by_file.select(*STEP, "up")).where("up IS NOT NULL").groupBy(*STEP).agg(F.min("up").alias("up"))
        after = materialize(held.join(ups, STEP, "left").select(*STEP, F.least("label", "up").alias("label"), F.coalesce(F.col("up") < F.coalesce("label", F.lit(2**31 - 1)), F.lit(False)).alias("moved")))
        release(held)
        held = after
        if held.where("moved").isEmpty():
            return held.where("label IS NOT NULL").drop("moved")


def shortest_paths(labelled: DataFrame, links: DataFrame, refs: DataFrame) -> DataFrame:
    """run_id, step_index, label, path: from each label to each of its steps the shortest path, the smallest among equals."""
    used = materialize(refs.join(labelled, STEP).select(*STEP, "file", "produces", "label"))
    level = materialize(labelled.where("label = step_index").withColumn("path", F.array("step_index")))
    reached = level
    while not level.isEmpty():
        at = level.select("run_id", F.col("step_index").alias("src"), F.col("label").alias("own"), "path")
        by_parent = links.join(at, ["run_id", "src"]).join(labelled, STEP).where("label = own").select(*STEP, "label", "path")
        by_file = used.join(level.select(*STEP, "path"), STEP, "left").withColumn("path", _earlier(F.when(F.col("produces"), F.col("path")), "label")).where("path IS NOT NULL").select(*STEP, "label", "path")
        new = by_parent.unionByName(by_file).join(reached.select(*STEP), STEP, "left_anti").groupBy(*STEP, "label").agg(F.min("path").alias("path"))
        level = materialize(new.withColumn("path", F.concat("path", F.array("step_index"))))
        reached = reached.unionByName(level)
    return reached


def localize(rows: DataFrame) -> DataFrame:
    """run_id, breaking_step, breaking_gate, cascade, confidence, coverage, candidates of the runs in ``rows`` (see ``localize.step_rows``)."""
    nodes, links, refs = _tables(rows)
    labelled = labels(nodes, links, refs)
    paths = materialize(shortest_paths(labelled, links, refs).join(nodes.where("gate IS NOT NULL").select(*STEP, "gate"), STEP))
    other = F.col("step_index") != F.col("label")
    groups = paths.groupBy("run_id", "label").agg(F.min(F.when(~other, F.col("gate"))).alias("breaking_gate"), F.array_sort(F.collect_list(F.when(other, F.col("step_index")))).alias("cascade"))
    on_path = paths.where(other).select("run_id", "label", F.explode("path").alias("step_index")).distinct().join(nodes, STEP)
    opaque = F.col("kind").isin("opaque_shell", "unmapped")
    unlinked = other & F.col("parent_step").isNull()
    steps = on_path.groupBy("run_id", "label").agg(
        F.count_if(opaque & F.col("targets")).alias("known"), F.count_if(opaque & ~F.col("targets")).alias("plain"), F.count_if(unlinked).alias("unlinked"), F.collect_list(F.when(opaque | unlinked, F.col("step_index"))).alias("seen")
    )
    pairs = F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS src, path[i] AS dst))")
    edges = paths.where(other).select("run_id", "label", F.explode(pairs).alias("e")).select("run_id", "label", "e.*").distinct()
    ends = lambda c, *more: nodes.select("run_id", F.col("step_index").alias(c), F.col("targets").alias(f"{c}_targets"), *more)
    of = lambda c, flag: refs.where(flag).select("run_id", F.col("step_index").alias(c), "file")
    by_base = edges.where("src < dst").join(of("src", "base_produces"), ["run_id", "src"]).join(of("dst", "base"), ["run_id", "dst", "file"]).select("run_id", "src", "dst").distinct()
    guessed = edges.join(by_base, ["run_id", "src", "dst"], "left_anti").join(ends("src"), ["run_id", "src"]).join(ends("dst", "parent_step"), ["run_id", "dst"]).where("parent_step IS NULL OR parent_step != src")
    marks = guessed.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("guessed"), F.array_union(F.collect_list(F.when(F.col("src_targets"), F.col("src"))), F.collect_list(F.when(F.col("dst_targets"), F.col("dst")))).alias("by_shell"))
    all_of = groups.join(steps, ["run_id", "label"], "left").join(marks, ["run_id", "label"], "left")
    counts = [F.coalesce(c, F.lit(0)) for c in ("known", "plain", "unlinked", "guessed")]
    coverage, none = _coverage(counts), F.array().cast("array<int>")
    return all_of.select(
        "run_id", F.col("label").alias("breaking_step"), "breaking_gate", "cascade", F.when(coverage == "structured path", "HIGH").otherwise("LOW").alias("confidence"), coverage.alias("coverage"),
        F.array_sort(F.array_union(F.coalesce("seen", none), F.coalesce("by_shell", none))).alias("candidates"),
    )
