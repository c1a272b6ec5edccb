"""Command line: python -m stridelog.cli COMMAND PATH...

Exit codes: 0, even when a break is found; 1 if a regex pattern is unsupported;
2 for replay without --explain or unknown arguments.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gates, graph, hashing, inject, labels, localize, regexdiff, render, reports
from .scratch import clear, materialize
from .sources import files

#: These go on past files that cannot be read, and say how many.
TOLERANT = ("study", "accuracy")
COMMANDS = ("demo", "ingest", "show", "localize", "replay", "eval", "scan", "sweep", "coverage", "study", "accuracy", "labels", "regex")
DEMO = [
    {"type": "assistant", "uuid": "a", "message": {"content": [{"type": "tool_use", "id": "1", "name": "Write", "input": {"file_path": "calc.py", "content": "total = 1\n"}}]}},
    {"type": "assistant", "uuid": "b", "parentUuid": "a", "message": {"content": [{"type": "tool_use", "id": "2", "name": "Edit", "input": {"file_path": "calc.py", "old_string": "sum = 1", "new_string": "sum = 2"}}]}},
    {"type": "assistant", "uuid": "c", "parentUuid": "b", "message": {"content": [{"type": "tool_use", "id": "3", "name": "Bash", "input": {"command": "pytest"}}]}},
    {"type": "user", "uuid": "d", "parentUuid": "c", "toolUseResult": {"stdout": "1 failed", "exitCode": 1}, "message": {"content": [{"type": "tool_result", "tool_use_id": "3", "content": "1 failed"}]}},
]


def views(spark: SparkSession, activities: DataFrame) -> None:
    """activities, gate_results, edges and localizations for SQL users."""
    results = gates.gate_results(activities)
    for name, df in {"activities": activities, "gate_results": results, "edges": graph.edges(activities), "localizations": localize.localize(activities, results)}.items():
        df.createOrReplaceTempView(name)


def _demo(spark: SparkSession) -> DataFrame:
    from .sources import files

    text = "\n".join(map(json.dumps, DEMO))
    return files.read_texts(spark.createDataFrame([("demo.jsonl", text)], "path string, value string"), "linked").select("activity.*")


def _labels(spark: SparkSession, paths: list[str], activities: DataFrame) -> DataFrame:
    schema = "question_ID string, config string, mistake_step string"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(paths)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return labels.read_labels(rows.select(stem.alias("run_id"), F.coalesce("config", F.lit("default")).alias("config"), "mistake_step"), activities)


def _sweep(spark: SparkSession, read: DataFrame, activities: DataFrame, results: DataFrame, found: DataFrame, manifest: str | None) -> str:
    """The sweep's report; a manifest says which instance, repository and commit a file's run is of."""
    empty = "run_id string, instance_id string, repo string, commit string"
    sources = spark.createDataFrame([], empty)
    if manifest:
        said = files.read_manifest(spark, manifest)
        said = said.select("local_path", *[(F.col(c).cast("string") if c in said.columns else F.lit(None).cast("string")).alias(c) for c in ("instance_id", "repo", "commit")])
        paths = read.where("activity IS NOT NULL").select("path", "activity.run_id").distinct()
        listed = files.with_manifest(paths, said).groupBy("run_id")
        sources = listed.agg(F.max(F.struct("instance_id", "repo", "commit")).alias("s")).select("run_id", "s.*")
    runs = materialize(reports.sweep_runs(activities, results, found, sources))
    tables = [("Sweep", (), ()), ("By instance", ("instance_id",), ("instance_id",)), ("By commit", ("repo", "commit"), ("repo", "commit"))]
    return "\n".join([*(render.markdown(title, reports.sweep_totals(runs, *keys), *order) for title, keys, order in tables), render.markdown("Runs", runs, "run_id")])


def _regex(spark: SparkSession, paths: list[str]) -> tuple[str, int]:
    patterns = files.read_patterns(spark, paths[0])
    own = patterns.select("pattern_id", "pattern", F.posexplode("inputs").alias("pos", "input"))
    made = [(r.pattern_id, r.pattern, 10**6 + n, x) for r in patterns.where("generate").collect() for n, x in enumerate(regexdiff.generate_inputs(r.pattern))]
    if made:
        own = own.unionByName(spark.createDataFrame(made, own.schema))
    observed = regexdiff.observe(own).withColumn("agree", F.col("search") == F.col("full"))
    summary = regexdiff.summary(observed)
    return render.tsv(summary, "pattern_id"), int(summary.where("status = 'unsupported'").count() > 0)


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    if args.command == "regex":
        return _regex(spark, args.paths)
    if args.command == "replay" and not args.explain:
        return "replay needs --explain", 2
    errors = ""
    if args.command == "demo":
        a = _demo(spark)
    else:
        read = materialize(files.read_files(spark, args.paths, args.format, args.glob, strict=args.command not in TOLERANT, placed=args.command in TOLERANT and args.glob is None))
        a = read.where("activity IS NOT NULL").select("activity.*")
        if args.command in TOLERANT and (failed := files.read_errors(read)).count():
            errors = render.markdown("Files that failed", failed, "error")
    a = a.cache()
    if args.command == "ingest":
        files.write_journals(a, args.out)
        return f"{a.count()} activities", 0
    results = materialize(gates.gate_results(a))
    found = localize.localize(a, results)
    if args.command == "show":
        return render.tsv(reports.timeline(a, results), "run_id", "pos"), 0
    if args.command in ("localize", "demo"):
        return render.tsv(found, "run_id", "breaking_step"), 0
    if args.command == "replay":
        return render.narrative(reports.replay(a, results, found), found), 0
    if args.command == "scan":
        return render.tsv(reports.scan(results, found), "run_id", "step_index", "gate"), 0
    if args.command == "sweep":
        return _sweep(spark, read, a, results, found, args.manifest), 0
    if args.command == "coverage":
        return "\n".join([render.tsv(reports.coverage(a), "run_id"), render.tsv(reports.unmapped_types(a), "run_id", "type"), render.tsv(reports.shell_lift(a), "run_id")]), 0
    if args.command == "study":
        return render.markdown("Corpus study", reports.study(reports.study_runs(a, results, found)), "source") + errors, 0
    if args.command == "labels":
        scored = labels.score(_labels(spark, args.paths, a), found)
        return render.markdown("By config", labels.score_by_config(scored), "config") + render.markdown("Excluded", labels.exclusions(scored), "exclusion"), 0
    out = inject.run_injection(hashing.with_content_hash(a), args.per_class, args.max_per_run, args.seed)
    if args.command == "eval":
        return render.as_json(confusion=out["confusion"], accuracy=out["accuracy"]), 0
    return render.markdown("Confusion", out["confusion"], "fault_class") + render.markdown("Accuracy", out["accuracy"], "confidence") + render.markdown("Census", reports.census(a, results), "source") + errors, 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stridelog", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("paths", nargs="*")
    p.add_argument("--format", choices=files.FORMATS, default="auto", help=f"whole-file histories: {', '.join(files.HISTORIES)}")
    p.add_argument("--glob")
    p.add_argument("--manifest", help="sweep: a JSON document of sources, each with its local_path")
    p.add_argument("--out", default="journals")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--seed", type=int, default=inject.SEED)
    p.add_argument("--per-class", type=int, default=1000)
    p.add_argument("--max-per-run", type=int, default=3)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.paths and args.command != "demo":
        print("no paths", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("stridelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        text, code = run(spark, args)
    finally:
        clear(spark)  # what is printed is made
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
