"""Recordings in files as one activities table, and back.

A file is one row of a whole-text scan, so files are read in parallel wherever
they are. It is divided into records; what records refer to is settled by windows
(``linking``), and each record leaves as rows of the activities schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial, reduce
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import hashing
from ..scratch import materialize
from . import calls, histories, journals, linked, linking

HISTORIES = ("action", "editor", "fenced", "chat")
FORMATS = ("auto", "journal", "calls", "linked", *HISTORIES)


def stem_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def parse_lines(path: str, text: str, strict: bool = True) -> list[Any]:
    """JSON lines; blank ones are skipped. A bad line fails the file: an error that names it, or no records."""
    out = []
    for number, line in enumerate(re.split("\r\n|\n|\r", text), 1):
        if line.strip():
            try:
                out.append(json.loads(line))
            except ValueError as e:
                if strict:
                    raise ValueError(f"{path}:{number}: invalid JSON: {e}") from e
                return []
    return out


def looks_like_journal(text: str) -> bool:
    first = next((x for x in text.splitlines() if x.strip()), "")
    try:
        record = json.loads(first)
    except ValueError:
        return False
    return isinstance(record, dict) and {"activity", "prev_hash", "record_hash"} <= set(record)


def looks_like_calls(text: str) -> bool:
    """Its first record tells; only then is the whole file parsed: one bad line and it is none."""
    line = next((x for x in re.split("\r\n|\n|\r", text) if x.strip()), "")
    try:
        first = json.loads(line)
    except ValueError:
        return False
    told = isinstance(first, dict) and first.get("type") in calls.RECORD_TYPES and isinstance(first.get("payload"), dict)
    return told and bool(parse_lines("", text, strict=False))


def parse_journal(path: str, text: str) -> list[dict]:
    """Activities of a journal whose chain holds; content hashes are computed anew."""
    rows, last = [], hashing.GENESIS
    for number, record in enumerate(parse_lines(path, text)):
        try:
            own, prev, sealed, want = journals.record_of(record)
        except (KeyError, TypeError) as e:
            raise ValueError(f"{path}: line {number + 1} is not a journal record") from e
        if prev != last:
            raise ValueError(f"{path}: prev_hash mismatch at record {number}")
        if sealed != want:
            raise ValueError(f"{path}: record_hash mismatch at record {number}")
        last = sealed
        rows.append(own | {"pos": number})
    return rows


def form_of(path: str, text: str) -> str:
    """Journals and call recordings by their look, whole documents by what they hold, the rest as linked records."""
    if looks_like_journal(text):
        return "journal"
    if looks_like_calls(text):
        return "calls"
    try:
        data = json.loads(text)
    except ValueError:
        return "linked"
    return dialect_of(data) or "linked"


def dialect_of(data: Any) -> str | None:
    """The dialect of a whole document, if it is a history."""
    if not isinstance(data, dict):
        return None
    row = data.get("row") if isinstance(data.get("row"), dict) else data
    if "mistake_step" in data or "question_ID" in data:
        return "chat"
    if isinstance(row.get("trajectory"), list) and ("instance_id" in row or "trajectory_id" in row) and "trajectory_format" not in data and row is not data:
        return "editor"
    if isinstance(data.get("messages"), list):
        return "fenced"
    return "action" if any(isinstance(data.get(k), list) for k in ("history", "trajectory")) else None


def split(path: str, text: str, form: str) -> tuple[str, list[Any]]:
    """The run's name and the records of one file."""
    if form in HISTORIES:
        return histories.records_of(form, stem_of(path), json.loads(text))
    return calls.run_id_of(stem_of(path)) if form == "calls" else stem_of(path), parse_lines(path, text)


_SPLIT = "path string, form string, error string, run_id string, url string, pos int, record string"
_READERS = {"calls": calls.activities, "linked": linked.activities} | {d: partial(histories.activities, dialect=d) for d in HISTORIES}


def read_files(spark: SparkSession, paths: str | list[str], form: str = "auto", glob: str | None = None, strict: bool = True, placed: bool = False) -> DataFrame:
    """path, error, activity. If not strict, a file that fails is one row with its error's type. Files known to be journals are read by ranges of lines.

    ``placed``: of a folder, only files that are recordings in this form by place and name (``text.is_read``); a file given by itself is read whatever its name.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    if form == "journal":
        found = journals.read_journals(spark, paths, strict, glob).drop("record_hash")
        return found if strict else found.withColumn("error", F.when(F.col("error").isNotNull(), "ValueError"))
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), "value")
    if placed:
        given = [quote(p.rstrip("/"), safe="/:") for p in ([paths] if isinstance(paths, str) else paths)]
        files = files.where(reduce(Column.__or__, [F.endswith("path", F.lit(p)) for p in given], text.is_read(F.col("path"), form)))
    return read_texts(files, form, strict)


def read_texts(files: DataFrame, form: str = "auto", strict: bool = True) -> DataFrame:
    """The same for files that are rows already: path, value. In ``auto``, a dialect in a file's name comes before what the file looks like."""
    names = _SPLIT.replace(" string", "").replace(" int", "").split(", ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, value, told in zip(pdf["path"], pdf["value"], pdf["told"], strict=True):
                try:
                    own = told or form_of(path, value)
                    if own == "journal":
                        made = [(path, own, None, r["run_id"], "", r["pos"], json.dumps(r)) for r in parse_journal(path, value)]
                    else:
                        run_id, records = split(path, value, own)
                        made = [(path, own, None, run_id, path, n, json.dumps(r)) for n, r in enumerate(records)]
                except Exception as e:
                    if strict:
                        raise
                    made = [(path, None, type(e).__name__, None, None, 0, None)]
                yield pd.DataFrame(made, columns=names)

    told = files.select("path", "value", (text.form_by_name(F.col("path")) if form == "auto" else F.lit(form)).alias("told")).mapInPandas(run, _SPLIT)
    if form == "auto":  # each form reads it
        told = materialize(told)
    activity = linking.READ.split("activity ", 1)[1]
    out = told.where("error IS NOT NULL").select("path", "error", F.lit(None).cast(activity).alias("activity"))
    if form in ("auto", "journal"):
        out = out.unionByName(told.where("form = 'journal'").select("path", "error", F.from_json("record", activity).alias("activity")))
    for name, read in _READERS.items():
        if form in ("auto", name):
            out = out.unionByName(read(told.where(F.col("form") == name).drop("form", "error")))
    return out


def read_activities(spark: SparkSession, paths: str | list[str], form: str = "auto", glob: str | None = None) -> DataFrame:
    return read_files(spark, paths, form, glob).select("activity.*")


def read_mixed(files: DataFrame) -> DataFrame:
    """path, place, error, activity of files (path, value) of many tools: those that are recordings by place and name, each by its own reader; a bad one is a row with its error."""
    path = F.col("path")
    return read_texts(files.where(text.is_read(path, "auto")), strict=False).select("path", text.source_of(path).alias("place"), "error", "activity")


def read_errors(files: DataFrame) -> DataFrame:
    """How many files failed, by the type of error."""
    return files.where("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("files"))


def count_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, records: nonblank lines of each file; of a whole history the length of its list."""
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def of(path: str, text: str) -> int:
        if path.endswith(".jsonl"):
            return sum(1 for x in text.splitlines() if x.strip())
        try:
            form = dialect_of(json.loads(text))
        except ValueError:
            form = None
        return len(split(path, text, form)[1]) if form else sum(1 for x in text.splitlines() if x.strip())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "records": [of(p, t) for p, t in zip(pdf["path"], pdf["value"], strict=True)]})

    return files.mapInPandas(run, "path string, records bigint")


def with_manifest(activities_by_path: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with what a manifest says of each: a path's end, from a folder's name on, is its local_path.

    Ends are keys, so this is an equi-join of any two sizes. The longest local_path wins; ``claims`` says how many rows have it
    (more than one: ambiguous, the row that is greatest as JSON stands; none: 0).
    """
    paths = activities_by_path.select("path").distinct()
    parts = F.split("path", "/")
    ends = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("cut", "local_path"))
    said = manifest.select("local_path", F.struct(*[F.col(c) for c in manifest.columns]).alias("source")).withColumn("order", F.to_json("source"))
    found = ends.join(said, "local_path").groupBy("path", "cut").agg(F.max_by("source", "order").alias("source"), F.count(F.lit(1)).alias("claims"))
    own = found.groupBy("path").agg(F.min_by(F.struct("source", "claims"), "cut").alias("m"))
    return activities_by_path.join(own, "path", "left").select(*activities_by_path.columns, "m.source.*", F.coalesce("m.claims", F.lit(0)).cast("bigint").alias("claims"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """local_path and what else a manifest says of each source."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("sources").alias("s")).select("s.*")


def pattern_rows(text: str) -> list[dict]:
    """A pattern set, checked: a list, or an object's ``patterns``; ids are numbered and inputs generated where there are none."""
    data = json.loads(text)
    entries = data.get("patterns") if isinstance(data, dict) else data
    if not isinstance(entries, list):
        raise ValueError("a pattern set is a list or an object with a list of patterns")
    out = []
    for n, entry in enumerate(entries):
        own = entry if isinstance(entry, dict) else {}
        inputs = own.get("inputs") or []
        row = {"pattern_id": own.get("id", f"pattern-{n}"), "pattern": own.get("pattern"), "inputs": inputs, "generate": own.get("generate", not inputs), "description": own.get("description", "")}
        wrong = [k for k, v in row.items() if not isinstance(v, {"inputs": list, "generate": bool}.get(k, str))]
        if wrong or not row["pattern_id"] or not all(isinstance(x, str) for x in inputs):
            raise ValueError(f"pattern {n}: {', '.join(wrong) or 'id or inputs'} not as it should be")
        out.append(row)
    return out


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id, pattern, inputs, generate, description. A set is a written list of some kilobytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for text in pdf["value"] for r in pattern_rows(text)]
            if rows:
                yield pd.DataFrame(rows)

    return spark.read.text(path, wholetext=True).mapInPandas(run, "pattern_id string, pattern string, inputs array<string>, generate boolean, description string")


def journal_lines(activities: DataFrame) -> DataFrame:
    """run_id, pos, value: canonical JSON lines of a journal."""
    records = hashing.chain(activities)
    rows = activities.select("run_id", "pos", hashing.payload(activities).alias("c")).join(records, ["run_id", "pos"])
    value = F.concat(F.lit('{"activity":{"content_hash":"'), "content_hash", F.lit('",'), F.expr("substr(c, 2)"), F.lit(',"prev_hash":"'), "prev_hash", F.lit('","record_hash":"'), "record_hash", F.lit('"}'))
    return rows.select("run_id", "pos", value.alias("value"))


def write_journals(activities: DataFrame, path: str) -> None:
    """A folder per run, each with its lines in order."""
    journal_lines(activities).repartition("run_id").sortWithinPartitions("run_id", "pos").select("run_id", "value").write.partitionBy("run_id").text(path)
