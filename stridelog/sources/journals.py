"""Journals of any size, read in many tasks.

Spark's text reader cuts files into byte ranges at line ends, in any store; a range says
where in its file it starts. Each range is parsed and checked on its own: content hashes
and record hashes are computed anew, and every record must name the one before it. What
a range cannot know, how many lines and records come before it and which hash its first
record must name, follows from one summary for each range: sums and the last hash over the
ranges of a file. No record is shuffled for it, and no file is held whole.

A file fails as a whole: first by a line that is no JSON or no record, else by the first
record where the chain does not hold, its link before its seal.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.hashing import GENESIS
from ..scratch import materialize
from . import linking, recording

ACTIVITY = linking.READ.split("activity ", 1)[1]
#: say 0: a record; 1: a fault; 2: a range's summary (line and record: how many; prev: of its first record; sealed: of its last).
PARSED = "say int, path string, start bigint, line bigint, record bigint, prev string, sealed string, reason string, activity string"
RECORD, FAULT, RANGE = range(3)
_NAMES = [c.split()[0] for c in PARSED.split(", ")]
_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
# What is wrong with a file.
NO_JSON, NO_RECORD, BAD_LINK, BAD_SEAL = "invalid JSON", "not a journal record", "prev_hash mismatch", "record_hash mismatch"


def record_of(data: object) -> tuple[dict, str, str, str]:
    """A record's activity row, the hash it names, its own and the one it should have. KeyError or TypeError if it is none."""
    a, prev, sealed = data["activity"], data["prev_hash"], data["record_hash"]
    step = {"step": int(a["step_index"]), "kind": str(a["kind"]), "parent": a.get("parent_step"), "ts": str(a.get("ts", "")), "tool": a.get("tool_name"), "target": a.get("target"), "inputs": dict(a.get("inputs") or {}), "outputs": dict(a.get("outputs") or {})}
    own = recording.row(str(a["run_id"]), "journal", step)
    fields = {"inputs": step["inputs"], "kind": step["kind"], "outputs": step["outputs"], "parent_step": step["parent"], "run_id": own["run_id"], "step_index": step["step"], "target": step["target"], "tool_name": step["tool"], "ts": step["ts"], "content_hash": own["content_hash"]}
    return own, str(prev), str(sealed), recording.digest(recording.canonical({"activity": fields, "prev_hash": prev}))


class _Range:
    """What one byte range of a file holds, line by line."""

    def __init__(self, path: str, start: int):
        self.at, self.lines, self.records, self.first, self.last = (path, start), 0, 0, None, None

    def add(self, text: str) -> Iterator[tuple]:
        self.lines += 1
        if not text.strip():
            return
        try:
            own, prev, sealed, want = record_of(json.loads(text))
        except (KeyError, TypeError, ValueError) as e:
            yield FAULT, *self.at, self.lines, self.records, None, None, NO_JSON if isinstance(e, json.JSONDecodeError) else NO_RECORD, None
            return
        if self.records and prev != self.last:
            yield FAULT, *self.at, self.lines, self.records, None, None, BAD_LINK, None
        if sealed != want:
            yield FAULT, *self.at, self.lines, self.records, None, None, BAD_SEAL, None
        yield RECORD, *self.at, self.lines, self.records, prev, sealed, None, json.dumps(own)
        self.first = prev if self.first is None else self.first
        self.last, self.records = sealed, self.records + 1

    def summary(self) -> tuple:
        return RANGE, *self.at, self.lines, self.records, self.first, self.last, None, None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for batch in batches:
        rows = []
        for path, start, text in zip(*(c.to_pylist() for c in batch.columns)):
            if own is None or own.at != (path, start):
                rows += [own.summary()] if own else []
                own = _Range(path, start)
            rows += own.add(text)
        if rows:
            yield _batch(rows)
    if own:
        yield _batch([own.summary()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def ranged_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """path, start, value: the lines of files; those of one byte range come together, in order."""
    lines = spark.read.text(paths, recursiveFileLookup=True, pathGlobFilter=glob)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def read_journals(spark: SparkSession, paths: str | list[str], strict: bool = True, glob: str | None = None) -> DataFrame:
    """path, error, activity, record_hash. If strict, a file that fails is an error; if not, one row that says why."""
    parsed = materialize(ranged_lines(spark, paths, glob).mapInArrow(_parse, PARSED))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ranges = parsed.where(F.col("say") == RANGE).select(
        "path", "start", F.coalesce(F.sum("line").over(before), zero).alias("lines_before"), F.coalesce(F.sum("record").over(before), zero).alias("records_before"),
        "prev", F.coalesce(F.last("sealed", ignorenulls=True).over(before), F.lit(GENESIS)).alias("named"),
    )
    ranges = materialize(ranges)
    links = ranges.where("prev != named").select("path", F.lit(BAD_LINK).alias("reason"), zero.alias("line"), F.col("records_before").alias("record"))
    within = parsed.where(F.col("say") == FAULT).join(ranges, ["path", "start"]).select("path", "reason", (F.col("line") + F.col("lines_before")).alias("line"), (F.col("record") + F.col("records_before")).alias("record"))
    unread = F.col("reason").isin(NO_JSON, NO_RECORD)
    faults = links.unionByName(within).withColumn("order", F.when(unread, F.struct(F.lit(0).alias("a"), F.col("line").alias("b"), F.lit(0).alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("record").alias("b"), (F.col("reason") == BAD_SEAL).cast("int").alias("c"))))
    said = F.when(unread, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("reason"))).otherwise(F.concat(F.col("reason"), F.lit(" at record "), F.col("record").cast("string")))
    failed = materialize(faults.groupBy("path").agg(F.min_by(said, "order").alias("error")))
    if strict and (first := failed.orderBy("path").first()):
        raise ValueError(f"{first['path']}: {first['error']}")
    rows = parsed.where(F.col("say") == RECORD).join(failed, "path", "left_anti").join(ranges.select("path", "start", "records_before"), ["path", "start"])
    read = F.from_json("activity", ACTIVITY)
    good = rows.select("path", F.lit(None).cast("string").alias("error"), read.withField("pos", (F.col("record") + F.col("records_before")).cast("int")).alias("activity"), F.col("sealed").alias("record_hash"))
    bad = failed.select("path", F.col("error"), F.lit(None).cast(ACTIVITY).alias("activity"), F.lit(None).cast("string").alias("record_hash"))
    return good.unionByName(bad)
