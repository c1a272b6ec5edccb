"""Content hashes and the hash chain of a run."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .passes import in_order

GENESIS = "0" * 64


def _json(value: Column) -> Column:
    """A string as JSON, null as null; the characters JSON escapes are escaped."""
    text = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "null").otherwise(F.regexp_extract(text, r'(?s)^\{"v":(.*)\}$', 1))


def payload(activities: DataFrame) -> Column:
    """Canonical JSON of the hashed fields: keys sorted, no blanks, Unicode kept."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat(
        F.lit('{"inputs":'), F.coalesce("inputs_json", F.lit("{}")), F.lit(',"kind":'), _json(F.col("kind")), F.lit(',"outputs":'), F.coalesce("outputs_json", F.lit("{}")),
        F.lit(',"parent_step":'), number("parent_step"), F.lit(',"run_id":'), _json(F.col("run_id")), F.lit(',"step_index":'), number("step_index"),
        F.lit(',"target":'), _json(F.col("target")), F.lit(',"tool_name":'), _json(F.col("tool_name")), F.lit(',"ts":'), _json(F.coalesce("ts", F.lit(""))), F.lit("}"),
    )


def with_content_hash(activities: DataFrame) -> DataFrame:
    return activities.withColumn("content_hash", F.sha2(payload(activities), 256))


def _record(hashed: Column, canonical: Column, prev: Column) -> Column:
    """Hash of {"activity": the payload with its content_hash, "prev_hash": ...}; content_hash sorts first."""
    activity = F.concat(F.lit('{"content_hash":"'), hashed, F.lit('",'), F.substring(canonical, 2, 2**31 - 1))
    return F.sha2(F.concat(F.lit('{"activity":'), activity, F.lit(',"prev_hash":"'), prev, F.lit('"}')), 256)


def _seal(last: str, run_id: str, pos: int, canonical: str, hashed: str) -> tuple[str, tuple]:
    """The next hash of a chain, and the record: as ``_record``, which checks single records."""
    sealed = sha256(f'{{"activity":{{"content_hash":"{hashed}",{canonical[1:]},"prev_hash":"{last}"}}'.encode()).hexdigest()
    return sealed, (run_id, pos, hashed, last, sealed)


def chain(activities: DataFrame) -> DataFrame:
    """run_id, pos, content_hash, prev_hash, record_hash: each record seals the one before, in one ordered pass."""
    rows = activities.select("run_id", "pos", payload(activities).alias("canonical")).withColumn("content_hash", F.sha2("canonical", 256))
    return in_order(rows, ["run_id"], ["pos"], _seal, lambda: GENESIS, "run_id string, pos int, content_hash string, prev_hash string, record_hash string")


def verify(activities: DataFrame, records: DataFrame) -> DataFrame:
    """run_id, bad_pos, reason for runs whose chain does not hold: no fold, each record is checked by itself.

    Content hashes are recomputed from the activity, so a forged content_hash alone
    goes unnoticed, as does a cut tail.
    """
    rows = activities.select("run_id", "pos", payload(activities).alias("canonical")).join(records.select("run_id", "pos", "prev_hash", "record_hash"), ["run_id", "pos"])
    before = F.coalesce(F.lag("record_hash").over(Window.partitionBy("run_id").orderBy("pos")), F.lit(GENESIS))
    checked = rows.withColumn("want", before).withColumn("sealed", _record(F.sha2("canonical", 256), F.col("canonical"), F.col("prev_hash")))
    reason = F.when(F.col("prev_hash") != F.col("want"), "prev_hash mismatch").when(F.col("record_hash") != F.col("sealed"), "record_hash mismatch")
    bad = checked.withColumn("reason", reason).where("reason IS NOT NULL")
    return bad.groupBy("run_id").agg(F.min("pos").alias("bad_pos"), F.min_by("reason", "pos").alias("reason"))


def tail_hash(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id").agg(F.max_by("record_hash", "pos").alias("tail_hash"))


def run_key(activities: DataFrame) -> DataFrame:
    """run_id, run_key: 16 hex digits of source, name, length and first content hash."""
    rows = with_content_hash(activities)
    runs = rows.groupBy("run_id").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.min_by("content_hash", "pos").alias("first"))
    return runs.select("run_id", F.substring(F.sha2(F.concat_ws(":", "source", "run_id", F.col("n").cast("string"), "first"), 256), 1, 16).alias("run_key"))


def manifest_fingerprint(manifest: DataFrame, *columns: str) -> DataFrame:
    """One digest of a manifest's rows, whatever their order: their JSON, sorted."""
    rows = manifest.select(F.to_json(F.struct(*columns)).alias("r"))
    return rows.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("r"))), 256).alias("fingerprint"))
