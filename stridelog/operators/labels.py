"""Scoring localizations against labels from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inject import predictions


def label_step(value: Column, length: Column) -> Column:
    """A label's step if it is digits only and within the run; else null."""
    digits = F.when(value.rlike("^[0-9]{1,9}$"), value.cast("int"))
    return F.when(digits < length, digits)


def _judged(labels: DataFrame, activities: DataFrame, key: str) -> DataFrame:
    """Labels, by ``key`` against their activities, with expected_step and exclusion."""
    lengths = activities.groupBy(key).agg(F.count(F.lit(1)).alias("length"))
    rows = labels.join(lengths, key, "left")
    step = label_step(F.col("mistake_step"), F.coalesce("length", F.lit(0)))
    why = F.when(F.col("length").isNull(), "no run").when(~F.coalesce(F.col("mistake_step").rlike("^[0-9]+$"), F.lit(False)), "step not a number").when(step.isNull(), "step out of range")
    return rows.select(*labels.columns, step.alias("expected_step"), why.alias("exclusion"))


def read_labels(labels: DataFrame, activities: DataFrame) -> DataFrame:
    """case_id, config, expected_step, expected_gate, exclusion from run_id, config, mistake_step (text)."""
    return _judged(labels, activities, "run_id").select(F.col("run_id").alias("case_id"), "config", "expected_step", F.lit(None).cast("string").alias("expected_gate"), "exclusion")


def label_set(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled histories in files (path, value) and their manifest: the runs' activities, and config, row_idx, run_id, expected_step, exclusion, claims of each file.

    A file's own config and row_idx come before the manifest's; a row_idx that is no whole number does not count.
    Files may come to the same run_id; each label is judged by its own file.
    """
    from ..sources.files import read_texts, with_manifest

    said = lambda name: F.get_json_object("value", f"$.{name}")
    listed = with_manifest(files.select("path"), manifest.select("local_path", F.col("config").alias("listed"), F.col("row_idx").cast("bigint").alias("nth")))
    own = files.select("path", F.nullif(said("config"), F.lit("")).alias("config"), F.when(said("row_idx").rlike("^-?[0-9]{1,18}$"), said("row_idx").cast("bigint")).alias("row_idx"), said("row.mistake_step").alias("mistake_step"), F.coalesce(said("row"), F.lit("{}")).alias("value"))
    rows = own.join(listed, "path").select("path", "value", "mistake_step", "claims", F.coalesce("config", "listed", F.lit("")).alias("config"), F.coalesce("row_idx", "nth", F.lit(0)).cast("bigint").alias("row_idx"))
    rows = rows.withColumn("run_id", F.concat_ws(":", "config", F.col("row_idx").cast("string")))
    read = read_texts(rows.select("path", "value"), "chat").select("path", "activity.*").drop("run_id").join(rows.select("path", "run_id"), "path")
    found = _judged(rows.select("path", "config", "row_idx", "run_id", "claims", "mistake_step"), read, "path")
    return read.drop("path"), found.select("config", "row_idx", "run_id", "claims", "expected_step", "exclusion")


def score(labels: DataFrame, localizations: DataFrame) -> DataFrame:
    """A row per label; the gate does not count. Excluded ones have a coverage gap and no hit."""
    out = predictions(localizations, labels, use_gate=False)
    kept = F.col("exclusion").isNull()
    return out.withColumns({"exact": F.col("exact") & kept, "cascade": F.col("cascade") & kept, "coverage_gap": F.col("coverage_gap") | ~kept})


def score_by_config(scored: DataFrame) -> DataFrame:
    kept = F.col("exclusion").isNull()
    out = scored.rollup("config").agg(F.grouping("config").alias("overall"), F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("included"), F.count_if(~kept).alias("excluded"), F.count_if("exact").alias("exact"), F.count_if("cascade").alias("cascade"), F.count_if(kept & F.col("coverage_gap")).alias("coverage_gaps"))
    return out.withColumn("config", F.when(F.col("overall") == 1, "ALL").otherwise(F.col("config"))).drop("overall")


def exclusions(scored: DataFrame) -> DataFrame:
    return scored.where("exclusion IS NOT NULL").groupBy("exclusion").agg(F.count(F.lit(1)).alias("n"))


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, in a stated order."""
    from pyspark.sql import Window

    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")
