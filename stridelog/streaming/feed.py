"""Extension: checks over an append-only feed of activities.

G1 and G3 need no state and run as they do over tables. Which step of a run failed
first is a minimum per run, kept by the stream's own aggregation; a watermark on
arrival time lets runs that have ended leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates


def stateless_gates(activities: DataFrame) -> DataFrame:
    return gates.g1(activities).unionByName(gates.g3(activities))


def first_failures(activities: DataFrame, arrived: str = "arrived", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """run_id, window, failing steps and the smallest of them; ``arrived`` is a timestamp column."""
    feed = activities.withWatermark(arrived, late)
    text = gates.normalized_output(F.coalesce("test_text", F.lit("")))
    failed = (F.col("kind") == "test_run") & (F.coalesce(F.col("exit_code") != 0, F.lit(False)) | gates.signal(text, gates.FAIL_SIGNALS))
    return feed.where(failed).groupBy("run_id", F.window(arrived, window)).agg(F.count(F.lit(1)).alias("failing_steps"), F.min("step_index").alias("first_failing_step"))
