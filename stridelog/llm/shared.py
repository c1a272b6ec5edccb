"""Plumbing shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clear, materialize, release, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Spark's reader opens it, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty); other columns never travel."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex16(col: Column) -> Column:
    """A long as 16 lowercase hex digits, its bits read as unsigned."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column``: what a task holds at once stays small, but for a single longer row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


__all__ = ["clear", "hex16", "materialize", "partitions", "release", "scratch_dir", "slices", "table", "text_of"]
