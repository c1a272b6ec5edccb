"""What readers of ordered records share: references to earlier records, and rows.

A reader takes three steps. A small function reads keys from each record by itself;
windows over a file's records settle what refers to what, in order; a second small
function makes the activity of each record from it and what was settled. No state
passes through Python, and a long file is a window's partition, not one value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ACTIVITIES, COLUMNS
from ..scratch import materialize
from . import recording

#: What readers take: a record is JSON text; ``run_id`` and ``url`` are the same for all records of a path.
RECORDS = "path string, run_id string, url string, pos int, record string"
READ = f"path string, error string, activity struct<{ACTIVITIES.replace(' ', ':').replace(',:', ',')}>"


def in_file() -> Window:
    return Window.partitionBy("path").orderBy("pos")


def earlier(*keys: str) -> Window:
    """Rows before this one, of the same file and keys."""
    return Window.partitionBy("path", *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def last_of(value: Column, window: Window) -> Column:
    return F.last(value, ignorenulls=True).over(window)


def keyed(records: DataFrame, facts: Callable[..., dict], schema: str, *more: str) -> DataFrame:
    """``records`` and the facts of each, which ``facts`` reads from the parsed record and the columns ``more``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [facts(json.loads(r), *x) for r, *x in pdf[["record", *more]].itertuples(index=False)]
            made = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], index=pdf.index, dtype=object) for n in names})
            yield pd.concat([pdf, made], axis=1)

    given = records.schema
    # read several times by what follows: parsed and written once
    return materialize(records.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given) + ", " + schema))


def resolved(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``refs`` (path, key, at, ...) with ``step``: that of the last definition (path, key, at, step) before each."""
    both = refs.withColumn("step", F.lit(None).cast("int")).withColumn("is_ref", F.lit(True)).unionByName(defs.withColumn("is_ref", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("path", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("step", F.last("step", ignorenulls=True).over(order)).where("is_ref").drop("is_ref", "at", "key")


def rows(steps: DataFrame, make: Callable[..., dict], *given: str) -> DataFrame:
    """path, error, activity: each row's step by ``make`` from the columns ``given``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for values in pdf[["path", "run_id", *given]].astype(object).itertuples(index=False):
                path, run_id, *own = (None if not isinstance(v, list) and pd.isna(v) else v for v in values)
                step = make(*own)
                row = recording.row(run_id, step["source"], step)
                out.append({"path": path, "error": None, "activity": {c: row[c] for c in COLUMNS}})
            if out:
                yield pd.DataFrame(out, columns=["path", "error", "activity"])

    return steps.select("path", "run_id", *given).mapInPandas(run, READ)
