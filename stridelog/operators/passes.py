"""One ordered pass over rows of a key, carrying state from batch to batch.

Rows of a key meet in one task in order and stream through it: what stays in memory is
the state, not the key's rows, so a key of any length costs time in proportion only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def in_order(rows: DataFrame, keys: list[str], order: list[str], step: Callable[..., tuple], start: Callable[[], object], schema: str) -> DataFrame:
    """``step(state, *values)`` gives the next state and a row of ``schema`` for each row; ``start()`` begins a key. ``values`` are the columns of ``rows``."""
    at = [rows.columns.index(k) for k in keys]
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state = None
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(values[i] for i in at)
                if key != own:
                    own, state = key, start()
                state, row = step(state, *values)
                out.append(row)
            yield _batch(out, types)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns: Iterable = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)
