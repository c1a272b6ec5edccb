"""The normalized table of activities: one row per recorded step of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of activity.
KINDS = ("user_msg", "llm_call", "tool_call", "file_edit", "test_run", "opaque_shell", "unmapped", "verdict")
ACTION_KINDS = ("tool_call", "file_edit", "test_run", "opaque_shell", "unmapped")
GATES = ("G1", "G2", "G3")

ACTIVITIES = (
    "run_id string, source string, pos int, step_index int, ts string, kind string, tool_name string, target string, parent_step int, "
    "inputs_json string, outputs_json string, content_hash string, file_path string, old_string string, new_string string, pattern string, "
    "command string, write_mode boolean, edits array<struct<old_string:string,new_string:string>>, edits_is_list boolean, exit_code int, test_text string"
)
COLUMNS = [c.strip().split(" ")[0] for c in ACTIVITIES.replace("array<struct<old_string:string,new_string:string>>", "x").split(",")]


def checked_kind(kind: Column) -> Column:
    """The kind; any other value fails the query."""
    return F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("invalid activity kind: "), kind)).cast("string"))


def complete(df: DataFrame) -> DataFrame:
    """All columns of the schema, in order; those that ``df`` lacks are null of their type."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ACTIVITIES)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
