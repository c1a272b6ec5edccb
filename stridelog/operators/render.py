"""Small aggregates as text: TSV, Markdown and sorted JSON, made on the driver.

Only finished reports come here, whose rows number runs shown or groups counted.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Any) -> str:
    """A value within one cell: no tabs or line ends; lists by commas, nothing as a dash."""
    if value is None or value == []:
        return "-"
    if isinstance(value, list):
        return ",".join(map(str, value))
    return f"{value:.3f}" if isinstance(value, float) else str(value).replace("\t", " ").replace("\r", " ").replace("\n", " ")


def rate(n: Column, d: Column) -> Column:
    """n/d (0.000), or NA."""
    return F.when(d == 0, "NA").otherwise(F.format_string("%d/%d (%.3f)", n, d, (n / d).cast("double")))


def tsv(df: DataFrame, *order: str) -> str:
    rows = df.orderBy(*order).collect() if order else df.collect()
    return "\n".join(["\t".join(df.columns), *("\t".join(map(cell, r)) for r in rows)])


def markdown(title: str, df: DataFrame, *order: str) -> str:
    rows = df.orderBy(*order).collect() if order else df.collect()
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *(line(map(cell, r)) for r in rows), ""])


def as_json(**tables: DataFrame) -> str:
    """Named tables, keys and rows sorted: the same bytes for the same result."""
    out = {k: sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: json.dumps(r, sort_keys=True, default=str)) for k, df in tables.items()}
    return json.dumps(out, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def narrative(replayed: DataFrame, localizations: DataFrame) -> str:
    """What happened in each run, in words."""
    breaks: dict[str, list] = {}
    for r in localizations.orderBy("run_id", "breaking_step").collect():
        breaks.setdefault(r.run_id, []).append(r)
    out = []
    for r in replayed.orderBy("run_id").collect():
        d = r.asDict()
        kinds = ", ".join(f"{n} {k}" for k, n in d.items() if n and k in ("user_msg", "llm_call", "tool_call", "file_edit", "test_run", "opaque_shell", "unmapped", "verdict"))
        out.append(f"run {r.run_id}: {kinds}")
        out += [f"  {g.upper()}: {d[f'{g}_pass']} pass, {d[f'{g}_fail']} fail, {d[f'{g}_na']} not judged" for g in ("g1", "g2", "g3")]
        for b in breaks.get(r.run_id, []):
            out.append(f"  breaks at step {b.breaking_step} ({b.breaking_gate}, {b.confidence}: {b.coverage}); cascade {cell(b.cascade)}; candidates {cell(b.candidates)}")
        if r.run_id not in breaks:
            out.append("  no visible break")
    return "\n".join(out)
