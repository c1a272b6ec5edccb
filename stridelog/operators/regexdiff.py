"""Differential check of regex match modes: does a search find what a full match finds?"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Inputs tried with every generated set, how many inputs at most, and how much of a pattern's own text counts.
SEEDS = ("", "a", "b", "0", " ", "x", "xx")
GENERATED, LITERAL = 24, 8
OBSERVED = "search boolean, full boolean, error string"


def generate_inputs(pattern: str, n: int = GENERATED) -> list[str]:
    """Seeds; the pattern's literal, its ends, between neighbours and doubled; its characters, and two of them in turn. First occurrences, cut at n."""
    said = [m[1] or m[0] for m in re.finditer(r"(?s)\\(.)|[^\\]", pattern) if m[1] or m[0].isalnum() or m[0] in " _-"]
    lit = "".join(said[:LITERAL])
    own = [lit, lit[:1], lit[-1:], f"x{lit}", f"{lit}x", f"x{lit}x", lit * 2] if lit else []
    chars = list(dict.fromkeys(lit))
    pairs = [chars[0] + chars[1], chars[1] + chars[0], chars[0] * 2] if len(chars) > 1 else []
    return list(dict.fromkeys([*SEEDS, *own, *chars, *pairs]))[: max(0, n)]


def observe(pairs: DataFrame, dialect: str = "python") -> DataFrame:
    """Adds search, full, error to pattern, input. ``python`` asks re; ``native`` stays in the JVM."""
    if dialect == "native":
        return pairs.withColumn("search", F.regexp_like("input", F.col("pattern"))).withColumn("full", F.regexp_like("input", F.concat(F.lit(r"\A(?:"), F.col("pattern"), F.lit(r")\z")))).withColumn("error", F.lit(None).cast("string"))

    def run(patterns: pd.Series, inputs: pd.Series) -> pd.DataFrame:
        out = []
        for p, x in zip(patterns, inputs, strict=True):
            try:
                own = re.compile(p)
                out.append((own.search(x) is not None, own.fullmatch(x) is not None, None))
            except re.error as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["search", "full", "error"])

    return pairs.withColumn("o", F.pandas_udf(run, OBSERVED)("pattern", "input")).select(*pairs.columns, "o.*")


def observations(patterns: DataFrame, inputs: DataFrame, dialect: str = "python") -> DataFrame:
    """pattern_id, pattern, pos, input, search, full, agree: the few patterns meet every input.

    Patterns are a written list of some kilobytes, so they are what is sent around.
    """
    both = inputs.select("pos", "input").join(F.broadcast(patterns.select("pattern_id", "pattern")))
    return observe(both, dialect).withColumn("agree", F.col("search") == F.col("full"))


def as_activities(observed: DataFrame) -> DataFrame:
    """Observations as a chain of test runs: agreement exits 0."""
    w = Window.partitionBy("pattern_id").orderBy("pos")
    step = F.row_number().over(w) - 1
    rows = observed.where("error IS NULL").withColumn("step", step)
    from ..schema import complete

    return complete(rows.select(
        F.concat(F.lit("regex-"), "pattern_id").alias("run_id"), F.lit("regex").alias("source"), F.col("step").alias("pos"), F.col("step").alias("step_index"), F.lit("").alias("ts"), F.lit("test_run").alias("kind"),
        F.lit("Bash").alias("tool_name"), F.lit("shell").alias("target"), F.when(F.col("step") > 0, F.col("step") - 1).alias("parent_step"), F.concat(F.lit("regex "), "pattern_id").alias("command"),
        F.when(F.col("agree"), 0).otherwise(1).alias("exit_code"), F.when(F.col("agree"), "1 passed").otherwise("1 failed").alias("test_text"),
    ))


def summary(observed: DataFrame) -> DataFrame:
    """Per pattern: tried, agreeing, and the first input on which the modes part."""
    return observed.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("inputs"), F.count_if("agree").alias("agreeing"), F.min(F.when(~F.col("agree"), F.col("pos"))).alias("first_divergence"),
        F.when(F.count_if(F.col("error").isNotNull()) > 0, "unsupported").when(F.count_if(~F.col("agree")) > 0, "divergent").otherwise("agree").alias("status"),
    )
