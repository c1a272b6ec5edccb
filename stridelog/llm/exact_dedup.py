"""Operator 9: exact dedup by distributed MSD radix partitioning.

Documents are split by successive runs of bytes, each ``GROWTH`` times as long
as the one before. A document leaves when its group is a single row, or when its
bytes have ended: those that end in the same group are equal, byte for byte, and
no digest takes part (the text's hash is a result, and tells rows of one doc_id
apart). A pass reads only its own run of bytes, so no byte is dealt out by id more
than once. Each pass counts groups with partial aggregates before the shuffle and
joins the counts back through a table in the shared folder, so the join sees two
plain exchanges and adaptive execution can split a hot group.

Defined results: null text counts as empty, empty texts equal each other; of
equal texts the row with the largest doc_id stays (a null id only if no other
has one); rows that repeat a doc_id with equal text share one decision; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table, text_of

FIRST, GROWTH = 64, 16

SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def equal_groups(docs: DataFrame, first: int = FIRST, growth: int = GROWTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size for every row."""
    text = F.col("text").cast("binary")
    rows = text_of(docs, id_col, text_col).select("doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("bytes"))
    out, left, at, width = [], None, 0, first
    while True:
        digit = rows.where(F.octet_length("bytes") > at) if at else rows
        digit = digit.select("doc_id", "text_sha256", F.substring("bytes", at + 1, width).alias("digit"), (F.octet_length("bytes") <= at + width).alias("ended"))
        if left is None:
            digit = digit.withColumn("path", F.lit(0).cast("bigint"))
        else:
            own = left.select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"), F.col("next").alias("path")).distinct()
            digit = materialize(digit.join(own.hint("merge"), digit["doc_id"].eqNullSafe(own["i"]) & (digit["text_sha256"] == own["s"])).drop("i", "s"))
        keys = ["path", "digit", "ended"]
        groups = digit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("most")).where("n > 1")
        # a group of one row needs no join back: only the others are written
        shared = materialize(groups.withColumn("next", F.monotonically_increasing_id()))
        seen = materialize(digit.join(shared.hint("merge"), keys, "left").select("doc_id", "text_sha256", "ended", "n", "most", "next"))
        more = F.col("n").isNotNull() & ~F.col("ended")
        out.append(seen.where(~more).select("doc_id", "text_sha256", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("most")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size")))
        left = seen.where(more)
        if left.isEmpty():
            break
        at, width = at + width, width * growth
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return equal_groups(docs, id_col=id_col, text_col=text_col).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
