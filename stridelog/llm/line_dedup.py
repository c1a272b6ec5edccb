"""Operator 12: line dedup over range-partitioned hashes.

Each line of a document gives one row: the hash of its key, the document, the
position. Rows are range-partitioned by all three, documents descending, and
sorted within partitions, so a very common line spreads over as many partitions
as it fills. A partition is streamed: the first document met for a hash is the
largest that holds it and keeps its lines; from the ``min_docs``-th on lines drop
at once; lines of the documents between wait until that many are seen. Only a
partition's first and last hash may go on elsewhere: their waiting lines leave
undecided, and a summary of ``min_docs`` documents at most, for each of the two,
settles them afterwards. What comes back is a compressed bitmap of the lines to
keep, for each document that loses any; texts are read again only to apply it.

Keys are equal when 128 bits of their SHA-256 are. Defined results: null and
empty text are one empty line; a null id counts as one document below every other;
rows that repeat an id are one document, and each is cut by its own text; rows that
repeat id and text share one bitmap; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .shared import materialize, partitions, slices, table, text_of

BLANK = " \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: A null id orders below all others.
NO_ID = -(2**63)
LINES = "h1 bigint, h2 bigint, doc bigint, k bigint, pos int"
#: say 0: the line drops; 1: it drops unless its document is the first of a hash, if the hash has enough; 2: a summary, with documents.
SAID = f"{LINES}, say int, docs array<bigint>"
DROPS, UNDECIDED, SUMMARY = range(3)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, k, text: ``k`` tells texts of one id apart."""
    return text_of(docs, id_col, text_col).select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("k"), "text")


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """LINES for every line whose key has ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = pc.split_pattern(batch.column("text"), "\n")
            counts = pc.list_value_length(lines).to_numpy()
            keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=BLANK))
            use = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(counts)), counts)[use]
            pos = use - (np.cumsum(counts) - counts)[row]
            digests = np.frombuffer(b"".join(hashlib.sha256(x.encode()).digest()[:16] for x in keys.take(pa.array(use)).to_pylist()), "<i8").reshape(-1, 2)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch.column("doc").take(at), batch.column("k").take(at), pa.array(pos, pa.int32())], ["h1", "h2", "doc", "k", "pos"])

    return _keyed(docs, id_col, text_col).select("doc", "k", "text").mapInArrow(run, LINES)


def stream(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """SAID of one partition's LINES, ordered by hash, then documents descending, then position.

    Rows of the hash that is open at a batch's end are carried to the next one only
    until its ``need``-th document is met: these are lines of fewer documents than that.
    """
    carry = over = None  # rows of the open hash; or that hash and its documents, once it has enough
    first = True  # the partition's first hash is not done yet
    sure = max(need - 1, 1)  # a line of this rank or more drops whatever came in other partitions
    for batch in batches:
        t = pa.Table.from_batches([batch]).combine_chunks() if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])]).combine_chunks()
        if not t.num_rows:
            continue
        h1, h2, doc = (t.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        new = np.ones(t.num_rows, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        starts = np.flatnonzero(new)
        run, met = np.cumsum(new) - 1, np.cumsum(other)
        rank = met - met[starts][run]  # how many documents of the hash come before this one
        ends = np.append(starts[1:], t.num_rows)
        enough = rank[ends - 1] >= sure
        said = np.full(t.num_rows, -1)
        said[(rank >= 1) & enough[run]] = DROPS
        begin, last, carry = 0, len(starts) - 1, None
        if over is not None and over[0] == (h1[0], h2[0]):  # goes on, and has enough already
            said[: ends[0]] = DROPS
            begin = 1
        if over is not None and begin <= last:  # it has ended
            if first:
                yield _summary(*over)
            over, first = None, False
        if first and begin == 0 and (last > 0 or enough[0]):
            said[: ends[0]] = np.where(rank[: ends[0]] >= sure, DROPS, UNDECIDED)
            if last > 0:
                yield _summary((h1[0], h2[0]), doc[: ends[0]][other[: ends[0]]][:need])
                first = False
        if begin <= last and enough[last]:
            over = (h1[-1], h2[-1]), doc[starts[last] :][other[starts[last] :]][:need]
        elif begin <= last:
            carry = t.slice(starts[last])
            said[starts[last] :] = -1
        yield _say(t, said)
    if carry is not None:
        h1, h2, doc = (carry.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        yield _say(carry, np.full(carry.num_rows, UNDECIDED))
        yield _summary((h1[0], h2[0]), -np.unique(-doc)[:need])
    elif over is not None:
        yield _summary(*over)


def _say(t: pa.Table, said: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(said >= 0)
    rows = t.take(pa.array(at)).combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(said[at], pa.int32()), pa.nulls(len(at), pa.list_(pa.int64()))], [*t.column_names, "say", "docs"])


def _summary(key: tuple, docs: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([int(key[0])]), pa.array([int(key[1])]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([SUMMARY], pa.int32()), pa.array([[int(d) for d in docs]], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc", "k", "pos", "say", "docs"])


@F.pandas_udf(BinaryType())
def keep_bitmap(dropped: pd.Series) -> pd.Series:
    """A bit for each line up to the last one dropped, compressed; lines after it stay."""

    def bits(at: np.ndarray) -> bytes:
        keep = np.ones((at.max() // 8 + 1) * 8, np.uint8)
        keep[at] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return dropped.map(bits)


@F.pandas_udf(StringType())
def kept_lines(text: pd.Series, keep: pd.Series) -> pd.Series:
    """``text`` by its bitmap; null where there is none."""

    def cut(t: str, bitmap: bytes) -> str:
        lines = t.split("\n")
        keep = np.ones(len(lines), bool)
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
        keep[: len(bits)] = bits
        return "\n".join(lines[i] for i in np.flatnonzero(keep))

    return pd.Series([None if b is None else cut(t, b) for t, b in zip(text, keep)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, k, n_dropped, keep: for each text that loses lines."""
    rows = materialize(line_rows(docs, min_chars, id_col, text_col))  # read twice: range partitioning samples it
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos")]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    said = materialize(dealt.mapInArrow(lambda batches: stream(batches, min_docs), SAID))
    # two rows a partition at most, of min_docs documents each
    whole = said.where(F.col("say") == SUMMARY).groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("all"))
    common = whole.where(F.size("all") >= min_docs).select("h1", "h2", F.array_max("all").alias("keeper"))
    late = said.where(F.col("say") == UNDECIDED).join(F.broadcast(common), ["h1", "h2"]).where("doc != keeper")
    drops = said.where(F.col("say") == DROPS).select("doc", "k", "pos").unionByName(late.select("doc", "k", "pos"))
    return drops.groupBy("doc", "k").agg(F.collect_set("pos").alias("at")).select("doc", "k", F.size("at").cast("bigint").alias("n_dropped"), keep_bitmap("at").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, keep, text (what stays of it) for every row of ``docs``."""
    keyed = _keyed(docs, id_col, text_col).join(bitmaps.hint("merge"), ["doc", "k"], "left")
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    kept = kept_lines(F.when(F.col("keep").isNotNull(), F.col("text")), "keep")
    return keyed.select("doc_id", lines.cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep", F.coalesce(kept, F.col("text")).alias("text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc) >= 3),
s AS (SELECT r, line, pos, coalesce(doc != keeper, false) AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM s JOIN d USING (r) GROUP BY r, doc_id
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
