"""Operator 2: SimHash near-duplicates behind a pigeonring filter.

A fingerprint is cut into ``segments`` on a ring. If two differ in at most
``limit`` bits, some segment starts a chain whose running differences stay within
proportional budgets: l segments differ in at most l * limit / segments bits.

With 64 bits, 5 segments and 4 bits the first segment of a chain is equal, so equal
segments are the first buckets. A bucket of over ``cap`` rows is keyed by more of
the chain: its next two segments differ in 2 bits at most, so of their four quarters
two are equal; each pair of quarters makes a bucket of 25 bits (6 rows for one).
What is still large is compared in pairs of blocks. Candidates must hold the whole
chain before the full Hamming check. No pair is lost at any step.

The pipeline's stage (``near_duplicates``) links the pairs whose distinct five-word
shingles have a Jaccard similarity of at least ``SIMILARITY``, and no others. Pairs
of that similarity differ in up to a fourth of their bits, where no segment need be
equal, so buckets are the ``LEAST`` smallest shingle hashes of a document: each of
the least hashes of a pair's union is shared with a probability of 0.8 or more, so
all are missed with 0.2**16 at most, and never where fewer than 16 shingles are not
shared. A hash that is among the ``DEPTH`` smallest of over ``cap`` documents is
common (a licence's line, a quoted passage) and would make a bucket that grows with
the table, so it is a key of those documents only that hold little else. Where
``RARE`` of a document's ``DEPTH`` smallest are not common, the ``MORE`` smallest of
these are its keys: a share r of a pair's union that is not common is shared with
1 - 0.2 / r or more, and (0.2 / r)**20 times the probability that 36 of 48 are not
common is below 0.2**16 at any r (taken as independent draws: an estimate, also for
a pair of one document of this kind and one of the other). Other documents have the ``LEAST`` smallest as
keys, common or not, and all of the ``DEPTH`` that are not. In the buckets the pigeonring filter, with chains of ``CHAIN`` of 16
segments, and the full Hamming check (over five deviations beyond the worst pair of
the similarity) leave candidates; groups of these meet with their texts, and every
pair in them that is not connected yet is held to the exact similarity.

Defined results: null and empty texts have fingerprint zero and link like any
other; a row of null id links like any other but names no component: a component
without other ids has null; rows that repeat an id are nodes of their own by their
texts; repeated rows repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import deal, in_blocks, linked, pairs, units
from .components import components
from .shared import materialize, table, text_of


class Scheme(NamedTuple):
    shingle: int
    bits: int
    segments: int
    limit: int


#: The contract's: lossless.
NARROW = Scheme(shingle=4, bits=64, segments=5, limit=4)
#: The pipeline's: a pair of the similarity expects 77 differing bits, or 96 if one document has 4 shingles and the other 5.
WIDE = Scheme(shingle=5, bits=512, segments=16, limit=144)
CHAIN = 4
SEED, CAP = 42, 1024
#: The pipeline's similarity as a fraction; least hashes that are keys, looked at, and keys where some are common; the fraction of these that is rare then.
SIMILARITY, LEAST, DEPTH, MORE, RARE = (4, 5), 16, 48, 20, (3, 4)
#: Rows of a block whose rows carry texts.
TEXT_CAP = 1024
#: Shingles whose bits are added up at once: counts stay within a byte.
_ROWS = 255


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of all words if there are fewer."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n) + np.arange(len(n))
    starts = (ends - n)[: len(n) - k + 1].tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def _widened(h: np.ndarray, words: int) -> np.ndarray:
    """Further words of bits from a hash, by an invertible mix; the first is the hash itself."""
    out = np.empty((len(h), words), ">u8")
    out[:, 0] = h
    for j in range(1, words):
        z = h + np.uint64((j * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, j] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str, k: int = NARROW.shingle, bits: int = 64) -> bytes:
    """Big-endian; a bit is set if over half of the shingles' hashes have it."""
    return _majority(shingle_hashes(text, k), bits)


def _majority(h: np.ndarray, bits: int) -> bytes:
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(h), 64 * _ROWS):  # bounded memory for very long texts
        raw = _widened(h[at : at + 64 * _ROWS], bits // 64).view(np.uint8).reshape(-1, bits // 8)
        for r in range(0, len(raw), _ROWS):
            ones += np.add.reduce(np.unpackbits(raw[r : r + _ROWS], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprints(docs: DataFrame, scheme: Scheme = NARROW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, scheme.shingle, scheme.bits) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "fp"])

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp binary")


def _words(column, scheme: Scheme) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(chunk.to_pylist()), ">u8").astype(np.uint64).reshape(-1, scheme.bits // 64)


def _span(scheme: Scheme, i: int) -> tuple[int, np.uint64, np.uint64]:
    """Word, shift and mask of a segment; segments do not straddle words."""
    a, b = i * scheme.bits // scheme.segments, (i + 1) * scheme.bits // scheme.segments
    word = a // 64
    assert (b - 1) // 64 == word
    return word, np.uint64(64 * (word + 1) - b), np.uint64(2 ** (b - a) - 1)


def _bucketed(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """A row per class and segment; segments * 2**width keys at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                fp = _words(part.column(1), scheme)
                for i in range(scheme.segments):
                    word, shift, mask = _span(scheme, i)
                    bucket = ((fp[:, word] >> shift) & mask).astype(np.int64) | (i << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column(0), part.column(1)], ["bucket", "node", "fp"])

    return classes.select("node", "fp").mapInArrow(run, "bucket bigint, node bigint, fp binary")


def _further(heavy: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows of heavy buckets, keyed by pairs of equal parts of the chain's next two segments too.

    These differ in ``budget`` bits at most, so of ``budget + 2`` parts two are equal.
    """
    budget = 3 * scheme.limit // scheme.segments
    spans = [_span(scheme, i) for i in range(scheme.segments)]
    width = [int(m).bit_length() for _, _, m in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                bucket, fp = part.column(0).to_numpy(), _words(part.column(2), scheme)
                for i in np.unique(bucket >> 32).tolist():
                    own = np.flatnonzero(bucket >> 32 == i)
                    a, b = (i + 1) % scheme.segments, (i + 2) % scheme.segments
                    (wa, sa, ma), (wb, sb, mb) = spans[a], spans[b]
                    both = ((fp[own, wa] >> sa & ma).astype(np.int64) << width[b]) | (fp[own, wb] >> sb & mb).astype(np.int64)
                    cuts = [k * (width[a] + width[b]) // (budget + 2) for k in range(budget + 3)]
                    parts = [both >> lo & (1 << hi - lo) - 1 for lo, hi in zip(cuts, cuts[1:], strict=False)]
                    for c, (x, y) in enumerate(combinations(range(budget + 2), 2)):
                        key = (((bucket[own] & 0x1FFF) << 7 | parts[x]) << 7 | parts[y]) | c << 27 | i << 32 | 1 << 40
                        yield pa.RecordBatch.from_arrays([pa.array(key), part.column(1).take(pa.array(own)), part.column(2).take(pa.array(own))], ["bucket", "node", "fp"])

    return heavy.select("bucket", "node", "fp").mapInArrow(run, "bucket bigint, node bigint, fp binary")


def _by_chains(classes: DataFrame, scheme: Scheme, cap: int) -> DataFrame:
    """Buckets by the first segment, and by more of the chain where these are heavy."""
    rows = _bucketed(classes, scheme)
    heavy = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select(F.col("bucket").alias("heavy"))
    told = rows.join(F.broadcast(heavy), rows["bucket"] == heavy["heavy"], "left")  # segments * 2**13 keys at most
    return told.where("heavy IS NULL").drop("heavy").unionByName(_further(told.where("heavy IS NOT NULL"), scheme))


def _near(scheme: Scheme):
    spans = [_span(scheme, i) for i in range(scheme.segments)]
    masks = np.array([m << s for _, s, m in spans], np.uint64)
    word = np.array([w for w, _, _ in spans])

    def near(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fp = _words(t.column("fp"), scheme)
        first = (t.column("bucket").to_numpy() >> 32 & 0xFF)[i]
        differ = np.zeros(len(i), np.int64)
        left = np.arange(len(i))
        for l in range(1, scheme.segments):  # the chain, segment by segment
            s = (first[left] + l) % scheme.segments
            x = (fp[i[left], word[s]] ^ fp[j[left], word[s]]) & masks[s]
            differ = differ + np.bitwise_count(x)
            ok = differ <= (l + 1) * scheme.limit // scheme.segments
            left, differ = left[ok], differ[ok]
            if not len(left):
                break
        full = np.bitwise_count(fp[i[left]] ^ fp[j[left]]).sum(axis=1, dtype=np.int64) <= scheme.limit
        out = np.zeros(len(i), bool)
        out[left[full]] = True
        return out

    return near


def _named(classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key`` and the first row (by id, null last, then text) of each class's component. ``classes``: node, key, first."""
    own = classes.select("node", F.col(key).alias("own_key"), "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = own.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("chosen"))
    return own.join(first, F.col("component") == F.col("c")).select("own_key", F.col("chosen.doc_id").alias("component_id"), F.col("chosen.k").alias("chosen_k"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k")).alias("first")


def _numbered(classes: DataFrame) -> DataFrame:
    """A node per class, fixed once it is written."""
    return materialize(classes.withColumn("node", F.monotonically_increasing_id()))


def simhash_groups(docs: DataFrame, scheme: Scheme = NARROW, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row."""
    assert scheme.limit < scheme.segments, "the first segment of a chain must be equal"
    rows = materialize(fingerprints(docs, scheme, id_col, text_col))
    classes = _numbered(rows.withColumn("k", F.lit(0)).groupBy("fp").agg(_first()))
    found = components(linked(deal(in_blocks(_by_chains(classes, scheme, cap), 4 * cap)), _near(scheme)))
    named = _named(classes, found, "fp")
    return rows.join(named, F.col("fp") == F.col("own_key")).select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, scheme: Scheme = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k (the text's hash), digest, n, least and fp of each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, least, fps = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = np.unique(shingle_hashes(text, scheme.shingle))
                digests.append(xxhash.xxh3_128_digest(h.tobytes(), SEED))
                sizes.append(len(h))
                least.append(h[:DEPTH].tobytes())
                fps.append(_majority(h, scheme.bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.binary()), pa.array(fps, pa.binary())], ["doc_id", "k", "digest", "n", "least", "fp"])

    return text_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("k"), "text").mapInArrow(run, "doc_id bigint, k bigint, digest binary, n bigint, least binary, fp binary")


def _chosen(least: np.ndarray, common: list[int] | None) -> np.ndarray:
    """A class's keys of its least hashes, of which some are common."""
    if common is None:
        return least[:LEAST]
    rare, (some, of) = ~np.isin(least, common), RARE
    if of * np.count_nonzero(rare) >= some * len(least):
        return least[rare][:MORE]
    return least[rare | (np.arange(len(least)) < LEAST)]


def _by_least(classes: DataFrame, cap: int) -> DataFrame:
    """A row per class and key."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                least = batch.column(1).slice(at, 1000).to_pylist()
                own = pa.array(np.repeat(np.arange(len(least)), [len(x) // 8 for x in least]))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(least), np.int64)), batch.column(0).slice(at, 1000).take(own)], ["bucket", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = [_chosen(np.frombuffer(x, np.int64), c) for x, c in zip(part.column(1).to_pylist(), part.column(4).to_pylist(), strict=True)]
                own = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[part.column(c).take(own) for c in (0, 2, 3)]], ["bucket", "node", "n", "fp"])

    each = classes.select("node", "least").mapInArrow(listed, "bucket bigint, node bigint")
    common = materialize(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > cap).select("bucket"))  # small: the optimizer sees its size
    held = each.join(common, "bucket").groupBy("node").agg(F.collect_list("bucket").alias("common"))
    return classes.select("node", "least", "n", "fp").join(held, "node", "left").mapInArrow(run, "bucket bigint, node bigint, n bigint, fp binary")


def _candidates(scheme: Scheme):
    """Sizes that allow the similarity, then the pigeonring's chains, then all bits."""
    (above, below), half = SIMILARITY, scheme.bits // scheme.segments

    def near(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fp, n = _words(t.column("fp"), scheme), t.column("n").to_numpy()
        left = np.flatnonzero(below * np.minimum(n[i], n[j]) >= above * np.maximum(n[i], n[j]))
        out = np.zeros(len(i), bool)
        for at in range(0, len(left), 100_000):
            own = left[at : at + 100_000]
            x = (fp[i[own]] ^ fp[j[own]]).view(f"u{half // 8}")  # two segments a word: their order on the ring is the same for all
            differ = np.bitwise_count(x).astype(np.int16)
            ring = np.concatenate([differ, differ[:, : CHAIN - 1]], axis=1)
            chain, holds = np.zeros_like(differ), np.ones(differ.shape, bool)
            for l in range(CHAIN):
                chain = chain + ring[:, l : l + scheme.segments]
                holds &= chain <= (l + 1) * scheme.limit // scheme.segments
            some = holds.any(axis=1)
            out[own[some]] = differ[some].sum(axis=1) <= scheme.limit
        return out

    return near


def _similar(dealt: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b: forests of the pairs of rows with text whose distinct shingles are similar enough."""
    near, (above, below) = _candidates(scheme), SIMILARITY

    def edges(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.unique(shingle_hashes(x, scheme.shingle)) for x in t.column("text").to_pylist()]
        n = np.array([len(h) for h in sets])
        values, rank = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(n)])
        mark, label = np.zeros(len(values), bool), np.arange(len(sets))
        for i, j in pairs(t):
            kept = label[i] != label[j]
            i, j = i[kept], j[kept]
            kept = near(t, i, j)
            i, j = i[kept], j[kept]
            for a, b in zip(starts := np.flatnonzero(np.diff(i, prepend=-1)), [*starts[1:], len(i)], strict=True):
                one, others = i[a], j[a:b]
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                mark[rank[at[one] : at[one + 1]]] = True
                shared = np.array([np.count_nonzero(mark[rank[at[x] : at[x + 1]]]) for x in others.tolist()])
                mark[rank[at[one] : at[one + 1]]] = False
                yes = others[below * shared >= above * (n[one] + n[others] - shared)]
                if len(yes):
                    label[np.isin(label, label[yes])] = label[one]
        moved = np.flatnonzero(label != np.arange(len(label)))
        return moved, label[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches, 1000):
            node, (a, b) = t.column("node").to_numpy(), edges(t)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, scheme: Scheme = WIDE, cap: int = CAP, text_cap: int = TEXT_CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k, component_id, kept for every row: components of the pairs of ``SIMILARITY`` or more.

    ``k`` is xxhash64 of the row's text. Of a component the row of the smallest id (null last), and of its
    texts the one of the smallest k, is kept.
    """
    rows = materialize(shingle_sets(docs, scheme, id_col, text_col))
    classes = _numbered(rows.groupBy("digest", "n", "least", "fp").agg(_first()))
    groups = components(linked(deal(in_blocks(_by_least(classes, cap), cap)), _candidates(scheme)))
    members = materialize(classes.join(groups, "node").select(F.col("component").alias("bucket"), "node", "n", "fp", F.col("first.doc_id").alias("i"), F.col("first.k").alias("k")))
    texts = text_of(docs, id_col, text_col).withColumn("tk", F.xxhash64("text"))
    brought = in_blocks(members, text_cap).join(texts, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tk"))).drop("i", "k", "doc_id", "tk")
    named = _named(classes, components(_similar(deal(brought), scheme)), "digest")
    joined = rows.select("doc_id", "k", "digest").join(named, F.col("digest") == F.col("own_key"))
    return joined.select("doc_id", "k", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("k") == F.col("chosen_k"))).alias("kept"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
