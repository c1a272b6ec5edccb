"""Operator 5: toxicity from subword bags.

A word is the bag of its character n-grams and itself, hashed into rows of one
embedding table; the bag's mean goes through a linear softmax. Table and softmax
are trained jointly in numpy from document labels: a document is clean if all of
its words are and toxic if any is (noisy-or over distinct words), so misspellings
that share n-grams with toxic words share their vectors. A document's score is
that of its strongest word: one insult in a long text counts as in a short one, where
an average of all words would lose it (``pool="mean"`` trains and scores that way; the
README has held-out figures of both). Of toxic labels a share of ``LEAK`` needs no
toxic word, or wrong labels would be learnt from words that stand there by chance.

Training reads a bounded sample of labelled documents: those with the smallest
hash of their id, at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` of the classes, of at
most ``TRAIN_CHARS`` characters. N-grams of few of them (``MIN_DOCS``) carry
no weight, or single documents would be learnt by heart. These bounds are
parameters. Scoring reads every whole text of every document: runs without white
space of over ``MAX_WORD`` characters are divided at inner punctuation, and what is
still longer into pieces that overlap by half; each piece is a word.

Defined results: null and empty texts score as a document without words, close
to 0; null ids stay null and are not held out; labels that are null are not
learnt from; without labels of both classes every score is 0; repeated rows
repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_of

BUCKETS, DIM, GRAMS = 2**20, 4, (3, 4, 5, 6)
TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 1500, 4000, 12_000
#: Documents that an n-gram must be in: one for each eight toxic ones, between these.
MIN_DOCS = (2, 6)
#: Share of toxic labels that no word of the document need explain: wrong labels are not learnt from chance words.
LEAK = 0.3
EPOCHS, SEED = 25, 7
THRESHOLD, MAX_WORD = 0.7, 40
#: A document from its words: "any" of them makes it toxic, or their "mean".
POOL = "any"
#: What may stand at either end of a word without being part of it.
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—*_~`#|/\\"
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


_INNER = re.compile(f"[{re.escape(EDGES)}=&%+@$^]+")


def _pieces(run: str) -> list[str]:
    """A long run's parts between punctuation, of ``MAX_WORD`` characters at most."""
    step = MAX_WORD // 2
    return [p[k : k + MAX_WORD] for p in _INNER.split(run) for k in range(0, max(1, len(p) - step), step)]


def words_of(text: str) -> set[str]:
    """Distinct words, lower case, without outer punctuation."""
    words = {w.strip(EDGES) for w in text.lower().split()}
    if long := [w for w in words if len(w) > MAX_WORD]:
        words.difference_update(long)
        words.update(p for w in long for p in _pieces(w))
    return words - {""}


def grams_of(word: str, buckets: int = BUCKETS) -> list[int]:
    """Hashed rows of a word: itself and its n-grams, marked at both ends."""
    raw = f"<{word}>"
    parts = [raw[i : i + n] for n in GRAMS for i in range(len(raw) - n + 1)]
    return [zlib.crc32(p.encode()) % buckets for p in parts] + [zlib.crc32(b"\0" + word.encode()) % buckets]


class Model:
    """Per row its part in the logit of class 1; ``bias`` of the softmax; how words make a document."""

    def __init__(self, rows: np.ndarray, bias: float, pool: str = "any"):
        self.rows, self.bias, self.pool = rows, bias, pool

    def of_document(self, logits: list[float]) -> float:
        """The score from its distinct words' logits."""
        z = -20.0 if not logits else max(logits) if self.pool == "any" else sum(logits) / len(logits)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        bags = [grams_of(w, len(self.rows)) for w in words]
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        flat = np.fromiter((g for b in bags for g in b), np.int64, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.rows[flat], starts) / sizes + self.bias


def _any_of(p: np.ndarray, first: np.ndarray, y: np.ndarray, leak: float) -> np.ndarray:
    """d loss / d logit of each word over its p: 1 in a clean document, -clean / (1 - clean) in a toxic one."""
    clean = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-7)), first))  # no word is toxic
    clean = np.where(y > 0, (1 - leak) * clean, clean)
    return np.where(y > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0)


def train(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = SEED, min_docs: int | None = None, leak: float = LEAK, pool: str = POOL) -> Model:
    """Joint training of the embedding table and the softmax by Adam, all documents in each step."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(buckets), -20.0)
    if min_docs is None:
        min_docs = int(np.clip(labels.sum() // 8, *MIN_DOCS))
    index: dict[str, int] = {}
    docs = [np.array(sorted(index.setdefault(w, len(index)) for w in words_of(t)), np.int64) for t in texts]
    rows_, n_rows = array("i"), array("i")
    for w in index:  # flat arrays: lists of numbers would take several times the memory
        bag = grams_of(w, buckets)
        rows_.extend(bag)
        n_rows.append(len(bag))
    flat, sizes = np.frombuffer(rows_, np.int32), np.frombuffer(n_rows, np.int32)
    word_of_gram = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    in_docs = np.zeros(buckets, np.int64)
    for d in docs:
        in_docs[np.unique(np.concatenate([flat[begin[w] : begin[w + 1]] for w in d.tolist()] or [flat[:0]]))] += 1
    known = in_docs[flat] >= min_docs
    used = np.flatnonzero(in_docs >= min_docs)
    place = np.zeros(buckets, np.int32)
    place[used] = np.arange(len(used))
    flat, word_of_gram = place[flat[known]], word_of_gram[known]
    del rows_, index, known  # the driver's memory is for the training below
    some = np.array([len(d) > 0 for d in docs])
    if not len(used) or not some.any():  # nothing that documents share
        return Model(np.zeros(buckets), -20.0)
    word = np.concatenate([d for d in docs])
    n_words = np.array([len(d) for d in docs])[some]
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    y = labels[some].astype(np.float64)
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.3, (len(used), dim)).astype(np.float32)
    V = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)  # softmax weights of both classes
    bias = np.array([3.0, -3.0])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, V, bias)]
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for step in range(1, epochs + 1):
        mean = np.stack([np.bincount(word_of_gram, weights=E[:, k][flat], minlength=len(sizes)) / sizes for k in range(dim)], axis=1)
        z = mean @ V + bias
        logit = (z[:, 1] - z[:, 0])[word]
        if pool == "mean":  # a document is the average of its words
            of_doc = np.add.reduceat(logit, first) / n_words
            factor = (1 / (1 + np.exp(-np.clip(of_doc, -30, 30))) - y) * weight / n_words
            p = 1.0
        else:
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            factor = _any_of(p, first, y, leak) * weight
        g_word = np.bincount(word, weights=np.repeat(factor, n_words) * p, minlength=len(sizes)) / len(y)
        g_z = np.stack([-g_word, g_word], axis=1)
        g_mean = (g_z @ V.T) / sizes[:, None]
        g_E = np.stack([np.bincount(flat, weights=g_mean[:, k][word_of_gram], minlength=len(used)) for k in range(dim)], axis=1).astype(np.float32)
        for p_, g, (m, v) in zip((E, V, bias), (g_E, mean.T @ g_z, g_z.sum(0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p_ -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    rows = np.zeros(buckets)
    rows[used] = E @ (V[:, 1] - V[:, 0])
    return Model(rows, float(bias[1] - bias[0]), pool)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_DOCS, clean: int = CLEAN_DOCS, chars: int = TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled rows outside the held-out fold, by hash of the id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = text_of(docs).withColumn("key", F.xxhash64("text"))
    short = own.where(F.length("text") <= chars).select("doc_id", "key")
    # of clashing labels the highest, of texts of one id that of the smallest key
    both = short.join(known, "doc_id").groupBy("doc_id").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = both.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(both.where("toxic = 0").orderBy(*order).limit(clean)).collect()
    # some thousands of ids at most: the texts themselves are never shuffled
    picked = docs.sparkSession.createDataFrame(chosen, both.schema)
    rows = own.join(F.broadcast(picked), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[2], r[1]))  # training must not depend on the order of arrival
    return [r[1] for r in rows], np.array([r[2] for r in rows])


def _scorer(docs: DataFrame, model: Model):
    """A function from texts to scores, for executors; it remembers words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.rows.astype(np.float32), model.bias, model.pool))  # buckets * 4 bytes: fixed

    def start():
        own = Model(*shared.value)
        known: dict[str, float] = {}

        def one(text: str) -> float:
            words = words_of(text)
            if len(known) > 200_000:
                known.clear()
            new = [w for w in words if w not in known]
            known.update(zip(new, own.logits(new).tolist(), strict=True))
            return own.of_document([known[w] for w in sorted(words)])

        return one

    return start


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; one narrow pass."""
    scorer = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer()
        for batch in batches:
            scores = [one(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = text_of(docs, id_col, text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns pass through unread."""
    scorer, at = _scorer(docs, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer()
        for batch in batches:
            clean = [one(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labelled_docs`` with ``labels``, score ``docs``."""
    return score(docs, train(*training_rows(labelled_docs, labels)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, docs, table(spark, sf_dir, "labels"))
