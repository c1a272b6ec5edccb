"""Rounds of packing."""

import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stridelog.llm import packing
from stridelog.llm.shared import materialize


def test_rounds_go_on_while_they_save_bins(spark, monkeypatch):
    rounds = []

    def pack(r, capacity):
        """Two partitions with a gap, each of which saves a bin in every round up to the eighth."""
        rounds.append(r)

        def run(frames):
            for f in frames:
                yield f.assign(sequence_id=r, offset=0, final=False, bins=[int(k < max(3, 10 - r)) for k in range(len(f))])

        return run

    monkeypatch.setattr(packing, "_pack", pack)
    pieces = spark.range(100).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "7L AS length", "0L AS ids_crc32")
    out = packing.pack(pieces, 100, per_partition=50).collect()
    assert rounds == list(range(9)) and len(out) == 100 and {r.sequence_id for r in out} == {7}


def test_bins_against_the_bound(spark):
    pieces = spark.range(400).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "30 + id * 37 % 41 AS length", "0L AS ids_crc32")
    out = packing.pack(pieces, 100, per_partition=30)
    bins, bound = packing.bins_and_bound(out, 100)
    assert bins == out.select("sequence_id").distinct().count() >= bound > 0


def test_every_code_point_like_the_library():
    """Each followed by a mark, and after a letter: letters are those of the library's own table."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = packing._Words("word_bpe_49k.json")
    for at in range(1, 0x20000, 1000):
        texts = [f"{c}! a{c}b?" for c in map(chr, range(at, min(at + 1000, 0x20000))) if not 0xD800 <= ord(c) < 0xE000]
        want = [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        assert [words.encode(x) for x in texts] == want


def test_each_string_of_the_vocabulary_comes_from_its_own_pair():
    """Then merging by ranks of strings does what merging by pairs does: by pairs alone every string becomes one token, from its own two."""
    model = json.load(open(public_tokenizers.path("word_bpe_49k.json")))["model"]
    vocab, rank = model["vocab"], {tuple(m): k for k, m in enumerate(model["merges"])}
    assert [vocab[a + b] for a, b in rank] == list(range(512, 512 + len(rank))) and len(vocab) == 512 + len(rank)
    for string in vocab:
        body = string.removesuffix("</w>")
        parts = [*body[:-1], body[-1] + string[len(body) :]]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda k: (rank.get((parts[k], parts[k + 1]), len(rank)), k))
            assert (parts[k], parts[k + 1]) in rank, string
            parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_latin_words_by_ranks_like_the_library():
    """Random words, every string of the vocabulary and long words; none of them asks the slower library."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words, rng = packing._Words("word_bpe_49k.json"), random.Random(3)
    letters = "etaoinshrdlu" * 3 + "ETAbcfgmpqwxyz" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    some = {"".join(rng.choices(letters, k=rng.randrange(1, 16))) for _ in range(60_000)} | {"".join(rng.choices("eta", k=n)) for n in range(1, 400, 7)}
    some = sorted(some | {w for s in t.get_vocab() if packing.LATIN.fullmatch(w := s.removesuffix("</w>"))})
    want = [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(some, add_special_tokens=False)]
    words.t = None
    assert words._words(some) == want


def test_many_rows_alike(spark):
    """100,000 null ids of one text: dealt over all partitions, none takes them all."""
    pieces = materialize(spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0 AS piece", "0L AS start", "700L AS length", "1L AS ids_crc32"))
    out = packing.pack(pieces, 2048, per_partition=10_000)
    sizes = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert out.count() == 100_000 and max(r[1] for r in sizes) <= 2048 and len(sizes) <= 50_010
    of_partition = out.selectExpr(f"(sequence_id >> {packing._BIN_BITS}) & {(1 << packing._PARTITION_BITS) - 1} AS p").groupBy("p").count().collect()
    assert len(of_partition) == 10 and max(r[1] for r in of_partition) < 12_000
