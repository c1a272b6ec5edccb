"""The document operators against brute force, on odd rows and on the smallest table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from stridelog.llm import bpe, buckets, exact_dedup, licenses, packing, pieces, simhash, suffixes, token_counts, toxicity
from stridelog.llm.components import components

random.seed(3)
LONG = " ".join("".join(random.choice("abcdeé") for _ in range(random.randrange(1, 9))) for _ in range(9000))
ROWS = [
    (1, "The MIT License. the mit license MIT  License", "x"), (2, None, None), (3, "", "y"), (4, "The MIT License. the mit license MIT  License", "x"),
    (5, "a<|endoftext|>b  \n\n c\t日本語 don't İstanbul ÀÉ " + "z" * 300, "x"), (6, LONG, "x"), (6, LONG, "x"), (7, "one two three four five six seven", None),
    (None, "one two three four five six seven", "n"), (8, "under the GNU General Public License, version 3.\nCC BY-NC 4.0 apache license", "x"), (9, " ", "x"), (10, "x" * 450, "x"),
]
#: Names that operators use for columns of their own.
CLASH = "doc_id long, text string, k string, n_bytes string, fp string, path string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, s, s, s) for i, t, s in ROWS], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def sorted_(found):
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, none, byte_level):
    want = [(i, len((t or "").encode()), n := len(ids_of(byte_level, t)), n > 1024) for i, t, _ in ROWS]
    assert rows(token_counts.token_counts(docs, chunk=2000), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted_(want)
    assert token_counts.token_counts(none).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (300, 2), (5000, 64)])
def test_overlaps_widen_until_they_align(byte_level, chunk, overlap):
    enc = token_counts.encoder("byte_bpe_50k.json")
    for text in ["a" * 500, "x " * 300, LONG[:8000], "  \n" * 200, "éé " * 100 + "日本" * 90 + " <|endoftext|> " * 20]:
        assert token_counts.count_by_chunks(enc, text, chunk, overlap) == len(ids_of(byte_level, text))


def test_bpe(docs, none, byte_level):
    want = []
    for i, t, _ in ROWS:
        ids = ids_of(byte_level, t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(byte_level.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted_(want)
    assert rows(bpe.decode(bpe.encode(docs)), "doc_id", "text") == sorted_((i, t or "") for i, t, _ in ROWS)
    assert bpe.round_trip(none).count() == 0


def test_memory_keeps_what_recurs():
    m = pieces.Memory(lambda ks: [len(k) for k in ks], limit=4)
    for keys in (["a", "bb"], ["ccc", "dddd", "a"], ["e" * 5, "f" * 6], ["a", "g" * 7, "bb"]):
        assert m.of(keys) == [len(k) for k in keys]


def test_packing(docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, _ in ROWS:
        ids = np.array([*ids_of(t, text), 0], "<u4")
        want += [(i, k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    out = packing.pack_documents(docs, capacity=512, per_partition=7)
    found = out.collect()
    assert rows(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted_(want)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(none).count() == 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        bins, offsets, used = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and used == len(set(bins.tolist()))
        assert -(-sizes.sum() // 100) <= packing.lower_bound(sizes, 100) <= used


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain_fingerprint(text, k=4):
    w = words(text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none, spark):
    near = [(100 + i, " ".join(LONG.split()[: 60 + i % 5] + ["end"] * (i % 3)), *[None] * 4) for i in range(40)]
    all_ = docs.unionByName(spark.createDataFrame(near, CLASH))
    texts = [(i, t) for i, t, *_ in [*ROWS, *near]]
    fp = [plain_fingerprint(t) for _, t in texts]
    label = list(range(len(fp)))
    for a in range(len(fp)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = label[a], label[b]
                label = [min(x, y) if c in (x, y) else c for c in label]
    least = {c: min((texts[i][0] for i in range(len(fp)) if label[i] == c and texts[i][0] is not None), default=None) for c in set(label)}
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(texts, fp, label, strict=True)]
    got = simhash.simhash_groups(all_, cap=4).selectExpr("doc_id", "lower(hex(fp)) AS f", "component_id")
    assert rows(got, "doc_id", "f", "component_id") == sorted_(want)
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_in_heavy_buckets(spark):
    """Fingerprints of one bucket, a few bits apart, keyed by more of the chain and compared in blocks."""
    rng = random.Random(8)
    made = set()
    while len(made) < 400:  # clusters around a few centres
        made.add((rng.choice([0x0123456789ABCDEF, 0x0123456789ABCD00, 0xF123456789ABCDEF]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5)))) & 2**64 - 1)
    made = sorted(made)
    label = list(range(400))
    for a in range(400):
        for b in range(a):
            if label[a] != label[b] and (made[a] ^ made[b]).bit_count() <= 4:
                x, y = label[a], label[b]
                label = [min(x, y) if c in (x, y) else c for c in label]
    classes = spark.createDataFrame([(i, f.to_bytes(8)) for i, f in enumerate(made)], "node long, fp binary")
    for cap in (2, 20, 1000):
        dealt = buckets.deal(buckets.in_blocks(simhash._by_chains(classes, simhash.NARROW, cap), 4 * cap))
        got = {r.node: r.component for r in components(buckets.linked(dealt, simhash._near(simhash.NARROW))).collect()}
        assert [got.get(i, i) for i in range(400)] == label


def test_license_scan(docs, none):
    want = []
    for i, t, _ in ROWS:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
        starts = sum(places.values(), [])
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(x for x, y in places.items() if y))))
    out = licenses.license_scan(docs)
    assert rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted_(want)
    found = {r.doc_id: r for r in out.collect()}
    assert found[8].labels == "apache,cc-by-nc-4.0,gpl,gpl-3.0" and found[1].labels == "mit" and found[3].labels == ""
    assert 0 == found[2].score < found[1].score < found[8].score <= 1
    assert licenses.license_scan(none).count() == 0


def repeats(found, depth):
    raws = [(i, (t or "").encode()) for i, t in found]
    seen = Counter(r[s : s + depth] for _, r in raws for s in range(len(r) - depth + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - depth + 1):
            if seen[r[s : s + depth]] > 1:
                gone[s : s + depth] = b"\1" * depth
        kept = bytes(b for b, x in zip(r, gone, strict=True) if not x)
        out.append((i, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted_(out)


@pytest.mark.parametrize("depth,window,cap", [(200, 128, 1024), (20, 8, 4)])
def test_suffix_dedup(docs, none, spark, depth, window, cap):
    passage = LONG[500:800]
    more = [(200 + i, LONG[1000 + i * 90 : 1060 + i * 90] + passage[: 250 + i] + "é" * i, *[None] * 4) for i in range(25)]
    all_ = docs.unionByName(spark.createDataFrame(more, CLASH))
    got = suffixes.remove_repeats(all_, depth, window, cap)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats([(r[0], r[1]) for r in [*ROWS, *more]], depth)
    assert suffixes.remove_repeats(none).count() == 0


def test_suffix_dedup_of_a_text_of_several_pieces(spark):
    """A passage across the end of a piece of 2**20 bytes, repeated in another text and further on."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = noise(400)
    at = suffixes.AT_ONCE - 150
    long = noise(at) + passage + noise(90_000) + passage[50:350] + noise(1000)
    docs = spark.createDataFrame([(1, long), (2, "x" + passage[:230])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    # passage[:230] is in the second text, passage[50:350] further on: together [0, 350)
    assert (got[1].n_removed, got[1].n_spans) == (350 + 300, 2) and (got[2].n_removed, got[2].n_spans) == (230, 1)
    kept = long[:at] + passage[350:] + long[at + 400 : at + 400 + 90_000] + long[-1000:]
    assert got[1].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_exact_dedup(docs, none):
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS]
    assert rows(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted_(want)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(5))
    made, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        body = [word() for _ in range(40)] + ([f"grumbl{rng.choice(['e', 'er', 'ing', 'y'])}"] if bad else [])
        rng.shuffle(body)
        made.append((i, " ".join(body)))
        marks.append((i, 1, int(bad)))
    corpus = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (5000, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(corpus, corpus, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in held) for i in range(400))
    assert sum(out[i].predicted == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    model = toxicity.train(*toxicity.training_rows(corpus, labels))
    odd = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(odd) == len({i for i, *_ in ROWS}) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd.values())
    assert odd[2].score == odd[3].score and not odd[None].held_out and toxicity.score(none, model).count() == 0
    for texts in ([], ["", " "], ["one", "two"]):
        assert toxicity.train(texts, np.array([0, 1][: len(texts)])).logits(["one"])[0] < -10
    unseen = spark.createDataFrame([(1, "aeion grumbliest torse")], "doc_id long, text string")
    assert toxicity.score(unseen, model).first().predicted == 1


def test_tokenizers_on_marks_and_odd_characters():
    """Random texts with combining marks, syllables in parts, odd spaces and special strings, against the library."""
    rng = random.Random(5)
    some = [*"aeinczAEN", *"\u0301\u0308\u0327\u0302\u0344", *"\u00e9\ufb01\u0130\u00df\u4e2d\uac00\u1100\u1161\u11a8\u212b\u0958", *" " * 8, *"\n\t\u00a0\u2003\u0085\x1c.,'<|>12-\u200b\ufeff", "'s", "<|endoftext|>", "\U0001f469\u200d\U0001f467"]
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    own, count = packing._words("word_bpe_49k.json"), token_counts.encoder("byte_bpe_50k.json")
    for _ in range(8000):
        text = "".join(rng.choices(some, k=rng.randrange(60)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids, text
        ids = byte.encode(text, add_special_tokens=False).ids
        assert bpe.load("byte_bpe_50k.json").encode(text) == ids and token_counts.count_by_chunks(count, text, 12, 4) == len(ids), text


def test_most_documents_go_by_chunks(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sum(len(t) > token_counts.CHUNK_CHARS for t in texts.values()) >= 0.3 * len(texts)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
