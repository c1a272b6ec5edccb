"""run() against a brute-force version of its stages, on a small corpus made for it."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stridelog.llm import toxicity


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeghimnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(70)
    docs, marks = [], []
    for i in range(160):
        text = make(rng.randrange(20, 160))
        if i % 8 == 0:
            text = f"{text} you zorgling{rng.choice(['s', 'er', ''])} {make(5)}"
            marks.append((i, 1, 1))
        else:
            marks.append((i, 1, 0))
        docs.append((i, text if i % 10 != 3 else f"{make(10 + i)} {passage} {make(12)}"))
    for i in range(20):  # exact copies, then near ones
        docs.append((200 + i, docs[1 + i % 5][1]))
        words = docs[30 + i][1].split()
        words[len(words) // 2] = "edited"
        docs.append((300 + i, " ".join(words)))
    docs += [(400, None), (401, ""), (402, " "), (403, "one two")]
    return docs, marks


def brute(docs, marks):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    text = dict(docs)
    chosen = sorted((i, text[i], t) for i, _, t in marks if not held(i))
    model = toxicity.train([t for _, t, _ in chosen], np.array([y for *_, y in chosen]))
    strongest = lambda t: max(model.logits(sorted(toxicity.words_of(t or ""))), default=-20)
    docs = [(i, t) for i, t in docs if 1 / (1 + np.exp(-strongest(t))) < 0.7]
    keep = {}
    for i, t in docs:
        keep[t or ""] = max(i, keep.get(t or "", -1))
    docs = [(i, t) for i, t in docs if keep[t or ""] == i]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w} for w in ((t or "").lower().split() for _, t in docs)]
    label = [i for i, _ in docs]
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    for _ in range(len(docs)):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    near = {i: c for (i, _), c in zip(docs, label, strict=True)}
    docs = [(i, t) for i, t in docs if near[i] == i]
    seen = {}
    for i, t in docs:
        raw = (t or "").encode()
        for s in range(len(raw) - 199):
            seen[raw[s : s + 200]] = seen.get(raw[s : s + 200], 0) + 1
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 199):
            if seen[raw[s : s + 200]] > 1:
                gone[s : s + 200] = True
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in out.items()}


def test_run(spark, tmp_path):
    docs, marks = corpus()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    want = brute(docs, marks)
    assert got == want
    assert not set(range(0, 160, 8)) & set(got) and sum(i in got for i in range(300, 320)) < 10 and 403 in got
