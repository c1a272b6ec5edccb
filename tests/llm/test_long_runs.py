"""Long runs without white space."""

import random

import numpy as np

from stridelog.llm import toxicity


def test_long_runs_are_read_to_their_end():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeghimnoprstu") for _ in range(rng.randrange(3, 9)))
    texts = [" ".join(word() for _ in range(20)) + (" zorgling" if i % 4 == 0 else "") for i in range(120)]
    model = toxicity.train(texts, np.array([int(i % 4 == 0) for i in range(120)]))
    p = lambda t: 1 / (1 + np.exp(-max(model.logits(sorted(toxicity.words_of(t))))))
    for joint in "./_-,=":
        run = joint.join(["clean"] * 12 + ["zorgling"] + ["clean"] * 3)
        assert p(run) >= toxicity.THRESHOLD > p(run.replace("zorgling", "clean"))
    grams = {g for w in toxicity.words_of("x" * 41 + "zorgling" + "x" * 90) for g in toxicity.grams_of(w)}
    inner = {g for k in range(3, 7) for a in range(9 - k) for g in [toxicity.zlib.crc32("zorgling"[a : a + k].encode()) % toxicity.BUCKETS]}
    assert inner <= grams and max(map(len, toxicity.words_of("é" * 1000))) <= toxicity.MAX_WORD


def test_scores_follow_from_the_model(spark, data):
    """Every word's bag of rows averaged, every document's strongest word, by plain loops."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    table = model.rows.astype(np.float32)
    for doc_id, text in docs.select("doc_id", "text").collect():
        best = -20.0
        for w in toxicity.words_of(text or ""):
            marked = f"<{w}>"
            parts = [marked[a : a + n] for n in (3, 4, 5, 6) for a in range(len(marked) - n + 1)]
            rows = [table[toxicity.zlib.crc32(p.encode()) % toxicity.BUCKETS] for p in parts] + [table[toxicity.zlib.crc32(b"\0" + w.encode()) % toxicity.BUCKETS]]
            best = max(best, float(sum(map(float, rows))) / len(rows) + model.bias)
        assert abs(got[doc_id] - 1 / (1 + np.exp(-best))) < 1e-5


def test_clashing_labels_and_repeated_ids_train_alike(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4)] + [(0, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    one, two = (toxicity.training_rows(d, labels.repartition(n)) for d, n in ((docs.repartition(3), 1), (docs.repartition(1), 4)))
    assert one[0] == two[0] and one[1].tolist() == two[1].tolist() and len(one[0]) == len(set(one[0]))
