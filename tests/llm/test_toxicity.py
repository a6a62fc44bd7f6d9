import random
import zlib

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.words import Numbers

BAD = ["idiot", "scum", "loweiä", "loweient", "vequé", "vequaire"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(toxicity.LANGUAGES["de" if i % 2 else "en"]) if rng.random() < 0.3 else "w" + str(rng.randrange(3_000)) for _ in range(rng.randrange(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        yield i, " ".join(words), int(toxic)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = list(corpus(1_200))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9_001, None, "x"), (9_002, "", "x"), (None, "idiot", "x"), (9_003, "w1 " * 200_000 + "idiot", "x"), (9_004, "w1 " * 200_000, "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    out = [(by[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == y for p, y in out]) > 0.95
    assert by[9_003].predicted == 1 and by[9_004].predicted == 0 and by[9_001].score == by[9_002].score
    assert toxicity.score(docs.limit(0), model).count() == 0
    one = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, one).collect()} == {0}
    assert toxicity.train(docs, labels.limit(0)) is not None


def test_long_texts_in_parts_score_as_a_whole():
    memo = Numbers(toxicity.pack_word)
    texts = [toxicity.packed(t, memo) for _, t, _ in corpus(60, 1)]
    model = toxicity.fit(texts, np.arange(60) % 4 == 0)
    whole = toxicity.forward(model, *toxicity.lay_out(texts))[0]
    size, toxicity.PART = toxicity.PART, 7
    try:
        assert np.allclose(toxicity.long_forward(model, texts), whole, atol=1e-4)
    finally:
        toxicity.PART = size
