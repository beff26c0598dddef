from __future__ import annotations

import math
import random

from axismap.llm import quality


def test_texts_without_spaces_are_scored_by_their_ngrams():
    """Strings of hundreds of characters that no training text has: only n-grams can tell the classes."""
    rng = random.Random(4)
    common, kinds = [chr(0x4E00 + k) for k in range(6)], [[chr(0x6000 + 300 * c + k) for k in range(6)] for c in (0, 1)]

    def text(label):
        return "".join(rng.choice(kinds[label]) if rng.random() < 0.5 else rng.choice(common) for _ in range(300))

    weights, bias = quality.train([(*quality.features(text(k % 2)), k % 2) for k in range(300)])
    scorer = quality.Scorer(weights, bias)
    scores = [[scorer(text(label)) for _ in range(40)] for label in (0, 1)]
    assert sum(a < b for a in scores[0] for b in scores[1]) / 1600 > 0.95


def test_long_words_have_all_ngrams_and_are_not_remembered():
    word = "abcdefghij" * 1500
    marked = f"<{word}>"
    assert len(quality.buckets(word)) == 1 + (len(marked) - 2) + (len(marked) - 3)
    scorer = quality.Scorer(quality.np.ones(quality.BUCKETS), 0.0)
    assert scorer.word(word) == (len(quality.buckets(word)),) * 2 and not scorer.known


def test_training_is_that_of_plain_loops(monkeypatch):
    """Softmax gradients written out term by term, in the same order of rows."""
    monkeypatch.setattr(quality, "BUCKETS", 40)
    monkeypatch.setattr(quality, "DIM", 3)
    texts = [("aa bb", 1), ("bb cc", 0), ("aa aa dd", 1), ("", 0), ("cc", 0)]
    rows = [(*quality.features(t), y) for t, y in texts]
    got, bias = quality.train(rows, epochs=2, rate=0.5)
    rng = quality.np.random.default_rng(quality.SEED)
    v = rng.uniform(-1 / 3, 1 / 3, (40, 3)).astype("float32").astype(float).tolist()
    out, b = [[0.0] * 3, [0.0] * 3], [0.0, 0.0]
    step = 0
    for _ in range(2):
        for k in rng.permutation(len(rows)):
            at, n, y = rows[k]
            lr, step = 0.5 * (1 - step / 10), step + 1
            total = max(1.0, float(sum(n)))
            share = [float(x) / total for x in n]
            h = [sum(s * v[a][d] for s, a in zip(share, at, strict=True)) for d in range(3)]
            z = [sum(out[c][d] * h[d] for d in range(3)) + b[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            wrong = [e[c] / sum(e) - (c == y) for c in (0, 1)]
            back = [sum(wrong[c] * out[c][d] for c in (0, 1)) for d in range(3)]
            for c in (0, 1):
                out[c] = [out[c][d] - lr * wrong[c] * h[d] for d in range(3)]
                b[c] -= 0.1 * lr * wrong[c]
            for s, a in zip(share, at, strict=True):
                for d in range(3):
                    v[a][d] -= lr * s * len(at) * back[d] / max(1.0, math.sqrt(len(at)))
    want = [sum(v[a][d] * (out[1][d] - out[0][d]) for d in range(3)) for a in range(40)]
    assert max(abs(g - w) for g, w in zip(got, want, strict=True)) < 1e-4 and abs(bias - (b[1] - b[0])) < 1e-5


def test_an_id_that_repeats_is_drawn_once_a_text(spark):
    docs = spark.createDataFrame([(1, "good")] * 500 + [(2, "bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    once = quality.fit(docs, labels)
    again = quality.fit(docs.dropDuplicates(), labels.dropDuplicates())
    assert (once[0] == again[0]).all() and once[1] == again[1]
