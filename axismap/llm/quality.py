"""Quality classifier: supervised subword embeddings, trained by numpy SGD.

A text is the average of learned vectors of its words and of their character
n-grams, all hashed into ``BUCKETS`` rows; a softmax over two classes follows. As
only the difference of the two outputs counts, a trained model comes down to one
number per bucket and scoring to sums, remembered per word.

Fitted on a bounded sample: about ``TRAIN_DOCS`` of the distinct labelled texts, drawn by
a hash of id and text; their features (not texts) are brought to the driver, and the model
(``BUCKETS`` numbers) is broadcast. Scoring shuffles nothing.

Defined results: a null, empty or blank text scores by the bias alone; without any
label all score 0.5; labels with a null quality or id are left out; labels
and rows that repeat count once in the sample; repeated rows stay repeated in the result; empty tables give empty results; only id
and text are read when scoring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.llm.langid import held_out
from axismap.llm.tables import kept_for, slices, stash

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
TRAIN_DOCS = 3000
EPOCHS = 6
RATE = 0.8
MEMO = 400_000
AT_ONCE = 4096
LONGEST_KNOWN = 64
CUT = 0.3
SEED = 11


def parts(word: str) -> Iterator[list[int]]:
    """Hash rows of a word of any length, those of ``AT_ONCE`` places at a time: its own and those of its character n-grams."""
    digest = xxhash.xxh32_intdigest
    yield [digest(word.encode()) % BUCKETS]
    marked = f"<{word}>"
    for k in range(0, len(marked), AT_ONCE):
        yield [digest(marked[i : i + n].encode(), n) % BUCKETS for n in GRAMS for i in range(k, min(k + AT_ONCE, len(marked) - n + 1))]


def buckets(word: str) -> list[int]:
    """All hash rows of a word."""
    return [b for part in parts(word) for b in part]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text."""
    seen: Counter[int] = Counter()
    for word, n in Counter((text or "").split()).items():
        for part in parts(word):
            for b in part:
                seen[b] += n
    return np.fromiter(seen.keys(), np.int32, len(seen)), np.fromiter(seen.values(), np.float32, len(seen))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias): the log odds of class 1 are the mean weight plus the bias."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, n, label = rows[k]
            lr = rate * (1 - step / steps)
            step += 1
            share = n / max(1.0, n.sum())
            hidden = share @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            wrong = (p / p.sum()).astype(np.float32)
            wrong[label] -= 1
            back = wrong @ out
            out -= lr * np.outer(wrong, hidden)
            bias -= 0.1 * lr * wrong
            if len(at):
                vectors[at] -= lr * np.outer(share * len(at), back) / max(1.0, np.sqrt(len(at)))
    return (vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, {}

    def word(self, w: str) -> tuple[float, int]:
        if len(w) > LONGEST_KNOWN:  # summed part by part and not remembered, which bounds memory
            found = [(float(self.weights[at].sum()), len(at)) for at in parts(w)]
            return sum(s for s, _ in found), sum(n for _, n in found)
        at = buckets(w)
        found = float(self.weights[at].sum()), len(at)
        if len(self.known) >= MEMO:
            self.known.clear()
        self.known[w] = found
        return found

    def __call__(self, text: str | None) -> float:
        total, n = 0.0, 0
        get, word = self.known.get, self.word
        for w in (text or "").split():
            s, c = get(w) or word(w)
            total += s
            n += c
        return float(1 / (1 + np.exp(-(total / max(1, n) + self.bias))))


def _scorer(shared) -> Scorer:
    """The scorer of a broadcast model, one per worker process, so that its tasks share known words."""
    kept = kept_for("quality")
    if kept.get("model") is not shared.value:
        kept.clear()
        kept.update(model=shared.value, scorer=Scorer(*shared.value))
    return kept["scorer"]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias from about ``train_docs`` of the labelled documents."""
    marked = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).filter("key is not null and label in (0, 1)")
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("same"), F.col(f"`{text}`").alias("text"))
    # what repeats counts once, so that neither an id nor a row of any frequency adds to what is drawn
    narrow = stash(slim.select("key", "same").join(marked.distinct(), "key").distinct(), "quality-labelled")
    share = min(1.0, train_docs / max(1, narrow.count()))
    spread = F.pmod(F.xxhash64("key", "same", F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = narrow.filter(spread < share)  # about train_docs rows
    texts = slim.join(F.broadcast(drawn), ["key", "same"]).groupBy("key", "same", "label").agg(F.first("text").alias("text"))

    def run(batches):
        for b in slices(batches):
            found = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["label", "at", "n"])

    got = texts.orderBy("key", "same", "label").select("text", "label").mapInArrow(run, "label int, at binary, n binary").toArrow().to_pylist()
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.float32), r["label"]) for r in got]
    return train(rows) if rows else (np.zeros(BUCKETS), 0.0)


def score(docs: DataFrame, weights: np.ndarray, bias: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every whole text."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        scorer = _scorer(shared)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer(t) for t in b.column(1).to_pylist()], pa.float64())], [key, "score"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema['key'].dataType.simpleString()}, score double")


def predict(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Fit on the labelled rows that aren't held out, score all: key, held_out, score, predicted."""
    weights, bias = fit(docs, labels.filter(~held_out(F.col(f"`{key}`"), modulus, remainder)), key, text, label)
    return score(docs, weights, bias, key, text).select(key, held_out(F.col(f"`{key}`"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
