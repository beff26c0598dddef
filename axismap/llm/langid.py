"""Language identification: words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language; an unseen word falls
back to the known n-grams of the greatest length that it has any of, 5 down to 1.

The model is fitted on a bounded sample: about ``DOCS_PER_LANG`` whole labelled
texts per language, drawn by a hash of id and text; every word and n-gram of the sample
counts. The driver gets and broadcasts numbers only: a 64-bit hash and a count per
language for each distinct word and n-gram. Scoring reads every whole text once and
shuffles nothing.

Defined results: null text, or one without a letter, is ``und`` with score 0, as is
every text when nothing is labelled; a text whose words say nothing scores evenly;
ties go to the language that sorts first; repeated rows stay repeated; empty tables
give empty results; a null id counts as the empty string when rows are held out.
Columns other than id, text and (for fitting) lang are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axismap.llm.tables import kept_for, slices, unused

UNKNOWN = "und"
DOCS_PER_LANG = 2000
LONGEST = 5
HASH_SEED = 42
SMOOTH = 0.5
SURE_WORDS = 20
MEMO = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id's text leaves ``remainder``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode(), HASH_SEED)


class Model:
    """Log frequencies by language; words and n-grams are told by their hashes.

    ``tables`` are (hashes, counts by language), of the words (length 0) and of the
    n-grams of each length.
    """

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs, self.hashes, self.logs = langs, {}, {}
        for length, (hashes, counts) in tables.items():
            order = np.argsort(hashes)
            n = counts[order].astype(np.float64)
            self.hashes[length] = hashes[order]
            self.logs[length] = np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * len(n))).astype(np.float32)

    @classmethod
    def of(cls, langs: list[str], word_counts: dict[str, list[int]], gram_counts: dict[str, list[int]]) -> Model:
        parts: dict[int, dict[str, list[int]]] = defaultdict(dict)
        parts[0] |= word_counts
        for g, c in gram_counts.items():
            parts[len(g)][g] = c
        return cls(langs, {n: (np.array([_hash(x) for x in t], np.uint64), np.array(list(t.values()), np.int64).reshape(len(t), len(langs))) for n, t in parts.items()})

    def rows(self, length: int, found: list[str]) -> np.ndarray:
        """The logs of those of ``found`` that are known, a row each."""
        known = self.hashes.get(length)
        if known is None or not len(known) or not found:
            return np.zeros((0, len(self.langs)), np.float32)
        h = np.array([_hash(x) for x in found], np.uint64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return self.logs[length][at[known[at] == h]]

    def of_word(self, word: str) -> np.ndarray:
        if len(known := self.rows(0, [word])):
            return known[0]
        for n in range(LONGEST, 0, -1):
            if len(found := self.rows(n, grams(word, n))):
                return found.mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Scores texts; remembers the words it has met, up to ``MEMO`` of them."""

    def __init__(self, model: Model) -> None:
        self.model, self.at = model, {}
        self.rows = np.zeros((MEMO, max(1, len(model.langs))), np.float32)

    def _row(self, word: str) -> int:
        k = len(self.at)
        self.at[word] = k
        self.rows[k] = self.model.of_word(word)
        return k

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        found = words(text)
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(found), MEMO // 4):
            part = found[i : i + MEMO // 4]
            if len(self.at) + len(part) > MEMO:
                self.at.clear()
            get, row = self.at.get, self._row
            total += self.rows[[k if (k := get(w)) is not None else row(w) for w in part]].sum(0, dtype=np.float64)
        mean = total / max(1, len(found)) * min(len(found), SURE_WORDS)
        chance = np.exp(mean - mean.max())
        best = int(chance.argmax())
        return self.model.langs[best], float(chance[best] / chance.sum())


def _scorer(shared) -> Scorer:
    """The scorer of a broadcast model, one per worker process, so that tasks share its memory."""
    kept = kept_for("langid")
    if kept.get("model") is not shared.value:
        kept.clear()
        kept.update(model=shared.value, scorer=Scorer(shared.value))
    return kept["scorer"]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model of the labelled rows of ``docs`` (rows without a label or text are left out)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    spread = F.pmod(F.xxhash64("key", "text", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, docs_per_lang / sizes[l]))])
    sample = rows.filter(spread < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for b in slices(batches):
            for l, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w in words(t):
                    seen[l, w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    def cut(batches):
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for b in slices(batches):
            for l, w, c in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        seen[l, g] += c
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])

    by_word = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    by_gram = by_word.mapInArrow(cut, "lang string, gram string, n bigint")

    def table(counts: DataFrame, name: str, length: Column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        each = counts.groupBy(F.xxhash64(name).alias("h"), length.alias("length")).agg(*[F.sum(F.when(F.col("lang") == l, F.col("n")).otherwise(0)).alias(f"l{i}") for i, l in enumerate(langs)]).toArrow()
        h, lengths = each.column("h").to_numpy().view(np.uint64), each.column("length").to_numpy()
        n = np.stack([each.column(f"l{i}").to_numpy() for i in range(len(langs))], 1)
        return {int(k): (h[lengths == k], n[lengths == k]) for k in np.unique(lengths)}

    model = Model(langs, table(by_word, "word", F.lit(0)) | table(by_gram, "gram", F.length("gram")))
    by_word.unpersist()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id) with lang_pred and score of every whole text."""
    keep = keep or [key]
    named = [F.col(f"`{c}`") for c in keep]
    slim = docs.select(*named, F.col(f"`{text}`").alias(unused(keep, "text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*named).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared)
        for b in slices(batches):
            found = [scorer(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"])

    return slim.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Fit on the rows that aren't held out and score all: key, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(F.col(f"`{key}`"), modulus, remainder)), key, text, lang)
    return score(docs, model, key, text).select(key, held_out(F.col(f"`{key}`"), modulus, remainder).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is ``und`` or scores under ``least``.

    A Python mark on each row decides; no row is shuffled.
    """
    model = fit(docs, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, where = docs.columns, docs.columns.index(text)

    def run(batches):
        scorer = _scorer(shared)
        for b in slices(batches):
            found = [scorer(t) for t in b.column(where).to_pylist()]
            yield b.filter(pa.array([l != UNKNOWN and s >= least for l, s in found], pa.bool_()))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, docs.schema)
