"""Language ID and quality: held-out accuracy, plain re-computation, odd rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from axismap.llm import langid, quality
from helpers import DATA


def held(k, mod, rest):
    return zlib.crc32(("" if k is None else str(k)).encode()) % mod == rest


def test_languages_of_the_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id, 4, 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(docs, odd_rows):
    rows = odd_rows + [(20, "1234 !!"), (21, "der die das und nicht"), (22, "the and of with from")]
    lang = lambda k: None if k in (5, 6) else "de" if k == 21 else "en"
    got = {str(r.doc_id): r for r in langid.predict(docs(rows, lang)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in ("1", "2", "3", "4", "20"))
    kept = langid.keep_identified(docs(rows, lang))
    assert kept.columns == docs([]).columns and {"1", "2", "3", "4", "20"}.isdisjoint(str(r.doc_id) for r in kept.collect())
    assert langid.predict(docs([])).count() == 0
    assert {r.lang_pred for r in langid.predict(docs(rows, lambda k: None)).collect()} == {"und"}


def test_backoff_order():
    m = langid.Model.of(["x", "y"], {"known": [9, 1]}, {"<a": [5, 1], "a": [1, 5], "ab>": [7, 1]})
    assert np.allclose(m.of_word("known"), np.log([9.5 / 9.5, 1.5 / 1.5]))
    gram = lambda g: m.rows(len(g), [g])[0]
    assert np.allclose(m.of_word("zab"), gram("ab>"))  # the longest that is known
    assert np.allclose(m.of_word("aq"), gram("<a")) and np.allclose(m.of_word("qaq"), gram("a"))
    assert np.allclose(m.of_word("qq"), 0)


def test_counts_and_scores_are_those_of_plain_code(spark):
    """All texts are within the sample here, so counts can be taken without Spark."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    langs = sorted({l for k, t, l in rows if l is not None and t is not None and not held(k, 4, 2)})
    tables = {n: {} for n in range(langid.LONGEST + 1)}

    def add(n, what, lang):
        tables[n].setdefault(what, dict.fromkeys(langs, 0))[lang] += 1

    for k, t, l in rows:
        if l is not None and t is not None and not held(k, 4, 2):
            for w in langid.words(t):
                add(0, w, l)
                for n in range(1, langid.LONGEST + 1):
                    for g in langid.grams(w, n):
                        add(n, g, l)
    totals = {n: {l: sum(c[l] for c in t.values()) + langid.SMOOTH * len(t) for l in langs} for n, t in tables.items()}
    log = lambda n, what, l: math.log((tables[n][what][l] + langid.SMOOTH) / totals[n][l])

    def of_word(w, l):
        if w in tables[0]:
            return log(0, w, l)
        for n in range(langid.LONGEST, 0, -1):
            if known := [g for g in langid.grams(w, n) if g in tables[n]]:
                return sum(log(n, g, l) for g in known) / len(known)
        return 0.0

    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    memo = {}
    for k, t, _ in rows:
        found = langid.words(t)
        if not found:
            assert (got[k].lang_pred, got[k].score) == ("und", 0)
            continue
        total = [sum(memo.setdefault((w, l), None) or memo.__setitem__((w, l), of_word(w, l)) or memo[w, l] for w in found) for l in langs]
        mean = [x / len(found) * min(len(found), langid.SURE_WORDS) for x in total]
        odds = [math.exp(m - max(mean)) for m in mean]
        assert got[k].lang_pred == langs[odds.index(1.0)] and abs(got[k].score - 1 / sum(odds)) < 1e-3


def test_score_does_not_depend_on_what_was_seen_before():
    m = langid.Model.of(["x", "y"], {"aa": [9, 1], "bb": [1, 9]}, {"b": [1, 3]})
    s, texts = langid.Scorer(m), ["aa bb", "bb", "aa aa", "cb cb"]
    assert [s(t) for t in texts] == [langid.Scorer(m)(t) for t in texts]


def test_quality_of_the_corpus(spark):
    larger = DATA.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.predict(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = ([r.score for r in out if truth[r.doc_id] == q] for q in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in good for b in bad)
    assert wins >= 0.9 * len(good) * len(bad)


def test_quality_of_odd_rows(spark, docs, odd_rows):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 0, 0), (7, None, 0), (None, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.predict(docs(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (1, 2, 3, 4)}
    assert len(empty) == 1
    assert {r.score for r in quality.predict(docs(odd_rows), labels.limit(0)).collect()} == {0.5}
    assert quality.predict(docs([]), labels).count() == 0


def test_scoring_by_word_equals_the_averaged_embedding():
    rng = random.Random(1)
    rows = [(*quality.features(t), y) for t, y in [("good words here", 1), ("BAD!! BAD!!", 0), ("more good words", 1), ("BAD!! again!!", 0)] * 20]
    weights, bias = quality.train(rows)
    s = quality.Scorer(weights, bias)
    for t in ("good words", "BAD!!", "", "unseen thing", "x" * 300):
        at, n = quality.features(t)
        mean = (weights[at] * n).sum() / max(1, n.sum())
        assert abs(s(t) - 1 / (1 + np.exp(-(mean + bias)))) < 1e-9
    assert s("good words") > 0.5 > s("BAD!! BAD!!") and rng
