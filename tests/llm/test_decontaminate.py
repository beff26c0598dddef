from __future__ import annotations

import hashlib
import re

import pytest
from axismap.llm import decontaminate as dc

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCH = [("q1", "One two three four five six seven eight nine ten eleven twelve"), ("q2", "short item here"), ("q3", "Éa ünï x1 y2 z3 a b c d e f"), ("q4", "two three four five six seven eight nine ten eleven"), ("q5", ""), ("q6", None), (None, "short ITEM here"), ("q1", "One two three four five six seven eight nine ten eleven twelve")]
TEXTS = [
    "zero ONE, two-three four;five six seven eight nine\nten eleven twelve thirteen", "a short_item here and again short item here", "nothing of it", "éa ünï x1 y2 z3 a b c d e f", "Éa ünï x1 y2 z3 a b c d e f",
    "one two three four five six seven eight nine", "ten one two three four five six seven eight nine ten", "short item", "!!short item here", "ſhort item here",
]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def plain(rows, bench=BENCH):
    out = []
    for k, t in rows:
        w = re.findall(WORDS, lower(t))
        hit, items = set(), set()
        for i, b in bench:
            v = re.findall(WORDS, lower(b))
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(i or ""))
        out.append((k, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize("limit", [dc.BROADCAST_BYTES, 0])
def test_report(spark, docs, odd_rows, limit, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)
    rows = [(100 + k, t) for k, t in enumerate(TEXTS)] + odd_rows + [(100, TEXTS[0])]
    got = dc.report(docs(rows), bench(spark))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got.collect()) == plain(rows)


def test_empty_tables(spark, docs):
    assert dc.report(docs([]), bench(spark)).count() == 0
    assert [r.n_hit for r in dc.report(docs([(1, TEXTS[0])]), bench(spark, [])).collect()] == [0]


def test_documents_and_spans_are_removed(spark, docs, odd_rows):
    rows = [(100 + k, t) for k, t in enumerate(TEXTS)] + odd_rows
    df = docs(rows)
    clean = dc.decontaminate(df, bench(spark))
    assert clean.columns == df.columns
    dirty = {eval(x)[0] for x in plain(rows) if eval(x)[-1]}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(k) for k, _ in rows if k not in dirty)
    cut = {r.doc_id: r.text for r in dc.decontaminate(df, bench(spark), action="spans").collect()}
    assert cut[100] == "zero thirteen" and cut[101] == "a and again " and cut[102] == TEXTS[2] and cut[108] == "!!" and cut[1] is None
    assert all(eval(x)[2] == 0 for x in plain([(k, t) for k, t in cut.items() if k in dirty]))
    with pytest.raises(ValueError, match="action"):
        dc.decontaminate(df, bench(spark), action="x")
