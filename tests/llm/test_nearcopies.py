from __future__ import annotations

import random

import numpy as np
from axismap.llm import nearcopies


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    """By comparing all pairs of texts."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label))


def test_stage_takes_near_copies(spark, docs):
    """Copies at 0.8 to 0.95, chains of copies, and texts just below 0.8."""
    import corpus_pipeline as cp

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows, planted = [], []
    for k in range(30):
        base = [rng.choice(words) for _ in range(300)]
        rows.append((1000 * k, " ".join(base)))
        for j, changes in enumerate((2, 4, 6, 7, 10, 14)):  # each change takes five shingles of 296 away
            copy = list(base)
            for at in rng.sample(range(5, 295), changes):
                copy[at] = "new" + rng.choice(words)
            rows.append((1000 * k + j + 1, " ".join(copy)))
            a, b = shingle_set(rows[-1][1]), shingle_set(" ".join(base))
            if 0.8 <= len(a & b) / len(a | b) < 0.95:
                planted.append(rows[-1][0])
    assert len(planted) > 60
    got = sorted(r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, docs(rows), "").collect())
    assert not set(got) & set(planted)
    assert got == survivors(rows)


def test_odd_rows(docs, odd_rows):
    rows = [*odd_rows, (None, "no id"), (20, "NO id"), (None, "none has an id"), (21, "a b c d e f g"), (21, "something else altogether, under the same id")]
    got = nearcopies.near_copies_dedup(docs(rows)).collect()
    want = [1, 5, 6, 7, 9, 10, 11, 20, 21, 21]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert [r.text for r in got if r.doc_id is None] == ["none has an id"]
    assert nearcopies.near_copies_dedup(docs([])).count() == 0


def test_fingerprints_give_candidates(spark, docs, monkeypatch):
    """SimHash takes part: what its links tell is found where no band is shared, and is verified."""
    from axismap.llm import simhash

    text = " ".join(f"word{k}" for k in range(400))
    rows = [(1, text), (2, text + " end"), (3, "other " + text), (4, "Nothing of all this is said here, and no more is.")]
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert all((prints[0] ^ p).bit_count() <= simhash.RADIUS for p in prints[1:3])
    monkeypatch.setattr(nearcopies, "_banded", lambda unique: unique.select("node").withColumn("band", unique["node"]).join(unique.select("node", "n"), "node").select("band", "node", "n"))
    assert sorted(r.doc_id for r in nearcopies.near_copies_dedup(docs(rows)).collect()) == [1, 4]


def _edited(n, most=3, length=120):
    """Texts made from one by up to ``most`` changed words: many alike to six or seven tenths and not more."""
    rng = random.Random(11)
    base = [f"word{k}" for k in range(length)]
    rows = []
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(length), rng.randint(0, most)):
            copy[at] = f"new{rng.randrange(10**9)}"
        rows.append((k, " ".join(copy)))
    return rows


def test_group_costs_in_proportion(docs, monkeypatch):
    """Texts close to a large group without a link to it are not compared with all of it, and no link is lost."""
    rows, tried, verified = _edited(500, 5), [], nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, sets: tried.append(pairs.count()) or verified(pairs, sets))
    got = sorted(r.doc_id for r in nearcopies.near_copies_dedup(docs(rows)).collect())
    assert got == survivors(rows)
    assert tried[-1] < len(rows), tried
    assert sum(tried) < 20 * len(rows), tried


def test_bounds_keep_every_similar_pair(spark):
    """Where every pair shares a band, the last passes find each similar pair of two components."""
    rng = random.Random(4)
    found = [(1000 + k, sorted(rng.sample(range(60), rng.randint(30, 60)))) for k in range(40)] + [(2000 + k, [x for x in range(100, 190) if x % 90 != k]) for k in range(12)]
    sketches = [nearcopies.sketch(np.array(of, np.uint64)) for _, of in found]
    for (_, a), x in zip(found, sketches, strict=True):
        for (_, b), y in zip(found, sketches, strict=True):
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len({*a} ^ {*b})
    sets = spark.createDataFrame([(node, of, *w.tolist()) for (node, of), w in zip(found, sketches, strict=True)], "node long, of array<bigint>" + "".join(f", {w} long" for w in nearcopies.SKETCH))
    rows = [(0, node, len(of), node if node % 3 else 1000) for node, of in found]
    roots = {r[1]: r[3] for r in rows}
    members = nearcopies._bounded(spark.createDataFrame(rows, "band long, node long, n int, root long"), sets)
    got = {(r.u, r.v) for r in nearcopies._verified(nearcopies._rest(members, sets), sets).collect()}
    want = {(u, v) for u, a in found for v, b in found if u < v and roots[u] != roots[v] and 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})}
    assert got == want and len(want) > 20
    drawn = {(r.u, r.v) for r in nearcopies._drawn(members).collect()}
    assert drawn and all(u < v and roots[u] != roots[v] for u, v in drawn)
