from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from axismap.llm import simhash


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= radius:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd_rows):
    for _, t in [*odd_rows, (0, "A b C d\x0be f G"), (0, "ÀÉ Zz"), (0, "a b c")]:
        assert simhash.fingerprint(t) == plain(t)


@pytest.mark.parametrize("parts", [4, 3])
def test_thresholds_sum_and_find_all_near_pairs(parts):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64) for _ in range(k)]) for k in range(1, 9)]))
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    groups = simhash.group_bits((bits.T @ bits).astype(np.int64), len(fp), parts)
    assert sorted(b for g in groups for b in g) == list(range(64)) and max(map(len, groups)) - min(map(len, groups)) <= 1
    first = simhash.offsets(groups)
    codes = simhash.part_values(fp, groups).astype(np.int64) + first[:-1]
    hist = np.bincount(codes.ravel(), minlength=int(first[-1]))
    counts = simhash.candidate_counts(hist, groups)
    for k in (0, 7):
        for i in range(parts):
            near = sum(bin(int(codes[k, i] - first[i]) ^ int(c - first[i])).count("1") <= 2 for c in codes[:, i])
            assert counts[2, codes[k, i]] == near
    limits = simhash.allocate(codes, counts, 4, [len(g) for g in groups])
    assert (limits.sum(1) == 4 + 1 - parts).all() and limits.min() >= -1
    for cell in (simhash.CELL, 3):  # a tiny cell makes grids of every value
        old, simhash.CELL = simhash.CELL, cell
        rows = simhash.signature_rows(fp, groups, hist, counts, 4)
        simhash.CELL = old
        u, v = simhash.links_within(rows, 4)
        place = {int(x): i for i, x in enumerate(fp)}
        label = np.arange(len(fp))
        simhash.forest(np.array([place[int(x)] for x in u]), np.array([place[int(x)] for x in v]), label)
        assert label.tolist() == plain_components([int(x) for x in fp], 4)


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, k) for k in range(201, 260)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(70)]
    got = {r.u: r.root for r in simhash.connect(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(x, x) == low for x, low in label.items())


def test_near_duplicates(docs, odd_rows):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(4)]
    rows = list(odd_rows)
    for k, b in enumerate(base):
        rows += [(100 + 10 * k + j, " ".join(w if i != 7 * j else "zz" for i, w in enumerate(b.split()))) for j in range(6)]
    got = simhash.components(docs(rows)).collect()
    assert len(got) == len(rows)
    fps = [plain(t) for _, t in rows]
    comp = plain_components(fps, 4)
    want = []
    for (k, _), f, c in zip(rows, fps, comp, strict=True):
        ids = [i for (i, _), d in zip(rows, comp, strict=True) if d == c and i is not None]
        want.append((k, f"{f:016x}", min(ids) if ids else None))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    kept = sorted(str(r.doc_id) for r in simhash.near_dedup(docs(rows)).collect())
    assert kept == sorted({str(k) for k, _, c in want if k == c})
    assert simhash.components(docs([])).count() == 0 and simhash.near_dedup(docs([])).count() == 0


def test_near_dedup_keeps_a_row_for_its_own_component(docs):
    """Null and repeated ids: another component's kept id keeps no copy."""
    texts = ["one text about rivers and hills in spring", "quite another one, of ships at sea", "a third: bread, salt and oil"]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (2, texts[2]), (5, "the fifth has a text of its own")]
    got = [(r.doc_id, r.text) for r in simhash.near_dedup(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
