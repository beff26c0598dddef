from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from itertools import accumulate

import xxhash
from axismap.llm import shard


def check(rows, got, n):
    assert sorted(str((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for k, t in rows) == sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got)
    by = {}
    for r in got:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    return [sum(r["size"] for r in by.get(k, [])) for k in range(n)]


def test_near_equal_bytes_with_a_hot_text(docs):
    rng = random.Random(3)
    rows = [(k, "hot text " * 12 if k % 3 == 0 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300)))) for k in range(6000)]
    df = shard.shard(docs(rows), 8)
    got = df.collect()
    sizes = check(rows, got, 8)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    shards_of = {}
    for r in got:
        shards_of.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(("hot text " * 12).encode())
    assert len(shards_of[hot]) > 1 and all(len(s) == 1 for k, s in shards_of.items() if k != hot)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows_and_empty_table(docs, odd_rows):
    check(odd_rows, shard.shard(docs(odd_rows), 4).collect(), 4)
    assert shard.shard(docs([]), 4).count() == 0


def by_plain_sums(rows, n):
    """Shards recomputed without draws, ranges or parts: big texts to the emptiest shard, then whole groups along the hash."""
    groups = {}
    for _, t in rows:
        raw = (t or "").encode()
        h = xxhash.xxh64_intdigest(raw, 42)
        h -= (h >> 63) << 64
        groups.setdefault(h, []).append(len(raw) + 16)
    total = sum(map(sum, groups.values()))
    load, out = [0] * n, {}
    big = sorted((h for h, g in groups.items() if sum(g) >= shard.BIG * total / n), key=lambda h: (-sum(groups[h]), h))
    for h in big:
        assert sum(groups[h]) <= total / n
        out[h] = load.index(min(load))
        load[out[h]] += sum(groups[h])
    rest = [max(0, total / n - x) for x in load]
    left = total - sum(load)
    keys = sorted(set(groups) - set(big))
    ends = list(accumulate(sum(groups[h]) for h in keys))
    cuts = []
    for target in list(accumulate(x * left / sum(rest) for x in rest))[:-1]:
        i = bisect_right(ends, target)
        start = ends[i - 1] if i else 0
        cuts.append(i + 1 if i < len(ends) and target - start >= (ends[i] - start) / 2 else i)
    return out | {h: sum(c <= k for c in cuts) for k, h in enumerate(keys)}


def test_shards_are_those_of_plain_sums(docs, monkeypatch):
    monkeypatch.setattr(shard, "FINE", 0)
    rng = random.Random(5)
    rows = [(k, f"text {rng.randint(0, 900)} " * rng.choice([1, 1, 5])) for k in range(1500)] + [(k, "copied " * 30) for k in range(40)]
    want = by_plain_sums(rows, 6)
    texts = {zlib.crc32(t.encode()): xxhash.xxh64_intdigest(t.encode(), 42) for _, t in rows}
    got = shard.shard(docs(rows), 6).collect()
    sizes = check(rows, got, 6)
    assert {r.text_crc32: r.shard for r in got} == {c: want[h - ((h >> 63) << 64)] for c, h in texts.items()}
    assert max(sizes) - min(sizes) < 0.06 * sum(sizes) / 6


def test_overfull_ranges_are_subdivided(docs, monkeypatch):
    monkeypatch.setattr(shard, "RANGES", 1)
    monkeypatch.setattr(shard, "PARTS", 4)
    rows = [(k, f"text {k % 700}") for k in range(2000)]
    sizes = check(rows, shard.shard(docs(rows), 4).collect(), 4)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 4


def test_rows_that_repeat_one_id_and_text_are_spread(docs):
    rows = [(7, "one text")] * 900 + [(k, f"other {k}") for k in range(900)]
    sizes = check(rows, shard.shard(docs(rows), 5).collect(), 5)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 5
