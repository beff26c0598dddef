from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from axismap.llm import suffix
from axismap.llm.tables import give_room


def plain(rows):
    """(n_bytes, n_removed, n_spans, kept) per row, by a set of all windows so far."""
    tie = lambda r: int.from_bytes(hashlib.sha256((r[1] or "").encode()).digest()[:8], "big")
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r))):
        x = (t or "").encode()
        away = bytearray(len(x))
        for p in range(len(x) - suffix.LENGTH + 1):
            w = x[p : p + suffix.LENGTH]
            if w in seen:
                away[p : p + suffix.LENGTH] = b"\1" * suffix.LENGTH
            seen.add(w)
        spans = sum(1 for i, a in enumerate(away) if a and not (i and away[i - 1]))
        kept = bytes(c for c, a in zip(x, away, strict=True) if not a)
        out.append((k, len(x), sum(away), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def shown(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    rng = random.Random(seed)
    text = np.frombuffer(bytes(rng.choice(b"abz" if seed % 2 else b"a") for _ in range(300)) + b"abcabcabc" * 20, np.uint8)
    wanted = np.array([rng.random() < 0.6 for _ in text])
    raw = text.tobytes()
    for depth in (5, 400):
        got = suffix.suffix_order(text, wanted, depth).tolist()
        assert sorted(got) == np.flatnonzero(wanted).tolist()
        assert [raw[i : i + depth] for i in got] == sorted(raw[i : i + depth] for i in np.flatnonzero(wanted))
        if depth == 400:
            assert got == sorted(got, key=lambda i: raw[i:])


def test_common_prefixes():
    text = np.frombuffer(b"abcabdabc" + b"-" * 10, np.uint8)
    assert suffix.common_prefixes(text, np.array([0, 3, 6, 1]), 4).tolist() == [0, 2, 2, 0]


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdé 日") for _ in range(n))
    shared, loop = line(160), "ab" * 90
    rows = [(k, line(rng.randint(0, 300))) for k in range(25)]
    rows += [(50 + k, line(rng.randint(0, 120)) + shared + line(rng.randint(0, 120))) for k in range(12)]
    rows += [(80, loop), (81, "c" * 400), (82, "d" + "c" * 400), (83, loop + shared + shared), (84, shared[:99]), (85, shared[:100])]
    rows += [(90, rows[0][1] + "."), (91, rows[0][1]), (92, rows[30][1]), (92, rows[30][1])]
    return rows


@pytest.mark.parametrize("hot", [1 << 14, 3])
def test_report_against_all_windows(docs, odd_rows, hot, monkeypatch):
    rows = corpus(1) + odd_rows
    monkeypatch.setattr(suffix, "HOT", hot)
    assert shown(suffix.report(docs(rows))) == plain(rows)


def test_hot_hashes_deal_single_windows():
    """A block asked to treat all its keys as hot sends windows by their own hash."""
    import pyarrow as pa
    import zstandard

    rows = corpus(3)
    batch = pa.record_batch({"key": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    block = suffix.Block(zstandard.compress(sink.getvalue()))
    block.find_ranks()
    block.find_anchors()
    starts = {s + k for s, n in zip(block.starts.tolist(), block.sizes.tolist(), strict=True) for k in range(n - suffix.LENGTH + 1)}
    for mark in (2, 3):
        told = {t: zstandard.decompress(zstandard.compress(bytes([mark]) * len(k))) for t, k, _ in block.keys_by_task(5)}
        entries, gone = block.contexts(5, told)
        assert mark == 2 or set(entries["windows"].tolist()) == {1}
        sent = [p for lo, n in zip(entries["lo"].tolist(), entries["windows"].tolist(), strict=True) for p in range(lo, lo + n)]
        windows = {block.raw[p : p + suffix.LENGTH] for p in starts}
        assert len(sent) == len(windows) and {block.raw[p : p + suffix.LENGTH] for p in sent} == windows
        assert set(sent) | set(np.flatnonzero(gone).tolist()) == starts
    own, _ = block.contexts(5, {t: b"\1" * len(k) for t, k, _ in block.keys_by_task(5)})
    assert not len(own)  # what only this block has is settled here


def test_equal_windows_are_found_by_the_suffix_array_alone():
    rng = random.Random(2)
    part = bytes(rng.choice(b"abcd") for _ in range(300))
    contexts = [part, b"x" + part[:150], part, part[100:250] + b"y"]
    sizes = np.array([len(c) for c in contexts])
    gone = suffix.repeated_windows(np.frombuffer(b"".join(contexts), np.uint8), sizes, np.array([2, 0, 1, 3]))
    got = [g[: len(g) - suffix.LENGTH + 1] for g in np.split(gone, np.cumsum(sizes)[:-1])]
    order = sorted(range(4), key=[2, 0, 1, 3].__getitem__)
    seen, want = set(), {}
    for k in order:
        own = [contexts[k][p : p + suffix.LENGTH] for p in range(len(contexts[k]) - suffix.LENGTH + 1)]
        want[k] = [w in seen for w in own]
        seen |= set(own)
    assert [g.tolist() for g in got] == [want[k] for k in range(4)]


def test_ids_must_be_whole_numbers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError):
        suffix.report(df)


def test_blocks_and_chunks_of_long_texts(docs, monkeypatch):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh") for _ in range(1_100_000))
    rows = [(1, part), (2, part[500_000:700_000] + "!" + part[1_000_000:]), (3, "".join(rng.choice("xyz") for _ in range(5000)))]
    got = {r.doc_id: r for r in suffix.report(docs(rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 300_000 and got[2].n_spans == 2 and got[3].n_removed == 0


def test_cut_texts_keep_characters_and_columns(docs, odd_rows):
    rows = corpus(2) + [(k if k is None else k + 200, t) for k, t in odd_rows]  # ids that the corpus does not use
    df = docs(rows)
    got = suffix.remove_repeats(df)
    assert got.columns == df.columns and got.count() == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in suffix.report(df).collect()}
    texts = {k: (t or "").encode() for k, t in rows}
    for r in got.collect():
        if r.doc_id in texts and r.doc_id not in (92, 208, None):
            kept = len(texts[r.doc_id]) - by[r.doc_id, len(texts[r.doc_id])].n_removed
            assert kept <= len((r.text or "").encode()) <= kept + 6 * (1 + by[r.doc_id, len(texts[r.doc_id])].n_spans)
            assert r.key == "clash" and r.lang == "en"
    assert suffix.report(docs([])).count() == 0 and suffix.remove_repeats(docs([])).count() == 0


def test_anchors_of_a_block_take_little_memory():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(suffix.BLOCK_BYTES // 3000)]
    rows, sink = pa.table({"key": list(range(len(texts))), "text": texts}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    block = suffix.Block(zstandard.ZstdCompressor().compress(sink.getvalue()))
    tracemalloc.start()
    try:
        block.find_anchors()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (block.hi - block.lo + 1).sum() == sum(len(t) - suffix.LENGTH + 1 for t in texts)
    assert peak < 12 * suffix.BLOCK_BYTES


def test_executors_are_told_to_return_memory(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = whole()
    give_room(spark)
    assert whole() > before
