from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from axismap.llm import packing
from tokenizers import Tokenizer


def whole_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_are_the_tokenizers(odd_rows):
    texts = [t or "" for _, t in odd_rows] + ["don't we're 'tis it's  two\n\nlines\t tab", "a\n b \n", "²x Ⅷ x² naïve— “quoted” 3.14 foo123 bar_baz!! end.", " lead", "trail ", "it' 's 's's", "é combining", "x\xa0y", "<|endoftext|>", "<|endoftext|> hi", "some <|endoftext|>glued<|endoftext|> words", "<|endoftext|", "a's!", "l'été, où?", "\r\n"]
    rng = random.Random(2)
    texts += ["".join(rng.choice("aB é.,!'\n 1²\t_-") for _ in range(60)) for _ in range(300)]
    texts += [" ".join("".join(rng.choice("abcdeéßñтоق語") for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ",", "_", "...", "\u0301"]) for _ in range(900)) for _ in range(3)]
    plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))]
    texts += ["".join(rng.choice(plain) for _ in range(200)) for _ in range(400)] + ["".join(rng.choice(" 'stdlmrve9") for _ in range(80)) for _ in range(200)] + [" " * 300 + "x", "y" * 3000]
    ids = packing.Ids()
    assert sum(map(ids._is_plain, texts[-602:-2])) == 600
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ids(texts)] == whole_ids(texts)


def test_pieces_and_sequences_of_odd_rows(docs, odd_rows):
    got = packing.best_fit_packing(docs(odd_rows)).collect()
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    want: dict = {}
    for (k, _), ids in zip(odd_rows, whole_ids([t for _, t in odd_rows]), strict=True):
        raw = np.array([*ids, packing.END_ID], "<u4").tobytes()
        want.setdefault(k, []).extend((i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(packing.cut(len(raw) // 4)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.best_fit_packing(docs([])).count() == 0


def test_cut():
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1) == [(0, 1)]
    assert packing.cut(2100) == [(0, 52), (52, 1024), (1076, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


def fewest_bins(lengths, capacity):
    best = len(lengths)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for k, b in enumerate(bins):
            if b + rest[0] <= capacity:
                go(rest[1:], [*bins[:k], b + rest[0], *bins[k + 1 :]])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best


def held(bins):
    out = Counter()
    for contents, n in bins.items():
        for size in contents:
            out[size] += n
    return out


def test_local_search_empties_bins():
    # three bins whose contents two can hold
    got = packing.local_search(Counter([(6, 5), (4, 4, 3), (3, 3, 2)]), 15)
    assert got.total() == 2 and held(got) == Counter([6, 5, 4, 4, 3, 3, 3, 2])
    rng, over = random.Random(1), 0
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        got = packing.pack_counts(Counter(lengths), 20)
        assert held(got) == Counter(lengths) and all(sum(c) <= 20 for c in got)
        over += got.total() - fewest_bins(lengths, 20)
    assert over <= 1


def test_search_needs_fewer_sequences_than_best_fit():
    rng = random.Random(9)
    counts = Counter(rng.randint(200, 500) for _ in range(4000))
    falling = packing.best_fit(counts, sorted(counts, reverse=True))
    got = packing.pack_counts(counts)
    assert held(falling) == held(got) == counts and got.total() < 0.97 * falling.total()
    # a class counts as one however many bins it stands for
    many = packing.pack_counts({k: n * 1000 for k, n in counts.items()})
    assert held(many) == Counter({k: n * 1000 for k, n in counts.items()}) and many.total() <= 1000 * 1.01 * got.total()


def test_best_fit_by_class_is_best_fit_by_piece():
    def one_by_one(lengths, capacity):
        bins = []
        for n in lengths:
            fits = [b for b in bins if sum(b) + n <= capacity]
            if fits:
                max(fits, key=sum).append(n)
            else:
                bins.append([n])
        return Counter(sum(b) for b in bins)

    rng = random.Random(4)
    for _ in range(50):
        counts = Counter(rng.randint(1, 30) for _ in range(80))
        order = sorted(counts, reverse=True)
        got = Counter()
        for contents, n in packing.best_fit(counts, order, 40).items():
            got[sum(contents)] += n
        assert got == one_by_one([k for k in order for _ in range(counts[k])], 40)


def test_rows_that_repeat_one_id_and_text_are_packed_apart(docs):
    got = packing.best_fit_packing(docs([(7, "one two three " * 40)] * 300)).collect()
    places = Counter((r.sequence_id, r.offset) for r in got)
    assert len(got) == 300 and max(places.values()) == 1
