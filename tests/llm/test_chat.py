"""Chat formatting: exact Viterbi, held-out accuracy on transcripts, crossing conversations, odd rows."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
from axismap.llm import chat
from helpers import DATA


def any_hmm(seed):
    r = np.random.default_rng(seed)
    counts = {("start", s): int(r.integers(9)) for s in range(chat.STATES)} | {(f"after={a}", s): int(r.integers(9)) for a in range(chat.STATES) for s in range(chat.STATES)}
    counts |= {(f"marker={m}", s): int(r.integers(9)) for m in ("user", "-") for s in range(chat.STATES)}
    return chat.fit_counts(counts)


def test_viterbi_is_the_best_path():
    rng = random.Random(6)
    for seed in range(20):
        hmm = any_hmm(seed)
        seen = [chat.observe(rng.choice(["User: hi", "Assistant: x", "plain", "- a", "why?"]), False, k == 0) for k in range(4)]
        score = lambda p: hmm.start[p[0]] + sum(hmm.scores(s)[r] for s, r in zip(seen, p, strict=True)) + sum(hmm.follow[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        path = chat.viterbi(hmm, seen)
        assert abs(score(path) - max(score(p) for p in product(range(chat.STATES), repeat=4))) < 1e-9
        total = chat.summed(hmm, seen[:2], True)[0][:, None] + chat.summed(hmm, seen[2:], False)
        assert abs(total.max() - score(path)) < 1e-9
        # a line within a turn has the role of the line before
        assert path[0] % 2 == 0 and all(b % 2 == 0 or a // 2 == b // 2 for a, b in zip(path, path[1:], strict=False))


def test_markers_are_evidence_and_no_rule():
    counts = {("start", 0): 1, ("start", 4): 1, ("marker=user", 0): 90, ("marker=-", 0): 10, ("marker=assistant", 4): 50, ("marker=-", 4): 50}
    assert chat.viterbi(chat.fit_counts(counts), [chat.observe("User: x", False, True)]) == [0]


def test_roles_of_held_out_transcripts(spark):
    conv = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/conversations.parquet")
    truth = {(r.conv_id, r.turn): r.role for r in conv.collect()}
    got = chat.recover(chat.as_transcripts(conv)).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(truth[r.conv_id, r.turn] == r.role_pred for r in out) >= 0.85 * len(out)
    assert sum(r.n_turns == 1 for r in out) >= 0.8 * len(out)


def test_a_conversation_over_all_partitions_decodes_as_one(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 64)
    conv = spark.read.parquet(f"{DATA}/conversations.parquet")
    one = chat.as_transcripts(conv).selectExpr("0 AS conv_id", "conv_id * 100 + turn AS turn", "role", "text").cache()
    got = sorted(chat.recover(one, modulus=1 << 30).collect(), key=lambda r: r.turn)
    blocks = chat._blocks(one, "conv_id", "turn", "role", "text", 1 << 30)
    hmm = chat.fit(blocks, chat._tell_ends(blocks))
    lines = [chat.lines_of(t) for _, t in sorted((r.turn, r.text) for r in one.collect())]
    flat = [x for own in lines for x in own]
    path = chat.viterbi(hmm, chat._seen(flat, True))
    assert "".join(r.rendered for r in got) == chat.render(flat, path, False) + "<|im_end|>\n"
    starts = [sum(map(len, lines[:k])) for k in range(len(lines))]
    assert [r.role_pred for r in got] == [chat.ROLES[path[s] // 2] if own else None for s, own in zip(starts, lines, strict=True)]


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 1, "user", "x"), (1, None, "tool", "y"), (None, 3, "assistant", "Assistant: hi"), (2, 0, "user", "User: q?"), (2, 0, "user", "User: q?"), (3, 0, "user", "same"), (3, 0, "system", "same"), (4, 0, "user", " \n ")]
    df = spark.createDataFrame([(*r, "clash", "c", "c") for r in rows], "conv_id long, turn long, role string, text string, tag string, conv string, out string")
    got = chat.recover(df).collect()
    assert len(got) == len(rows)
    assert [(r.role_pred, r.rendered, r.n_turns) for r in got if r.conv_id == 4] == [(None, "", 0)]
    assert "".join(r.rendered for r in got if r.conv_id == 2).endswith("<|im_end|>\n")
    assert chat.recover(df.limit(0)).count() == 0
    assert chat.as_transcripts(df).count() == len(rows) and chat.as_transcripts(df.limit(0)).count() == 0


def test_transcripts_with_and_without_markers(spark, docs):
    conv = chat.as_transcripts(spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/conversations.parquet"))
    blocks = chat._blocks(conv, "conv_id", "turn", "role", "text")
    hmm = chat.fit(blocks, chat._tell_ends(blocks))
    text = "Human: What is it?\nsecond line\n\nAI: This.\nAnd that.\n\n### User\nMore?\n\n**Assistant:** Ok."
    got = chat.parse_transcripts(docs([(1, text), (2, None), (3, "")]), hmm).orderBy("turn").collect()
    assert [r.role_pred for r in got] == ["user", "assistant", "user", "assistant"]
    assert got[2].rendered == "<|im_start|>user\nMore?<|im_end|>\n" and got[3].rendered == "<|im_start|>assistant\nOk.<|im_end|>\n"
    # a marker alone does not decide, and an answer without one is no part of the question
    plain = chat.parse_transcripts(docs([(1, "User: Tell me.\n\nIt is so. " + "Words and more words of an answer that goes on. " * 12)]), hmm).orderBy("turn").collect()
    assert [r.role_pred for r in plain] == ["user", "assistant"]
