"""Chat formatting: a hidden Markov model parses plain transcripts, line by line, into turns.

A transcript is lines of text. Some turns start with a speaker marker ("User:", "###
Assistant", "<|im_start|>system"), some with none, and a turn has any number of lines. The
hidden state of a line is a role and whether a turn starts there; a line within a turn has
the role of the line before. A line emits what it shows: a marker's class, its place,
length, shape and first letter. Viterbi recovers the likeliest states of all lines, and
turns are then rendered canonically, one marker line each. What a marker says is evidence
like any other: how often each role shows it is counted, as are all other features.

A transcript comes as rows (conversation, number, text) whose lines follow each other; where
rows end says nothing, so a row may start within a turn. Counts are taken over all labelled
rows (a row's first line starts a turn of its role), with add-one smoothing; one aggregated
table of a few hundred rows comes to the driver. Rows are range-partitioned by conversation
and number and written in blocks of at most ``SEGMENT`` rows, so that a conversation of any
length is spread over tasks. One that lies within a block is decoded there. Of one that
crosses blocks, each block is summed up in max-plus matrices (6 x 6); only those are gathered
by conversation, and fix the states at the ends of each block, between which it is then
decoded. That is exact Viterbi. The driver holds one row per shuffle partition: the
conversations at its ends.

Defined results: blank lines are no observations (a line after one shows that); a null or
blank text has no line, so no role and an empty rendering; a null or unknown role is
unlabelled, as are equal rows whose roles differ; a null number stands first; equal numbers
are ordered by text, and repeated rows stay repeated; ties between paths go to the state that
sorts first; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.llm.tables import stash

ROLES = ("assistant", "system", "user")
#: A state is 2 x role + 1 within a turn, 2 x role at its first line.
STATES = 2 * len(ROLES)
SEGMENT = 4096
SEGMENT_BYTES = 4 << 20
FEATURES = ("marker", "place", "length", "shape", "letter")
#: What speakers are called in transcripts.
MARKERS = {
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "a"),
    "system": ("system", "instructions", "context", "sys"),
    "user": ("user", "human", "question", "prompter", "q", "customer"),
}
_ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}
_MARKER = re.compile(r"^\s*(?:<\|im_start\|>|#{1,4}\s*|\[|\*\*|<\|)?\s*([A-Za-z]{1,12})\s*(?:\|>|\]|\*\*)?\s*(?::|$)\s*(?:\*\*)?\s*")
_TURN_END = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>)\s*$")
#: How a transcript may show a speaker, and what ends a turn there.
STYLES = (("{}: ", ""), ("### {}\n", ""), ("<|im_start|>{}\n", "<|im_end|>"), ("[{}]\n", ""), ("**{}:** ", ""))


def marker(line: str) -> tuple[str | None, int]:
    """The role that a line's speaker marker names, and where the text goes on."""
    found = _MARKER.match(line)
    role = _ROLE_OF.get(found[1].lower()) if found else None
    return (role, found.end()) if role else (None, 0)


def lines_of(text: str | None) -> list[tuple[str, bool]]:
    """The lines of a text that aren't blank, and whether a blank one stands before."""
    out, gap = [], False
    for line in (text or "").split("\n"):
        if line.strip():
            out.append((line, gap))
            gap = False
        else:
            gap = True
    return out


def observe(line: str, gap: bool, first: bool) -> tuple[str, ...]:
    """What a line shows, in the order of FEATURES."""
    role, at = marker(line)
    named = role or ("other" if _MARKER.match(line) else "-")
    body = _TURN_END.sub("", line[at:]).strip()
    shape = "none" if not body else "list" if re.match(r"(?:[-*]|\d+[.)])\s", body) else "code" if body.startswith("```") else "ask" if body.endswith("?") else "stop" if body.endswith((".", "!")) else "say"
    letter = "-" if not body else "up" if body[0].isupper() else "low" if body[0].islower() else "digit" if body[0].isdigit() else "sign"
    return named, "first" if first else "gap" if gap else "next", str(min(9, len(body.split()).bit_length())), shape, letter


def shown(line: str) -> str:
    """A line without its speaker marker and end mark."""
    return _TURN_END.sub("", line[marker(line)[1] :]).strip()


class Hmm:
    """Log probabilities: start (states), follow (states x states), and emissions by feature."""

    def __init__(self, start: np.ndarray, follow: np.ndarray, emit: dict[tuple[str, str], np.ndarray]) -> None:
        self.start, self.follow, self.emit = start, follow, emit
        self.known: dict[tuple[str, ...], np.ndarray] = {}

    def scores(self, seen: tuple[str, ...]) -> np.ndarray:
        """Log likelihood of each state."""
        if seen not in self.known:
            self.known[seen] = sum((self.emit.get(f, 0.0) for f in zip(FEATURES, seen, strict=True)), np.zeros(STATES))
        return self.known[seen]


def viterbi(hmm: Hmm, seen: list[tuple[str, ...]], before: int | None = None, after: np.ndarray | None = None) -> list[int]:
    """Likeliest states of consecutive lines, given the state before and scores of what follows."""
    if not seen:
        return []
    best, back = (hmm.start if before is None else hmm.follow[before]) + hmm.scores(seen[0]), []
    for s in seen[1:]:
        step = best[:, None] + hmm.follow
        back.append(step.argmax(0))
        best = step.max(0) + hmm.scores(s)
    path = [int((best if after is None else best + after).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def summed(hmm: Hmm, seen: list[tuple[str, ...]], first: bool) -> np.ndarray:
    """The max-plus matrix of lines: best score from the state before to the last state."""
    total = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for k, s in enumerate(seen):
        if k == 0:
            total = (np.tile(hmm.start, (STATES, 1)) if first else hmm.follow) + hmm.scores(s)
        else:
            total = (total[:, :, None] + hmm.follow[None]).max(1) + hmm.scores(s)
    return total


def fit_counts(counts: dict[tuple[str, int], int]) -> Hmm:
    """Log probabilities with add-one smoothing from (what, state) counts, over the steps that can be."""
    of = lambda f: np.array([counts.get((f, s), 0) for s in range(STATES)], np.float64)
    starts = np.arange(STATES) % 2 == 0

    def logs(n: np.ndarray, can: np.ndarray) -> np.ndarray:
        n = np.where(can, n + 1, 0)
        return np.where(can, np.log(np.maximum(n, 1) / n.sum()), -np.inf)

    goes_on = lambda s: np.arange(STATES) == s // 2 * 2 + 1
    follow = np.stack([logs(of(f"after={s}"), starts | goes_on(s)) for s in range(STATES)])
    emit = {}
    for name in FEATURES:
        values = sorted({f for f, _ in counts if f.startswith(f"{name}=")})
        total = sum((of(v) for v in values), np.zeros(STATES)) + len(values)
        emit |= {(name, v.partition("=")[2]): np.log((of(v) + 1) / total) for v in values}
    return Hmm(logs(of("start"), starts), follow, emit)


def _picked(*what: object) -> int:
    return zlib.crc32("|".join(map(str, what)).encode())


def as_transcripts(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Labelled turns written out as people write transcripts: conv, turn, role, text.

    A conversation has one style and one name for each role; a quarter of its turns, by a
    hash, and those without a known role have no marker; half of the conversations have
    blank lines between turns.
    """
    slim = conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").alias("text"))

    def write(c: object, t: object, r: str | None, x: str | None) -> str:
        head, tail = STYLES[_picked(c, "style") % len(STYLES)]
        body = x or ""
        if r in MARKERS and _picked(c, t, "marker") % 4:
            names = MARKERS[r]
            name = names[_picked(c, r, "name") % len(names)]
            body = head.format(name if head.startswith("<") else name.capitalize()) + body + tail
        return ("\n" if _picked(c, "gap") % 2 else "") + body

    def run(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(4)]
            yield b.set_column(3, "text", pa.array([write(*r) for r in zip(*cols, strict=True)], pa.string()))

    kinds = slim.schema
    return slim.mapInArrow(run, kinds).select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))


def _blocks(rows: DataFrame, conv: str, turn: str, role: str, text: str, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Blocks of rows in order: what stands before, whether the last conversation goes on, body."""
    slim = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").alias("text"))
    tag = F.when(F.col("conv").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv").cast("string")))
    order = ["tag", F.col("turn").asc_nulls_first(), "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.withColumn("tag", tag).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        before: tuple[str | None, str | None] = (None, None)
        held: list[pa.RecordBatch] = []
        n = size = 0

        def row(body: pa.Table, goes_on: bool | None) -> pa.RecordBatch:
            nonlocal made, before
            ids = ["" if x == "n" else x[1:] for x in body.column("tag").to_pylist()]
            body = body.append_column("out", pa.array([zlib.crc32(i.encode()) % modulus == remainder for i in ids], pa.bool_()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema) as out:
                out.write_table(body)
            tags = body.column("tag")
            last = truth(body.column("role")[-1].as_py(), body.column("text")[-1].as_py())
            cells = [part << 32 | made, part, before[0], before[1], goes_on, tags[0].as_py(), tags[-1].as_py(), str(last[-1]) if last else None, sink.getvalue().to_pybytes()]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.binary()]
            made, before = made + 1, (cells[6], cells[7])
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["block", "part", "prev_tag", "prev_role", "goes_on", "first_tag", "last_tag", "last_role", "body"])

        waiting: pa.Table | None = None
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part_of = b.slice(k, 256)
                held.append(part_of)
                n, size = n + part_of.num_rows, size + part_of.nbytes
                if n >= SEGMENT or size >= SEGMENT_BYTES:
                    now = pa.Table.from_batches(held)
                    if waiting is not None:
                        yield row(waiting, waiting.column("tag")[-1].as_py() == now.column("tag")[0].as_py())
                    waiting, held, n, size = now, [], 0, 0
        if held:
            now = pa.Table.from_batches(held)
            if waiting is not None:
                yield row(waiting, waiting.column("tag")[-1].as_py() == now.column("tag")[0].as_py())
            waiting = now
        if waiting is not None:
            yield row(waiting, None)

    return ranged.mapInArrow(run, "block bigint, part int, prev_tag string, prev_role string, goes_on boolean, first_tag string, last_tag string, last_role string, body binary")


def truth(role: str | None, text: str | None) -> list[int]:
    """The states of a labelled row's lines; none if it has no known role."""
    return [2 * ROLES.index(role) + (k > 0) for k in range(len(lines_of(text)))] if role in ROLES else []


def _tell_ends(blocks: DataFrame) -> dict[int, tuple[str | None, str | None, str | None]]:
    """By partition: tag and role before it, tag after it (a row per shuffle partition)."""
    ends = blocks.groupBy("part").agg(
        F.min_by("first_tag", "block").alias("first"), F.max_by("last_tag", "block").alias("last"), F.max_by(F.coalesce("last_role", F.lit("")), "block").alias("role")
    ).orderBy("part").collect()
    return {
        r["part"]: (ends[k - 1]["last"] if k else None, (ends[k - 1]["role"] or None) if k else None, ends[k + 1]["first"] if k + 1 < len(ends) else None)
        for k, r in enumerate(ends)
    }


def _runs(r: dict, ends: dict) -> list[tuple[str, int, int, bool, bool, str | None]]:
    """(tag, from, to, goes on from before, goes on after, role before) of a block's conversations."""
    tags = pa.ipc.open_stream(r["body"]).read_all().column("tag").to_pylist()
    prev, after = (r["prev_tag"], r["prev_role"]), r["goes_on"]
    if prev[0] is None:
        prev = ends[r["part"]][:2]
    if after is None:
        after = ends[r["part"]][2] == tags[-1]
    out, at = [], 0
    for tag, group in groupby(tags):
        n = sum(1 for _ in group)
        joined = at == 0 and prev[0] == tag
        out.append((tag, at, at + n, joined, after and at + n == len(tags), prev[1] if joined else None))
        at += n
    return out


def _rows(batches, columns: tuple[str, ...]):
    for b in batches:
        for cells in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            yield dict(zip(columns, cells, strict=True))


_HEAD = ("block", "part", "prev_tag", "prev_role", "goes_on", "body")


def _columns(body: bytes, *names: str) -> list[list]:
    table = pa.ipc.open_stream(body).read_all()
    return [table.column(c).to_pylist() for c in names]


def fit(blocks: DataFrame, ends: dict) -> Hmm:
    """The model of all labelled rows in ``blocks`` whose conversation is not held out."""

    def run(batches):
        seen: Counter[tuple[str, int]] = Counter()
        for r in _rows(batches, _HEAD):
            turns, roles, texts, out = _columns(r["body"], "turn", "role", "text", "out")
            for _, a, b, joined, _, before in _runs(r, ends):
                labels = roles[a:b]
                for _, same in groupby(range(a, b), key=lambda k: (turns[k], texts[k])):  # noqa: B023
                    same = list(same)
                    if len({roles[k] for k in same}) > 1:
                        labels[same[0] - a : same[-1] - a + 1] = [None] * len(same)
                last, first = (int(before) if before else None), not joined
                for k in range(a, b):
                    states = truth(labels[k - a], texts[k])
                    for i, (line, gap) in enumerate(lines_of(texts[k])):
                        state = states[i] if states else None
                        if state is not None and not out[k]:
                            for f in zip(FEATURES, observe(line, gap, first), strict=True):
                                seen["=".join(f), state] += 1
                            if first or last is not None:
                                seen["start" if first else f"after={last}", state] += 1
                        last, first = state, False
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["feature", "state", "n"])

    counted = blocks.select(*_HEAD).mapInArrow(run, "feature string, state int, n bigint").groupBy("feature", "state").agg(F.sum("n").alias("n"))
    return fit_counts({(r["feature"], r["state"]): r["n"] for r in counted.collect()})


def _seen(lines: list[tuple[str, bool]], first: bool) -> list[tuple[str, ...]]:
    return [observe(x, gap, first and k == 0) for k, (x, gap) in enumerate(lines)]


def _chained(blocks: DataFrame, ends: dict, hmm: Hmm) -> DataFrame:
    """(block, tag, before, last): states at the ends of each block's share of a crossing conversation."""

    def run(batches):
        for r in _rows(batches, _HEAD):
            (texts,) = _columns(r["body"], "text")
            found = []
            for tag, a, b, joined, on, _ in _runs(r, ends):
                if joined or on:
                    lines = [x for t in texts[a:b] for x in lines_of(t)]
                    found.append((r["block"], tag, len(lines), summed(hmm, _seen(lines, True), True)[0].tobytes(), summed(hmm, _seen(lines, False), False).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate([pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()])], ["block", "tag", "n", "first", "total"])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        best, back = None, []
        for n, first, total in zip(*(table.column(c).to_pylist() for c in ("n", "first", "total")), strict=True):
            if best is None:  # no line yet: the conversation starts in the first block that has one
                best = np.frombuffer(first) if n else None
                back.append(None)
                continue
            step = best[:, None] + np.frombuffer(total).reshape(STATES, STATES)
            back.append(step.argmax(0))
            best = step.max(0)
        at = None if best is None else int(best.argmax())
        last, before = [], []
        for b in reversed(back):
            last.append(at)
            at = None if b is None else int(b[at])
            before.append(at)
        return pa.table({"block": table.column("block"), "tag": table.column("tag"), "before": pa.array(before[::-1], pa.int32()), "last": pa.array(last[::-1], pa.int32())})

    return blocks.select(*_HEAD).mapInArrow(run, "block bigint, tag string, n bigint, first binary, total binary").groupBy("tag").applyInArrow(solve, "block bigint, tag string, before int, last int")


def render(lines: list[tuple[str, bool]], path: list[int], opened: bool) -> str:
    """The canonical form of consecutive lines: a marker line for each turn that starts; ``opened`` if one stands open before."""
    out = []
    for (line, gap), state in zip(lines, path, strict=True):
        body = shown(line)
        if state % 2 == 0:
            out.append(("<|im_end|>\n" if opened else "") + f"<|im_start|>{ROLES[state // 2]}" + (f"\n{body}" if body else ""))
        elif body:
            out.append(("\n\n" if gap else "\n") + body)
        opened = True
    return "".join(out)


def recover(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """A row per row of a transcript: conv, turn, held_out, role_pred (of its first line), n_turns (that start in it), rendered.

    In order, the ``rendered`` of a conversation are its canonical form. Roles are counted
    only in conversations whose id's CRC-32 does not leave ``remainder``; no role is read
    when lines are decoded.
    """
    kind = {c: rows.select(F.col(f"`{c}`")).schema[c].dataType.simpleString() for c in (conv, turn)}
    blocks = stash(_blocks(rows, conv, turn, role, text, modulus, remainder), "chat-blocks")
    ends = _tell_ends(blocks)
    hmm = fit(blocks, ends)
    fixed = stash(_chained(blocks, ends, hmm), "chat-chained")
    told = fixed.groupBy("block").agg(F.collect_list(F.struct("tag", "before", "last")).alias("told"))

    def run(batches):
        for r in _rows(batches, (*_HEAD, "told")):
            body = pa.ipc.open_stream(r["body"]).read_all().combine_chunks()
            texts = body.column("text").to_pylist()
            given = {t["tag"]: (t["before"], t["last"]) for t in r["told"] or []}
            names, turns, forms = [], [], []
            for tag, a, b, joined, on, _ in _runs(r, ends):
                before, last = given[tag] if joined or on else (None, None)
                after = None if last is None else np.where(np.arange(STATES) == last, 0.0, -np.inf)
                lines = [lines_of(t) for t in texts[a:b]]
                path = viterbi(hmm, _seen([x for own in lines for x in own], before is None), before, after)
                at, opened = 0, before is not None
                for k, own in enumerate(lines):
                    states = path[at : at + len(own)]
                    at += len(own)
                    form = render(own, states, opened)
                    opened = opened or bool(own)
                    names.append(ROLES[states[0] // 2] if own else None)
                    turns.append(sum(s % 2 == 0 for s in states))
                    forms.append(form + ("<|im_end|>\n" if opened and not on and k == len(lines) - 1 else ""))
            cols = [body.column(c).combine_chunks() if isinstance(body.column(c), pa.ChunkedArray) else body.column(c) for c in ("conv", "turn", "out")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(turns, pa.int32()), pa.array(forms, pa.string())], [conv, turn, "held_out", "role_pred", "n_turns", "rendered"])

    return blocks.select(*_HEAD).join(told, "block", "left").mapInArrow(run, f"`{conv}` {kind[conv]}, `{turn}` {kind[turn]}, held_out boolean, role_pred string, n_turns int, rendered string")


def parse_transcripts(docs: DataFrame, hmm: Hmm, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Turns of whole transcripts, one text each: key, turn, role_pred, rendered. No shuffle; a text without lines has no turn."""
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for b in batches:
            at, out = [], []
            for k, x in enumerate(b.column(1).to_pylist()):
                lines = lines_of(x)
                path = viterbi(hmm, _seen(lines, True))
                starts = [i for i, s in enumerate(path) if s % 2 == 0]
                for n, (i, j) in enumerate(pairwise([*starts, len(path)])):
                    at.append(k)
                    out.append((n, ROLES[path[i] // 2], render(lines[i:j], path[i:j], False) + "<|im_end|>\n"))
            cols = [pa.array([o[k] for o in out], kind) for k, kind in enumerate([pa.int32(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], ["key", "turn", "role_pred", "rendered"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, turn int, role_pred string, rendered string").withColumnRenamed("key", key)
