"""Exact removal of repeated byte strings through suffix arrays of contested contexts.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a
document with a smaller id, or earlier in the same one). Every such string (window)
chooses the least hash of its ``GRAM``-byte grams as its anchor; equal windows choose
the same gram at the same place, so only occurrences of one gram need to be compared.

1. Documents are packed into compressed blocks (a written table, so that later
   rounds meet the same blocks). Each block sends the distinct hashes of its anchors.
2. A hash that occurs twice is contested, shared if in several blocks, and then hot
   beyond ``HOT`` occurrences. Blocks are told, and build the suffix array of their own contested windows: of equal ones
   the earliest stays, the others are gone before anything is sent (a combine on the
   sending side). Of what stays and has a shared hash, each run of windows with one
   anchor is sent as a context. For a hot hash each window goes alone, by its own hash, so that a passage
   held by a third of all documents is dealt over all tasks, once per block.
3. A task builds the suffix array of all contexts of one hash in the same way.
4. Blocks get the windows that are gone and cut their documents.

Suffix arrays come from two-stage sorting: suffixes smaller than their successors are
sorted directly, the rest follow from scans of the buckets. Adjacent common prefixes of
``LENGTH`` bytes or more mark equal windows; nothing else does.

What moves: about a ninth of the text's bytes as hashes, twice the compressed blocks,
and the contexts of contested anchors. Nothing is collected or broadcast. A block is at
least one text, so memory is bounded by ``BLOCK_BYTES`` or the longest text.

Defined results: ids are whole numbers (others are refused at once); null and empty texts
have no bytes and lose none, as do texts under ``LENGTH`` bytes; a null id comes after all
others; rows with one id are ordered by the digest of their text, then by place in the
input, so of repeated rows one keeps its bytes; an empty table gives an empty result;
other columns, whatever their names, pass through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axismap.llm.tables import give_back, give_room, kept_for, stash

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 2 << 20
CHUNK = 1 << 16
HOT = 1 << 14
SORT_BYTES = 1 << 20
TASK_BYTES = 8 << 20
_PLACE = np.uint64(CHUNK - 1)
_BYTE_HASH = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)
_ENTRY = np.dtype([("key", "<u8"), ("late", "u1"), ("doc", "<i8"), ("tie", "<u8"), ("at", "<i8"), ("row", "<i4"), ("lo", "<i8"), ("windows", "<i4")])


# --- suffix arrays -------------------------------------------------------------


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes that start where ``wanted`` holds, ordered by ``depth`` bytes at least.

    Two-stage sorting. A suffix is *rising* if it is smaller than its successor. Rising
    suffixes are sorted directly; within a bucket (one first byte) the falling ones
    stand before them and come out in order when the suffix after each is met in a scan.
    Suffixes that no wanted one depends on are left out.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)  # 1: next byte is larger, -1: smaller (or the end), 0: equal
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    decides = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    rising = step[decides] > 0
    next_rising = np.minimum.accumulate(np.where(rising, np.arange(n), n)[::-1])[::-1]
    mark = np.zeros(n + 2, np.int64)  # a wanted suffix needs those up to the next rising one
    start = np.flatnonzero(wanted)
    np.add.at(mark, start, 1)
    np.add.at(mark, next_rising[start] + 1, -1)
    needed = np.cumsum(mark[:n]) > 0

    raw = text.tobytes()
    direct = sorted(np.flatnonzero(needed & rising).tolist(), key=lambda i: raw[i : i + depth])
    falls = np.bincount(text[needed & ~rising], minlength=256)
    rises = np.bincount(text[needed & rising], minlength=256)
    first = np.cumsum(falls + rises) - falls - rises
    order = np.full(int(falls.sum() + rises.sum()), -1, np.int64)
    direct_at = np.repeat(first + falls - (np.cumsum(rises) - rises), rises) + np.arange(len(direct))
    order[direct_at] = direct
    order, head = order.tolist(), first.tolist()
    falling = (needed & ~rising).tobytes()
    if falling[n - 1]:
        order[head[raw[n - 1]]] = n - 1
        head[raw[n - 1]] += 1
    for i in order:
        if i > 0 and falling[i - 1]:
            c = raw[i - 1]
            order[head[c]] = i - 1
            head[c] += 1
    found = np.array(order, np.int64)
    return found[wanted[found]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``depth`` bytes."""
    out = np.zeros(len(order), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(text, depth)
    for k in range(1, len(order), 65536):
        now = windows[order[k : k + 65536]]
        differ = now != windows[order[k - 1 : k - 1 + len(now)]]
        out[k : k + len(now)] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def window_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each place on."""
    out = np.empty(max(0, len(text) - LENGTH + 1), np.uint64)
    for at in range(0, len(out), CHUNK):
        out[at : at + CHUNK] = _rolled(text[at : at + CHUNK + LENGTH - 1], LENGTH)
    return out


def _rolled(part: np.ndarray, length: int) -> np.ndarray:
    """A mixed hash of ``length`` bytes from each place on, put together from hashes of powers of two."""
    h, base, width = _BYTE_HASH[part], 0x9E3779B97F4A7C15, 1
    while 2 * width <= length:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & 0xFFFFFFFFFFFFFFFF, 2 * width
    if length > width:
        h = h[: -(length - width)] * np.uint64(base) + h[length - width :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def repeats(text: np.ndarray, wanted: np.ndarray, rank: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """By place, whether the wanted window that starts there equals one of smaller rank.

    Windows whose hash no other has equal none and are left out; the suffix array decides.
    """
    gone = np.zeros(len(text), bool)
    at = np.flatnonzero(wanted)
    if not len(at):
        return gone
    h = window_hashes(text)[at]
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    twice = np.zeros(len(text), bool)
    twice[at[by[np.r_[False, same] | np.r_[same, False]]]] = True
    # the suffix array is built of the bytes of these windows alone
    lo, n = _runs(twice)
    if not len(lo):
        return gone
    sizes = n + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    place = np.repeat(lo - starts, sizes) + np.arange(int(sizes.sum()))
    part = text[place]
    order = suffix_order(part, _marked(len(part), starts, n))
    cuts = np.flatnonzero(common_prefixes(part, order) < LENGTH)
    sizes = np.diff(np.r_[cuts, len(order)])
    several = np.repeat(sizes > 1, sizes)
    found = place[order[several]]
    ranks = rank(found)
    heads = np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1]
    if len(heads):
        gone[found] = ranks != np.repeat(np.minimum.reduceat(ranks, heads), sizes[sizes > 1])
    return gone


def repeated_windows(text: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By place in contexts laid end to end, whether some context of smaller rank has that window too."""
    starts = np.cumsum(sizes) - sizes
    wanted = _marked(len(text), starts, sizes - LENGTH + 1)
    return repeats(text, wanted, lambda at: rank[np.searchsorted(starts, at, side="right") - 1])


def _marked(n: int, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """By place, whether one of the intervals covers it."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + widths, n), -1)
    return np.cumsum(edge[:n]) > 0


def _by(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places that have it."""
    order = np.argsort(values, kind="stable")
    found, first = np.unique(values[order], return_index=True)
    if len(found):
        yield from zip(found.tolist(), np.split(order, first[1:]), strict=True)


def _ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run, by whether a run begins at each place but the first."""
    edge = np.flatnonzero(new)
    return np.r_[0, edge + 1], np.r_[edge, len(new)]


def _runs(mask: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, width) of the runs of set places (of one label)."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.r_[True, np.diff(at) != 1]
    if label is not None:
        new[1:] |= label[at[1:]] != label[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.r_[first, len(at)])


# --- blocks and anchors ----------------------------------------------------------


def pack_blocks(docs: DataFrame) -> DataFrame:
    """(block, size, body): rows of ``docs`` as compressed Arrow slices of about BLOCK_BYTES of text."""

    def run(batches):
        kept_for("suffix")
        task, made, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([c.take(pa.array(range(at, upto), pa.int64())) for c in b.columns], schema=b.schema))
                own = int(size[upto - 1] - (size[at - 1] if at else 0))
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([own], pa.int64()), pa.array([squeeze.compress(sink.getvalue())], pa.binary())], ["block", "size", "body"])
                made, at = made + 1, upto

    return docs.mapInArrow(run, "block bigint, size bigint, body binary")


class Block:
    """The rows of a block and their bytes end to end; once found, the anchors of all windows."""

    def __init__(self, body: bytes) -> None:
        self.rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all().combine_chunks()
        raw = [(t or "").encode() for t in self.rows.column("text").to_pylist()]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(raw)
        self.text = np.frombuffer(self.raw, np.uint8)

    def find_ranks(self) -> None:
        """What orders the rows: late (no id), doc, tie (digest), and their rank within the block."""
        keys = self.rows.column("key").to_pylist()
        self.late = np.array([k is None for k in keys], np.uint8)
        self.doc = np.array([k or 0 for k in keys], np.int64)
        ends = (self.starts + self.sizes).tolist()
        self.tie = np.array([int.from_bytes(hashlib.sha256(self.raw[a:b]).digest()[:8], "big") for a, b in zip(self.starts.tolist(), ends, strict=True)], np.uint64)
        self.rank = np.empty(len(self.doc), np.int64)
        self.rank[np.lexsort((np.arange(len(self.doc)), self.tie, self.doc, self.late))] = np.arange(len(self.doc))

    def find_anchors(self) -> None:
        """anchor, lo, hi (first and last window start) and key of each anchor, by place.

        Only the ends of runs stay of each chunk; arrays by window would take many times the block.
        """
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
        last = len(self.text) - LENGTH
        inside = np.zeros(max(0, last + 1), bool)
        for s, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            inside[s : max(s, s + n - LENGTH + 1)] = True
        step = CHUNK - LENGTH
        for at in range(0, max(0, last + 1), step):
            part = self.text[at : min(len(self.text), at + step + LENGTH - 1)]
            h = _rolled(part, GRAM)
            low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            span, width = LENGTH - GRAM + 1, 1
            while 2 * width <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if span > width:
                low = np.minimum(low[: -(span - width)], low[span - width :])
            chosen = (low & _PLACE).astype(np.int64)
            own = np.flatnonzero(inside[at : at + len(chosen)])
            if len(own):
                chosen = chosen[own]
                first, last_of = _ends((chosen[1:] != chosen[:-1]) | (own[1:] != own[:-1] + 1))
                found.append((chosen[first] + at, own[first] + at, own[last_of] + at, h[chosen[first]]))
        anchor, lo, hi, key = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(lo):  # an anchor may go on in the next chunk
            first, last_of = _ends((anchor[1:] != anchor[:-1]) | (lo[1:] != hi[:-1] + 1))
            anchor, lo, hi, key = anchor[first], lo[first], hi[last_of], key[first]
        self.anchor, self.lo, self.hi, self.key = anchor, lo, hi, key
        self.row = np.searchsorted(self.starts + self.sizes, self.lo, side="right")

    def keys_by_task(self, tasks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(task, sorted distinct keys, occurrences) of this block's anchors."""
        key, n = np.unique(self.key, return_counts=True)
        task = (key % np.uint64(tasks)).astype(np.int64)
        for t, part in _by(task):
            yield t, key[part], n[part].astype(np.uint32)

    def states(self, tasks: int, told: dict[int, bytes]) -> np.ndarray:
        """By anchor: 0 alone, 1 contested in this block, 2 shared with others, 3 hot, as the tasks have told."""
        known, state = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for t, keys, _ in self.keys_by_task(tasks):
            if t in told:
                marks = np.frombuffer(told[t], np.uint8)
                known.append(keys[marks > 0])
                state.append(marks[marks > 0])
        keys, marks = np.concatenate(known), np.concatenate(state)
        order = np.argsort(keys)
        keys, marks = keys[order], marks[order]
        if not len(keys):
            return np.zeros(len(self.key), np.uint8)
        at = np.minimum(np.searchsorted(keys, self.key), len(keys) - 1)
        return np.where(keys[at] == self.key, marks[at], 0).astype(np.uint8)

    def contexts(self, tasks: int, told: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(entries of the contexts to send, by place the windows that an earlier one here equals)."""
        state = self.states(tasks, told)
        busy = np.flatnonzero(state)
        wanted = _marked(len(self.text), self.lo[busy], self.hi[busy] - self.lo[busy] + 1)
        row_of = lambda at: np.searchsorted(self.starts + self.sizes, at, side="right")
        gone = repeats(self.text, wanted, lambda at: self.rank[row_of(at)] << 40 | at)
        of_place = np.full(len(self.text) + 1, -1, np.int32)  # the anchor by window, which stand in order of place
        of_place[_marked(len(self.text) + 1, self.lo, self.hi - self.lo + 1)] = np.repeat(np.arange(len(self.lo), dtype=np.int32), self.hi - self.lo + 1)
        stays = wanted & ~gone
        told_of = np.zeros(len(self.text), np.uint8)
        told_of[stays] = state[of_place[:-1][stays]]
        stays, hot = told_of >= 2, told_of == 3
        lo, n = _runs(stays & ~hot, of_place)
        alone = np.flatnonzero(hot)
        hashed = xxhash.xxh64_intdigest
        entries = np.zeros(len(lo) + len(alone), _ENTRY)
        entries["lo"], entries["windows"] = np.r_[lo, alone], np.r_[n, np.ones(len(alone), np.int64)]
        entries["key"] = np.r_[self.key[of_place[lo]], np.array([hashed(self.raw[s : s + LENGTH], GRAM) for s in alone.tolist()], np.uint64)]
        row = row_of(entries["lo"])
        entries["row"], entries["at"] = row, entries["lo"] - self.starts[row]
        entries["late"], entries["doc"], entries["tie"] = self.late[row], self.doc[row], self.tie[row]
        return entries, gone


def judge(entries: np.ndarray, bodies: bytes, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, start in its context, width) of the runs of windows that an earlier entry with its hash has too."""
    rank = np.empty(len(entries), np.int64)
    rank[np.lexsort((entries["at"], entries["row"], block, entries["tie"], entries["doc"], entries["late"]))] = np.arange(len(entries))
    sizes = entries["windows"].astype(np.int64) + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    _, group, n = np.unique(entries["key"], return_inverse=True, return_counts=True)
    chosen = np.argsort(group, kind="stable")
    chosen = chosen[n[group[chosen]] > 1]
    ends = np.cumsum(sizes[chosen])
    last = np.flatnonzero(np.r_[group[chosen][1:] != group[chosen][:-1], True]) + 1 if len(chosen) else np.zeros(0, np.int64)
    found = [(np.zeros(0, np.int64),) * 3]
    i = 0
    while i < len(chosen):  # whole groups of about SORT_BYTES together
        j = int(last[min(np.searchsorted(ends[last - 1], (ends[i - 1] if i else 0) + SORT_BYTES), len(last) - 1)])
        own = chosen[i:j]
        text = np.frombuffer(b"".join([bodies[a:b] for a, b in zip(starts[own].tolist(), (starts[own] + sizes[own]).tolist(), strict=True)]), np.uint8)
        at, width = _runs(repeated_windows(text, sizes[own], rank[own]))
        heads = np.cumsum(sizes[own]) - sizes[own]
        k = np.searchsorted(heads, at, side="right") - 1
        found.append((own[k], at - heads[k], width))
        i = j
    entry, at, width = (np.concatenate(x) for x in zip(*found, strict=True))
    return entry, at, width


# --- the rounds ---------------------------------------------------------------------


def _contested(blocks: DataFrame, tasks: int) -> DataFrame:
    """(block, task, marks): which of the keys that a block sent to a task are contested."""

    def send(batches):
        for b in batches:
            for number, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block = Block(body)
                block.find_anchors()
                sent = list(block.keys_by_task(tasks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(sent), pa.int64()), pa.array([t for t, _, _ in sent], pa.int64()), pa.array([k.tobytes() for _, k, _ in sent], pa.binary()), pa.array([n.tobytes() for _, _, n in sent], pa.binary())],
                    ["block", "task", "keys", "n"],
                )
        block = sent = body = b = None
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("n").to_pylist()]).astype(np.int64)
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total, shared = np.bincount(at, weights=n)[at], np.bincount(at)[at] > 1
        marks = np.split(((total > 1).astype(np.uint8) + shared + (shared & (total > HOT))).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])
        some = np.array([bool(m.any()) for m in marks])
        squeeze = zstandard.ZstdCompressor(level=3)
        kept = table.filter(pa.array(some)).select(["block", "task"])
        return kept.append_column("marks", pa.array([squeeze.compress(m.tobytes()) for m, s in zip(marks, some, strict=True) if s], pa.binary()))

    return blocks.select("block", "body").mapInArrow(send, "block bigint, task bigint, keys binary, n binary").groupBy("task").applyInArrow(meet, "block bigint, task bigint, marks binary")


def _told(pairs: list[dict]) -> dict[int, bytes]:
    unpack = zstandard.ZstdDecompressor()
    return {p["task"]: unpack.decompress(p["marks"]) for p in pairs or []}


def _pairs(lo: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([lo, n], 1).astype("<i8").tobytes()


def _judged(blocks: DataFrame, marks: DataFrame, tasks: int) -> DataFrame:
    """(block, gone): runs (start, width) of windows that are gone, several rows a block."""
    joined = blocks.join(marks.groupBy("block").agg(F.collect_list(F.struct("task", "marks")).alias("told")), "block")

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for number, body, told in zip(*(b.column(c).to_pylist() for c in ("block", "body", "told")), strict=True):
                block = Block(body)
                block.find_ranks()
                block.find_anchors()
                entries, gone = block.contexts(tasks, _told(told))
                # what the block settled by itself passes through, by a task number below zero
                names, blobs = [-1 - number % tasks], [_pairs(*_runs(gone))]
                task = (entries["key"] % np.uint64(tasks)).astype(np.int64)
                for t, part in _by(task):
                    e = entries[part]
                    bodies = b"".join(block.raw[s : s + n + LENGTH - 1] for s, n in zip(e["lo"].tolist(), e["windows"].tolist(), strict=True))
                    names.append(t)
                    blobs.append(squeeze.compress(len(e).to_bytes(8, "little") + e.tobytes() + bodies))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["block", "task", "items"])
        block = body = told = entries = gone = bodies = blobs = b = None
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        if table.column("task")[0].as_py() < 0:
            return pa.table({"block": table.column("block"), "gone": table.column("items")})
        unpack = zstandard.ZstdDecompressor()
        entries, bodies = [], []
        for blob in table.column("items").to_pylist():
            blob = unpack.decompress(blob)
            n = int.from_bytes(blob[:8], "little")
            entries.append(np.frombuffer(blob, _ENTRY, n, 8))
            bodies.append(blob[8 + n * _ENTRY.itemsize :])
        every = np.concatenate(entries)
        block = np.repeat(np.array(table.column("block").to_pylist(), np.int64), [len(e) for e in entries])
        entry, at, width = judge(every, b"".join(bodies), block)
        found = [(number, _pairs(every["lo"][entry[k]] + at[k], width[k])) for number, k in _by(block[entry])]
        return pa.table({"block": pa.array([f[0] for f in found], pa.int64()), "gone": pa.array([f[1] for f in found], pa.binary())})

    return joined.mapInArrow(send, "block bigint, task bigint, items binary").groupBy("task").applyInArrow(meet, "block bigint, gone binary").filter("length(gone) > 0")


def _removed(body: bytes, gone: list[bytes]) -> tuple[Block, np.ndarray]:
    """A block and, by byte, whether it goes."""
    block = Block(body)
    runs = np.frombuffer(b"".join(gone), "<i8").reshape(-1, 2)
    return block, _marked(len(block.text), runs[:, 0], runs[:, 1] + LENGTH - 1)


def _cut(docs: DataFrame, emit: Callable[[Block, np.ndarray], pa.RecordBatch], schema: object) -> DataFrame:
    """``docs`` (key, text and more) through all rounds; ``emit`` makes a block's result."""
    spark = docs.sparkSession
    give_room(spark)
    blocks = stash(pack_blocks(docs), "suffix-blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    give_room(spark)
    marks = stash(_contested(blocks, tasks), "suffix-marks")
    give_room(spark)
    judged = stash(_judged(blocks, marks, tasks), "suffix-judged")
    said = judged.groupBy("block").agg(F.collect_list("gone").alias("gone"))

    def run(batches):
        for b in batches:
            for body, gone in zip(*(b.column(c).to_pylist() for c in ("body", "gone")), strict=True):
                yield emit(*_removed(body, gone or []))

    return blocks.select("block", "body").join(said, "block", "left").mapInArrow(run, schema)


def _whole_ids(docs: DataFrame, key: str) -> None:
    if not isinstance(docs.select(F.col(f"`{key}`")).schema[0].dataType, T.IntegralType):
        raise TypeError(f"{key}: ids that order documents must be whole numbers")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256."""

    def emit(block: Block, away: np.ndarray) -> pa.RecordBatch:
        out = []
        for s, n in zip(block.starts.tolist(), block.sizes.tolist(), strict=True):
            own = away[s : s + n]
            removed = int(own.sum())
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
            kept = block.text[s : s + n][~own].tobytes() if removed else block.raw[s : s + n]
            out.append((n, removed, spans, hashlib.sha256(kept).hexdigest()))
        cols = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])]
        return pa.RecordBatch.from_arrays([block.rows.column("key").combine_chunks(), *cols], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    _whole_ids(docs, key)
    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    return _cut(slim, emit, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``.

    A character of several bytes goes only if all of them do. Rows stay, with an
    empty text if nothing is left; a null text stays null.
    """
    names = docs.columns

    def emit(block: Block, away: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero((block.text & 0xC0) != 0x80)
        if len(heads):
            away = np.repeat(np.logical_and.reduceat(away, heads), np.diff(np.r_[heads, len(away)]))
        old = block.rows.column("text").to_pylist()
        new = [None if o is None else block.text[s : s + n][~away[s : s + n]].tobytes().decode() for o, s, n in zip(old, block.starts.tolist(), block.sizes.tolist(), strict=True)]
        cols = [pa.array(new, block.rows.column(f"c{k}").type) if c == text else block.rows.column(f"c{k}").combine_chunks() for k, c in enumerate(names)]
        return pa.RecordBatch.from_arrays(cols, names)

    _whole_ids(docs, key)
    wide = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"), *[(F.lit(None).cast("string") if c == text else F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(names)])
    return _cut(wide, emit, docs.schema)
