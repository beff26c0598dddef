"""Best-fit packing of documents into training sequences, with swap-based local search.

Documents become token ids and an end id; one longer than a sequence is cut into
whole sequences, its first piece taking what is left over. Only lengths, checksums
and places travel: (id, piece, start, length, checksum). How many sequences are
needed, and which lengths share one, depends on nothing but how many pieces have each
length, so one table of at most ``capacity`` rows goes to the driver and all pieces
are packed together, however many they are:

1. Best fit, all pieces of a length at a time. Bins of equal contents are one class
   with a count. The two starts differ in the order of the lengths (falling, dealt).
2. Local search over the classes of underfull bins: a move, one for one, two for one
   or one for two, each raising the sum of squared fills, as many bins at once as both
   classes have, until no exchange is left. The start that ends with fewer bins stays.
3. The plan says which ranks within a length fill which sequences. A piece's rank is
   its place within its task plus a prefix sum over (task, length), so repeated rows,
   one id or one length with any share of the rows are never one task.

What is broadcast: the plan, whose rows grow with the number of lengths, not of pieces
(each length splits at most two classes); beyond ``PLAN_ROWS`` rows it is joined by
length without a broadcast.

Ids are those of the tokenizer file with its defaults: a special token that stands in a
text becomes its own id.

Defined results: a null or empty text is the end id alone; repeated rows are
packed as often as they occur; an empty table gives an empty result; columns other
than id and text are ignored.
"""

from __future__ import annotations

import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axismap.llm.tables import kept_for, slices, stash

CAPACITY = 1024
END_ID = 2
SEED = 7
BASE = 32
PLAN_ROWS = 1 << 18
TEXTS_AT_ONCE = 200
TOKENIZER = "byte_bpe_50k.json"
#: Characters that every version of Unicode puts into the same class (letter, number, space, other).
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")
_LONG_SPACE = re.compile(r"\s{256}")


class Ids:
    """Token ids (little-endian, four bytes each) of texts, as the file's tokenizer gives them.

    A text of plain characters goes through a second implementation of byte-pair merging
    that is made of the same file's vocabulary and takes half the time. Any other text (other
    characters, special tokens, long white space), and all texts if the file is not plain
    byte-level merging in the order of its ids, go through the tokenizer itself.
    """

    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.fast = _merger(path)

    def _is_plain(self, text: str) -> bool:
        return self.fast is not None and _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.special) and _LONG_SPACE.search(text) is None

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        texts = [t or "" for t in texts]
        for k in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[k : k + TEXTS_AT_ONCE]
            plain = [self._is_plain(t) for t in part]
            rest = iter(self.tokenizer.encode_batch([t for t, p in zip(part, plain, strict=True) if not p], add_special_tokens=False))
            for t, p in zip(part, plain, strict=True):
                yield (self.fast.encode_to_numpy(t, disallowed_special=()) if p else np.array(next(rest).ids)).astype("<u4").tobytes()


def _merger(path: str):
    """Byte-pair merging by the vocabulary of a tokenizer file; None if the file is of another kind."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told["pre_tokenizer"] or {}
    kind = (model.get("type", "BPE"), split.get("type"), split.get("use_regex", True), split.get("add_prefix_space"), told["normalizer"])
    if kind != ("BPE", "ByteLevel", True, False, None) or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in told["added_tokens"]}
    letters = {c: k for k, c in _byte_letters().items()}
    if made != sorted(made) or set(letters) != set(ByteLevel.alphabet()):
        return None
    ranks = {bytes(letters[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def ids_of(path: str | None) -> Ids:
    """One of a worker process."""
    kept = kept_for("packing")
    if path not in kept:
        kept[path] = Ids(path)
    return kept[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: the odd one first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and task and nth (its place among the task's pieces of that length). No shuffle."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        ids = ids_of(tokenizer)
        end, task = struct.pack("<I", END_ID), TaskContext.get().partitionId()
        met: Counter[int] = Counter()
        for b in slices(batches):
            at, out = [], []
            for k, raw in enumerate(ids(b.column(1).to_pylist())):
                raw += end
                for i, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                    at.append(k)
                    out.append((i, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), task, met[n]))
                    met[n] += 1
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], ["key", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")


Contents = tuple[int, ...]


def best_fit(counts: dict[int, int], order: list[int], capacity: int = CAPACITY) -> Counter[Contents]:
    """How many bins have which contents: each piece, in ``order`` of lengths, goes where it leaves the least room."""
    by_room: dict[int, list[tuple[Contents, int]]] = defaultdict(list)
    rooms = 0  # bit r is set if a bin has room r

    def put(contents: Contents, room: int, n: int) -> None:
        nonlocal rooms
        if n:
            by_room[room].append((contents, n))
            rooms |= 1 << room

    for size in order:
        left = counts[size]
        while left:
            if fits := rooms >> size:
                room = size + (fits & -fits).bit_length() - 1
                contents, n = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, contents, n = capacity, (), left
            each = min(left, room // size)
            now = min(n, left // each)
            if contents:
                put(contents, room, n - now)
            put(_held((*contents, *[size] * each)), room - each * size, now)
            left -= each * now
    out: Counter[Contents] = Counter()
    for classes in by_room.values():
        for contents, n in classes:
            out[contents] += n
    return out


def _held(sizes: Iterable[int]) -> Contents:
    return tuple(sorted(sizes, reverse=True))


def _pairs(contents: Contents) -> Iterator[tuple[int, int]]:
    """Each two of the lengths that can be taken out together."""
    have = Counter(contents)
    sizes = sorted(have)
    for k, a in enumerate(sizes):
        if have[a] > 1:
            yield a, a
        for b in sizes[k + 1 :]:
            yield a, b


class _Classes:
    """Classes of underfull bins by the room that they have, and as bit sets what each room's bins can give.

    Bit m of ``gives[room][0]`` is set if some bin of that room holds an item of length m
    (bit 0: nothing need be taken back), of ``[1]`` if two of its items add up to m.
    """

    def __init__(self, bins: Counter[Contents], capacity: int) -> None:
        self.capacity = capacity
        self.full: Counter[Contents] = Counter()
        self.count: Counter[Contents] = Counter()
        self.by_room: dict[int, set[Contents]] = defaultdict(set)
        self.gives: dict[int, tuple[int, int]] = {}
        for contents, n in bins.items():
            self.add(contents, n)

    def add(self, contents: Contents, n: int) -> None:
        room = self.capacity - sum(contents)
        if not contents or not n:
            return
        if not room:
            self.full[contents] += n
            return
        if contents not in self.by_room[room]:
            self.by_room[room].add(contents)
            self.gives.pop(room, None)
        self.count[contents] += n

    def drop(self, contents: Contents, n: int) -> None:
        self.count[contents] -= n
        if not self.count[contents]:
            del self.count[contents]
            room = self.capacity - sum(contents)
            self.by_room[room].discard(contents)
            self.gives.pop(room, None)
            if not self.by_room[room]:
                del self.by_room[room]

    def masks(self, room: int) -> tuple[int, int]:
        if room not in self.gives:
            one, two = 1, 0
            for contents in self.by_room[room]:
                for m in contents:
                    one |= 1 << m
                for a, b in _pairs(contents):
                    two |= 1 << (a + b)
            self.gives[room] = one, two
        return self.gives[room]

    def exchange(self, poor: Contents) -> Contents | None:
        """Make the exchange of ``poor`` with another bin that raises the squared fill most; what poor bins then hold."""
        n_poor = self.count[poor]
        self.drop(poor, 1)  # a bin is no partner of itself
        fill, give = sum(poor), {a: (a,) for a in poor}
        for a, b in _pairs(poor):
            give.setdefault(a + b, (a, b))
        best: tuple[int, int, int, Contents] | None = None
        for room in self.by_room:
            one, two = self.masks(room)
            for size, out in give.items():
                back = one | two if len(out) == 1 else one
                low = max(0, size - room)
                if not (open_ := (back >> low) & ((1 << (size - low)) - 1)):
                    continue
                gain = size - low - (open_ & -open_).bit_length() + 1  # least taken back, most gained
                rise = gain * (self.capacity - room - fill + gain)
                if rise > 0 and (best is None or rise > best[0]):
                    best = rise, room, size - gain, out
        partner = None if best is None else self._holder(best[1], best[2], len(best[3]) == 1)
        self.add(poor, 1)
        if partner is None:
            return None
        other, back = partner
        out = best[3]
        n = n_poor // 2 if other == poor else min(n_poor, self.count[other])
        self.drop(poor, n)
        self.drop(other, n)
        left = _held((Counter(poor) - Counter(out) + Counter(back)).elements())
        self.add(left, n)
        self.add(_held((Counter(other) - Counter(back) + Counter(out)).elements()), n)
        return left

    def _holder(self, room: int, size: int, two: bool) -> tuple[Contents, Contents] | None:
        """A bin with ``room`` that can give back ``size`` in one item or, if ``two``, in two."""
        for contents in sorted(self.by_room[room]):
            if size == 0 or size in contents:
                return contents, (size,) if size else ()
            if two and (pair := next((p for p in _pairs(contents) if sum(p) == size), None)):
                return contents, pair
        return None


def _searched(bins: Counter[Contents], capacity: int) -> Counter[Contents]:
    state, moved = _Classes(bins, capacity), True
    while moved:
        moved = False
        for room in sorted(state.by_room, reverse=True):
            for poor in sorted(state.by_room.get(room, ())):
                while state.count.get(poor) and (left := state.exchange(poor)) is not None:
                    poor, moved = left, True
    return state.full + state.count


def local_search(bins: Counter[Contents], capacity: int = CAPACITY) -> Counter[Contents]:
    """Empty underfull bins by exchanges, the least filled first, until no bin has one left; keeps every item.

    Counts are taken digit by digit (base ``BASE``): what holds for so many bins of each
    class holds for any multiple, so the work grows with the classes and the digits.
    """
    out: Counter[Contents] = Counter()
    times = 1
    while left := {c: n for c, n in bins.items() if n // times}:
        digit = Counter({c: n // times % BASE for c, n in left.items() if n // times % BASE})
        for contents, n in _searched(digit, capacity).items():
            out[contents] += n * times
        times *= BASE
    return out


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Contents]:
    """Bins by contents for so many pieces of each length: of two starts the one that ends with fewer."""
    falling = sorted(counts, reverse=True)
    dealt = random.Random(SEED).sample(falling, len(falling))
    return min((local_search(best_fit(counts, order, capacity), capacity) for order in (falling, dealt)), key=Counter.total)


def plan_rows(bins: Counter[Contents]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, upto, each, base, at): ranks from..upto of a length go ``each`` to a sequence, from ``base`` on, at offset ``at``."""
    used: Counter[int] = Counter()
    rows, base = [], 0
    for contents, n in sorted(bins.items()):
        at = 0
        for size, each in sorted(Counter(contents).items(), reverse=True):
            rows.append((size, used[size], used[size] + n * each, each, base, at))
            used[size] += n * each
            at += size * each
        base += n
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table) with sequence_id and offset (their place there, without gaps)."""
    spark = found.sparkSession
    by_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_rows(pack_counts(counts, capacity))
    plan = spark.createDataFrame(rows, "p_length bigint, from bigint, upto bigint, each bigint, base bigint, at bigint")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = found.join(firsts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    mine = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto"))
    into = F.col("rank") - F.col("from")
    placed = ranked.join(F.broadcast(plan) if len(rows) <= PLAN_ROWS else plan, mine)
    sequence, offset = F.col("base") + F.floor(into / F.col("each")), F.col("at") + F.col("length") * (into % F.col("each"))
    return placed.select("key", "piece", "start", "length", "ids_crc32", sequence.cast("bigint").alias("sequence_id"), offset.cast("bigint").alias("offset"))


def best_fit_packing(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(stash(pieces(docs, key, text, capacity, tokenizer), "pieces"), capacity).withColumnRenamed("key", key)
