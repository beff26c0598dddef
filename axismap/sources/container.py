"""The binary container of a map: one file of chunked runs, with directories for both axes.

Reading starts with the trailer, the section table, members, groups, metadata and page
checksums; the chunk directories are dealt over tasks by pages of ``PAGE`` entries. A task
checks its pages, leaves out chunks that cannot meet the window, and reads and decodes the
others by position. Every page, chunk and section is held against its checksum when it is
read, and every run against its chunk's extents.

Writing deals runs by (member, bin), cuts and encodes chunks in tasks, and lays them end to
end in one file from the driver, which holds a directory entry (72 bytes) per chunk.

Files are opened by position through pyarrow's file systems (local, HDFS, S3, GCS), as tasks
and driver both must reach them.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axismap.schema import GROUPS, MEMBERS, META, RUN_COLUMNS, SECTIONS, MapError, as_runs

# Fixed values of the format.
MAGIC = b"LMAP\x1a\r\n\x00"
MAJOR = 3
ORDER_B, A_OVERLAP = 1, 2
PAGE = 4096
NO_GROUP = 0xFFFFFFFF
HEADER = struct.Struct("<8sIIQ32sQ")
TRAILER = struct.Struct("<QQII8s")
SECTION = struct.Struct("<QQQBBI")
DIRECTORY = np.dtype([("a_member", "<u4"), ("b_member", "<u4"), ("a_min", "<u8"), ("a_span", "<u4"), ("b_span", "<u4"), ("b_min", "<u8"), ("base", "<u8"), ("off", "<u8"),
                      ("clen", "<u4"), ("rawlen", "<u4"), ("n_runs", "<u4"), ("codec", "<u4"), ("crc32", "<u4"), ("reserved", "<u4")])
BY_B = np.dtype([("chunk", "<u4"), ("reach", "<u8")])
MEMBER = np.dtype([("name_off", "<u4"), ("name_len", "<u4"), ("length", "<u8"), ("axis_min", "<u8"), ("axis_max", "<u8"), ("first_chunk", "<u4"), ("n_chunks", "<u4")])
CHUNK_RUNS, CHUNK_SPAN = 8192, 1_000_000
BIN = 1 << 24
READ_AT_ONCE = 8 << 20
RUNS_DDL = "a_member bigint, a bigint, b_member bigint, b bigint, len bigint, strand int"


# --- streams of numbers -----------------------------------------------------------


def put_varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the high bit is set on all bytes of a number but its last."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << 7 * k)
    end = np.cumsum(n)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[(end - n)[has] + k] = (v[has] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | np.where(n[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes()


def get_varints(raw: bytes, count: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    end = np.flatnonzero(data < 0x80)
    if len(end) != count or (count and end[-1] != len(data) - 1) or (not count and len(data)):
        raise MapError("CORRUPT: a number stream of another length")
    start = np.r_[0, end[:-1] + 1] if count else end
    size = end - start + 1
    if size.max(initial=0) > 10:
        raise MapError("CORRUPT: a number of more than ten bytes")
    out = np.zeros(count, np.uint64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (data[start[has] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out


def fold_sign(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unfold_sign(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def _ways(b: np.ndarray, n: np.ndarray, strand: np.ndarray, by_b: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a run is entered and left on axis b: along its strand, or in order b from start to end."""
    back = (strand == 1) & (not by_b)
    return np.where(back, b + n, b), np.where(back, b, b + n)


def encode(a: np.ndarray, b: np.ndarray, n: np.ndarray, strand: np.ndarray, by_b: bool, squeeze: bool = True) -> tuple[bytes, int]:
    """(blob of a chunk, bytes of its streams with their lengths)."""
    step_a = a - np.r_[a[0], (a + n)[:-1]]
    enter, leave = _ways(b, n, strand, by_b)
    step_b = enter - np.r_[enter[0], leave[:-1]]
    raw = [put_varints(fold_sign(step_a) if by_b else step_a), put_varints(fold_sign(step_b)), put_varints(n - 1), np.packbits(strand.astype(np.uint8), bitorder="little").tobytes()]
    kept = []
    for x in raw:
        deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
        small = deflate.compress(x) + deflate.flush() if squeeze else x
        kept.append(small if len(small) < len(x) else x)
    return struct.pack("<8I", *map(len, raw), *map(len, kept)) + b"".join(kept), 16 + sum(map(len, raw))


def decode(blob: bytes, entry: np.void, by_b: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, len, strand) of a chunk, held against its directory entry."""
    if zlib.crc32(blob) != entry["crc32"]:
        raise MapError("CORRUPT: a chunk's checksum")
    count, sizes = int(entry["n_runs"]), struct.unpack_from("<8I", blob)
    streams, at = [], 32
    for raw_len, kept in zip(sizes[:4], sizes[4:], strict=True):
        x = blob[at : at + kept]
        at += kept
        if kept < raw_len:
            inflate = zlib.decompressobj(-15)
            x = inflate.decompress(x, raw_len + 1)
            if not inflate.eof or inflate.unused_data:
                raise MapError("CORRUPT: a stream that does not inflate")
        if len(x) != raw_len:
            raise MapError("CORRUPT: a stream of another length")
        streams.append(x)
    if at != len(blob) or 16 + sum(sizes[:4]) != entry["rawlen"] or len(streams[3]) != -(-count // 8):
        raise MapError("CORRUPT: a chunk of another length")
    n = get_varints(streams[2], count).view(np.int64) + 1
    strand = np.unpackbits(np.frombuffer(streams[3], np.uint8), count=count, bitorder="little").astype(np.int32)
    step_a, step_b = get_varints(streams[0], count), unfold_sign(get_varints(streams[1], count))
    step_a = unfold_sign(step_a) if by_b else step_a.view(np.int64)
    base_a, base_b = (entry["base"], entry["b_min"]) if by_b else (entry["a_min"], entry["base"])
    a = int(base_a) + np.cumsum(step_a) + np.r_[0, np.cumsum(n)[:-1]]
    way = np.where((strand == 1) & (not by_b), -n, n)  # from entering to leaving
    enter = int(base_b) + np.cumsum(step_b) + np.r_[0, np.cumsum(way)[:-1]]
    b = np.where((strand == 1) & (not by_b), enter - n, enter)
    for start, low, span in ((a, entry["a_min"], entry["a_span"]), (b, entry["b_min"], entry["b_span"])):
        if start.min() != int(low) or (start + n).max() != int(low) + int(span):
            raise MapError("CORRUPT: runs outside their chunk's extents")
    return a, b, n, strand


# --- reading -----------------------------------------------------------------------


@dataclass
class Container:
    """An open file: its header, section table and small sections."""

    path: str
    profile: str = ""
    flags: int = 0
    sections: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    page_crcs: dict[str, np.ndarray] = field(default_factory=dict)
    n_chunks: int = 0
    total_runs: int = 0
    payload_bytes: int = 0

    def __post_init__(self) -> None:
        self._open()
        size = self._file.size()
        if size < HEADER.size + TRAILER.size:
            raise MapError(f"not a container: {self.path}")
        head, tail = self.at(0, HEADER.size), self.at(size - TRAILER.size, TRAILER.size)
        magic, major, _, self.flags, profile, _ = HEADER.unpack(head)
        off, n, footer_crc, head_crc, magic_again = TRAILER.unpack(tail)
        if magic != MAGIC or magic_again != MAGIC or major != MAJOR:
            raise MapError(f"not a container of version {MAJOR}: {self.path}")
        if zlib.crc32(head) != head_crc:
            raise MapError("CORRUPT: the header's checksum")
        if self.flags & ~(ORDER_B | A_OVERLAP) or self.flags == A_OVERLAP:
            raise MapError(f"features {self.flags:#x} that this reader does not know")
        self.profile = profile.rstrip(b"\0").decode()
        footer = self.at(off, n)
        if zlib.crc32(footer) != footer_crc:
            raise MapError("CORRUPT: the section table's checksum")
        at = 4
        for _ in range(struct.unpack_from("<I", footer)[0]):
            end = at + 1 + footer[at]
            name = footer[at + 1 : end].decode()
            place, length, _, _, _, crc = SECTION.unpack_from(footer, end)
            if name in self.sections or place + length > size:
                raise MapError(f"CORRUPT: section {name!r}")
            self.sections[name], at = (place, length, crc), end + SECTION.size
        crcs = self.section("dir.crc")
        entries, _, self.n_chunks, self.total_runs, self.payload_bytes = struct.unpack_from("<IIQQQ", crcs)
        pages = -(-self.n_chunks // PAGE)
        if entries != PAGE or len(crcs) != 32 + 12 * pages or self.sections["dir.a"][1] != DIRECTORY.itemsize * self.n_chunks:
            raise MapError("CORRUPT: the page checksums")
        self.page_crcs = dict(zip(("dir.a", "dir.a.max", "dir.b"), np.frombuffer(crcs, "<u4", offset=32).reshape(3, pages), strict=True))

    def _open(self) -> None:
        fs, path = located(self.path)
        self._file = fs.open_input_file(path)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_file"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    @property
    def by_b(self) -> bool:
        return bool(self.flags & ORDER_B)

    def at(self, off: int, n: int) -> bytes:
        raw = self._file.read_at(n, off)
        if len(raw) != n:
            raise MapError("CORRUPT: the file is cut off")
        return raw

    def section(self, name: str) -> bytes:
        """A whole section, checked."""
        if name not in self.sections:
            raise MapError(f"no section {name!r}")
        off, n, crc = self.sections[name]
        raw = self.at(off, n)
        if zlib.crc32(raw) != crc:
            raise MapError(f"CORRUPT: the checksum of section {name!r}")
        return raw

    def page(self, name: str, k: int, kind: np.dtype) -> np.ndarray:
        """A page of a chunk directory, checked."""
        first = k * PAGE * kind.itemsize
        raw = self.at(self.sections[name][0] + first, min(PAGE * kind.itemsize, self.sections[name][1] - first))
        if zlib.crc32(raw) != self.page_crcs[name][k]:
            raise MapError(f"CORRUPT: a page of {name}")
        return np.frombuffer(raw, kind)

    def entries(self, k: int) -> np.ndarray:
        """A page of the directory by axis a, each entry within the format's limits."""
        e = self.page("dir.a", k, DIRECTORY)
        n, clen, raw = (e[c].astype(np.int64) for c in ("n_runs", "clen", "rawlen"))
        fits = np.where(e["codec"] == 0, clen == raw + 16, (clen <= raw + 16) & (raw <= 1032 * clen + 64))
        fine = (n >= 1) & (n <= 1 << 24) & (raw <= 1 << 30) & (raw >= 16 + 3 * n + -(-n // 8)) & (clen >= 32) & fits & (e["codec"] <= 1) & (e["off"].astype(np.int64) + clen <= self.sections["runs"][1])
        if not fine.all():
            raise MapError("CORRUPT: a chunk directory entry")
        return e

    def chunks(self, entries: np.ndarray) -> Iterator[tuple[np.void, bytes]]:
        """Entries with their blobs; neighbours in the file are read together."""
        entries = entries[np.argsort(entries["off"], kind="stable")]
        start, i = self.sections["runs"][0], 0
        while i < len(entries):
            j, first = i + 1, int(entries["off"][i])
            upto = first + int(entries["clen"][i])
            while j < len(entries) and entries["off"][j] == upto and upto - first < READ_AT_ONCE:
                upto += int(entries["clen"][j])
                j += 1
            raw = self.at(start + first, upto - first)
            for e in entries[i:j]:
                at = int(e["off"]) - first
                yield e, raw[at : at + int(e["clen"])]
            i = j

    def members(self, axis: str) -> tuple[np.ndarray, list[str]]:
        raw = self.section(f"mem.{axis}")
        n = struct.unpack_from("<I", raw)[0]
        rows = np.frombuffer(raw, MEMBER, n, 4)
        blob = 4 + n * MEMBER.itemsize
        names = [raw[blob + int(r["name_off"]) : blob + int(r["name_off"]) + int(r["name_len"])] for r in rows]
        by_name = np.frombuffer(raw, "<u4", n, len(raw) - 4 * n).tolist()
        ordered = [names[k] for k in by_name if k < n]
        if sorted(by_name) != list(range(n)) or any(x >= y for x, y in zip(ordered, ordered[1:], strict=False)):
            raise MapError(f"CORRUPT: names of axis {axis}")
        if n and (np.cumsum(rows["n_chunks"].astype(np.int64))[-1] != self.n_chunks or not _tiles(rows)):
            raise MapError(f"CORRUPT: chunk ranges of axis {axis}")
        return rows, [x.decode() for x in names]

    def groups(self, axis: str, n_members: int) -> tuple[list[str], list[int | None]]:
        if f"grp.{axis}" not in self.sections:
            return [], [None] * n_members
        raw = self.section(f"grp.{axis}")
        n = struct.unpack_from("<I", raw)[0]
        at = np.frombuffer(raw, "<u4", n + 1, 4).tolist()
        blob = 4 + 4 * (n + 1)
        names = [raw[blob + i : blob + j].decode() for i, j in zip(at, at[1:], strict=False)]
        of = np.frombuffer(raw, "<u4", n_members, len(raw) - 4 * n_members).tolist()
        if len(set(names)) != n or any(g >= n and g != NO_GROUP for g in of):
            raise MapError(f"CORRUPT: groups of axis {axis}")
        return names, [None if g == NO_GROUP else g for g in of]

    def meta(self) -> dict[str, str]:
        raw, at, out = self.section("meta"), 4, []
        for _ in range(2 * struct.unpack_from("<I", raw)[0]):
            n = struct.unpack_from("<I", raw, at)[0]
            out.append(raw[at + 4 : at + 4 + n].decode())
            at += 4 + n
        return dict(zip(out[::2], out[1::2], strict=True))


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it; ``file:/x`` is as good as ``file:///x``."""
    return pa.fs.FileSystem.from_uri(re.sub("^file:(?=/[^/])", "file://", path))


def _tiles(rows: np.ndarray) -> bool:
    used = rows[rows["n_chunks"] > 0]
    used = used[np.argsort(used["first_chunk"], kind="stable")]
    ends = np.cumsum(used["n_chunks"].astype(np.int64))
    return bool((used["first_chunk"] == ends - used["n_chunks"]).all())


def _batch(c: Container, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    for e, blob in c.chunks(entries):
        a, b, n, strand = decode(blob, e, c.by_b)
        am, bm = (np.full(len(a), int(e[x]), np.int64) for x in ("a_member", "b_member"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (am, a, bm, b, n, strand)], RUN_COLUMNS)


def runs(spark: SparkSession, path: str, axis: str | None = None, member: int | None = None, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Runs of a container; with ``axis`` and ``member`` those that overlap [lo, hi), reading no other chunk."""
    c = Container(path)
    if axis is None:
        first, n = 0, c.n_chunks
    else:
        rows, _ = c.members(axis)
        if member is None or not 0 <= member < len(rows):
            raise MapError(f"no member {member} on axis {axis}")
        first, n = int(rows[member]["first_chunk"]), int(rows[member]["n_chunks"])
        hi = int(rows[member]["length"]) if hi is None else hi
    pages = range(first // PAGE, -(-(first + n) // PAGE)) if n else range(0)
    shared = spark.sparkContext.broadcast(c)  # header, section table and page checksums

    def run(batches):
        c = shared.value
        for page in (k for batch in batches for k in batch.column(0).to_pylist()):
            inside = slice(max(0, first - page * PAGE), first + n - page * PAGE)
            if axis == "b":
                ids = c.page("dir.b", page, BY_B)[inside]["chunk"]
                e = np.concatenate([c.entries(int(k))[ids[ids // PAGE == k] % PAGE] for k in np.unique(ids // PAGE)]) if len(ids) else np.zeros(0, DIRECTORY)
            else:
                e = c.entries(page)[inside]
            if axis is not None:
                if (e[f"{axis}_member"] != member).any():
                    raise MapError("CORRUPT: a chunk in another member's range")
                start = e[f"{axis}_min"].astype(np.int64)
                e = e[(start < hi) & (start + e[f"{axis}_span"] > lo) & (lo < hi)]
            yield from _batch(c, e)

    found = spark.range(pages.start, pages.stop, 1, max(1, len(pages))).mapInArrow(run, RUNS_DDL)
    if axis is not None:
        found = found.filter((F.col(f"{axis}_member") == member) & (F.col(axis) < hi) & (F.col(axis) + F.col("len") > lo))
    return found


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, members, groups, meta, sections) of a container; application sections are read as a whole."""
    c = Container(path)
    members, groups = [], []
    for axis in ("a", "b"):
        rows, names = c.members(axis)
        group_names, of = c.groups(axis, len(names))
        members += [(axis, k, name, int(r["length"]), g) for k, (name, r, g) in enumerate(zip(names, rows, of, strict=True))]
        groups += [(axis, k, name) for k, name in enumerate(group_names)]
    told = c.meta() | {"profile": c.profile, "order": "b" if c.by_b else "a", "axis_a_overlaps": "yes" if c.flags & A_OVERLAP else "no"}
    kept = [(k, bytearray(c.section(k))) for k in sorted(c.sections) if k.startswith("x.")]
    return runs(spark, path), spark.createDataFrame(members, MEMBERS), spark.createDataFrame(groups, GROUPS), spark.createDataFrame(sorted(told.items()), META), spark.createDataFrame(kept, SECTIONS)


def verify(spark: SparkSession, path: str) -> str:
    """"OK", or raises: all section checksums, what spans directory entries, and every chunk."""
    c = Container(path)
    for name, (off, n, crc) in c.sections.items():
        have = 0
        for at in range(0, n, READ_AT_ONCE):
            have = zlib.crc32(c.at(off + at, min(READ_AT_ONCE, n - at)), have)
        if have != crc:
            raise MapError(f"CORRUPT: the checksum of section {name!r}")
    pages = range(-(-c.n_chunks // PAGE))
    e = np.concatenate([np.zeros(0, DIRECTORY), *(c.entries(k) for k in pages)])
    reach = np.concatenate([np.zeros(0, "<u8"), *(c.page("dir.a.max", k, np.dtype("<u8")) for k in pages)])
    by_b = np.concatenate([np.zeros(0, BY_B), *(c.page("dir.b", k, BY_B) for k in pages)])
    if sorted(by_b["chunk"].tolist()) != list(range(c.n_chunks)):
        raise MapError("CORRUPT: the directory by axis b names a chunk twice")
    for axis, own, told in (("a", e, reach), ("b", e[by_b["chunk"]], by_b["reach"])):
        rows, _ = c.members(axis)
        ranges = np.repeat(np.arange(len(rows)), rows["n_chunks"].astype(np.int64))[np.argsort(np.concatenate([np.arange(f, f + n) for f, n in zip(rows["first_chunk"].tolist(), rows["n_chunks"].tolist(), strict=True)] or [np.zeros(0, int)]), kind="stable")]
        if (own[f"{axis}_member"] != ranges).any() or (told != _reach(own, axis)).any() or (np.lexsort((own[f"{axis}_min"], own[f"{axis}_member"])) != np.arange(len(own))).any():
            raise MapError(f"CORRUPT: the directory by axis {axis}")
    if not c.by_b and len(e) > 1 and ((e["a_member"][1:] == e["a_member"][:-1]) & (e["a_min"][1:] < e["a_min"][:-1] + e["a_span"][:-1])).any():
        raise MapError("CORRUPT: chunks that overlap on axis a")
    lengths = {x: [int(r["length"]) for r in c.members(x)[0]] for x in ("a", "b")}
    for axis in ("a", "b"):
        if any(int(m) + int(s) > lengths[axis][int(k)] for k, m, s in zip(e[f"{axis}_member"], e[f"{axis}_min"], e[f"{axis}_span"], strict=True)):
            raise MapError(f"CORRUPT: runs beyond a member of axis {axis}")
    if runs(spark, path).count() != c.total_runs or int(e["clen"].astype(np.int64).sum()) != c.payload_bytes:
        raise MapError("CORRUPT: the sums of the directory")
    return "OK"


def _reach(own: np.ndarray, axis: str) -> np.ndarray:
    """The largest end so far within each member."""
    ends = own[f"{axis}_min"] + own[f"{axis}_span"]
    out = np.zeros(len(own), np.uint64)
    for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own[f"{axis}_member"].astype(np.int64))) + 1):
        out[part] = np.maximum.accumulate(ends[part])
    return out


# --- writing -----------------------------------------------------------------------


def cuts(b: np.ndarray, n: np.ndarray, count: int, span: int) -> list[int]:
    """Where chunks start among runs of one pair of members: by number of runs and by their extent on axis b."""
    starts, low, high = [0], int(b[0]), int(b[0] + n[0])
    for i, (x, size) in enumerate(zip(b.tolist(), n.tolist(), strict=True)):
        now_low, now_high = min(low, x), max(high, x + size)
        if i > starts[-1] and (i - starts[-1] >= count or now_high - now_low > span):
            starts.append(i)
            low, high = x, x + size
        else:
            low, high = now_low, now_high
    return starts


def encoded(runs_: DataFrame, by_b: bool, count: int = CHUNK_RUNS, span: int = CHUNK_SPAN, squeeze: bool = True) -> DataFrame:
    """(a_member, a_min, b_member, b_min, entry, blob): chunks of canonical runs; ``entry`` has no place in the file yet.

    Chunks also end with each bin of ``BIN`` positions on the ordering axis, so that no member is one task.
    """
    r = as_runs(runs_)
    axis, keys = ("b", ["a_member", "b_member"]) if by_b else ("a", ["a_member"])
    order = ["a_member", "b_member", "b", "a", "len"] if by_b else ["a_member", "a", "b_member", "b"]
    dealt = r.withColumn("bin", F.floor(F.col(axis) / BIN)).repartition(*keys, "bin").sortWithinPartitions(*order)

    def chunk(t: list[np.ndarray]) -> pa.RecordBatch:
        am, a, bm, b, n, strand, _ = t
        blob, raw = encode(a, b, n, strand, by_b, squeeze)
        e = np.zeros(1, DIRECTORY)
        e["a_member"], e["b_member"], e["a_min"], e["b_min"] = am[0], bm[0], a.min(), b.min()
        spans = int((a + n).max() - a.min()), int((b + n).max() - b.min())
        if max(spans) >= 1 << 32:
            raise MapError("a chunk's extent takes more than 32 bits")
        e["a_span"], e["b_span"] = spans
        e["base"] = a[0] if by_b else _ways(b[:1], n[:1], strand[:1], False)[0][0]
        e["clen"], e["rawlen"], e["n_runs"], e["codec"], e["crc32"] = len(blob), raw, len(a), int(squeeze), zlib.crc32(blob)
        cells = [int(am[0]), int(a.min()), int(bm[0]), int(b.min())]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in cells), pa.array([e.tobytes()], pa.binary()), pa.array([blob], pa.binary())], ["a_member", "a_min", "b_member", "b_min", "entry", "blob"])

    def run(batches):
        held: list[np.ndarray] | None = None  # runs of the last pair of members and bin met
        for batch in batches:
            if not batch.num_rows:
                continue
            t = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if held is not None:
                t = [np.concatenate(x) for x in zip(held, t, strict=True)]
            change = np.zeros(len(t[0]), bool)
            for k in (0, 2, 6):
                change[1:] |= t[k][1:] != t[k][:-1]
            parts = [[x[i:j] for x in t] for i, j in zip([0, *np.flatnonzero(change).tolist()], [*np.flatnonzero(change).tolist(), len(change)], strict=True)]
            for part in parts[:-1]:
                yield from cut(part, True)
            held = parts[-1]
            if len(held[0]) > 4 * count:  # all chunks of it but the last are whole
                *whole, held = split(held)
                for x in whole:
                    yield chunk(x)
        if held is not None:
            yield from cut(held, True)

    def split(part: list[np.ndarray]) -> list[list[np.ndarray]]:
        at = cuts(part[3], part[4], count, span)
        return [[x[i:j] for x in part] for i, j in zip(at, [*at[1:], len(part[0])], strict=True)]

    def cut(part: list[np.ndarray], last: bool):
        for x in split(part):
            yield chunk(x)

    return dealt.select(*RUN_COLUMNS, "bin").mapInArrow(run, "a_member bigint, a_min bigint, b_member bigint, b_min bigint, entry binary, blob binary")


def _members_section(rows: list, chunk_members: np.ndarray, mins: np.ndarray, ends: np.ndarray) -> bytes:
    names = [r["name"].encode() for r in rows]
    out = np.zeros(len(rows), MEMBER)
    out["name_len"] = [len(x) for x in names]
    out["name_off"] = np.cumsum(out["name_len"]) - out["name_len"]
    out["length"] = [r["length"] for r in rows]
    for k in range(len(rows)):
        at = np.flatnonzero(chunk_members == k)
        if len(at):
            out[k]["first_chunk"], out[k]["n_chunks"], out[k]["axis_min"], out[k]["axis_max"] = at[0], len(at), mins[at].min(), ends[at].max()
    out["first_chunk"] = np.cumsum(out["n_chunks"]) - out["n_chunks"]
    by_name = np.array(sorted(range(len(rows)), key=names.__getitem__), "<u4")
    return struct.pack("<I", len(rows)) + out.tobytes() + b"".join(names) + by_name.tobytes()


def _pages(raw: bytes, size: int) -> np.ndarray:
    return np.array([zlib.crc32(raw[k : k + PAGE * size]) for k in range(0, len(raw), PAGE * size)], "<u4")


def write(path: str, runs_: DataFrame, members: DataFrame, groups: DataFrame, meta: DataFrame, sections: DataFrame, count: int = CHUNK_RUNS, span: int = CHUNK_SPAN, squeeze: bool = True) -> None:
    """One container file; the old file of that name, if any, stays until the new one is whole."""
    told = {r["key"]: r["value"] for r in meta.collect()}
    profile, order, overlap = told.pop("profile", ""), told.pop("order", "a"), told.pop("axis_a_overlaps", "no") == "yes"
    by_b = order == "b"
    head = HEADER.pack(MAGIC, MAJOR, 0, (ORDER_B if by_b else 0) | (A_OVERLAP if overlap else 0), profile.encode()[:31], 0)
    fs, where = located(path)
    table: list[tuple[str, int, int, int]] = []
    with fs.open_output_stream(where + ".part") as out:
        at = out.write(head)

        def put(name: str, raw: bytes) -> None:
            nonlocal at
            at += out.write(b"\0" * (-at % 8))
            table.append((name, at, len(raw), zlib.crc32(raw)))
            at += out.write(raw)

        start, crc, entries = at, 0, []
        for r in encoded(runs_, by_b, count, span, squeeze).orderBy("a_member", "a_min", "b_member", "b_min").select("entry", "blob").toLocalIterator():
            e = np.frombuffer(bytes(r["entry"]), DIRECTORY).copy()
            e["off"] = at - start
            crc = zlib.crc32(r["blob"], crc)
            at += out.write(bytes(r["blob"]))
            entries.append(e)
        table.append(("runs", start, at - start, crc))
        e = np.concatenate([np.zeros(0, DIRECTORY), *entries])
        turn = np.lexsort((e["b_min"], e["b_member"]))
        by = np.zeros(len(e), BY_B)
        by["chunk"], by["reach"] = turn, _reach(e[turn], "b")
        raw = {"dir.a": e.tobytes(), "dir.a.max": _reach(e, "a").astype("<u8").tobytes(), "dir.b": by.tobytes()}
        for name, x in raw.items():
            put(name, x)
        sums = struct.pack("<IIQQQ", PAGE, 0, len(e), int(e["n_runs"].sum(dtype=np.int64)), int(e["clen"].sum(dtype=np.int64)))
        put("dir.crc", sums + b"".join(_pages(raw[n], k).tobytes() for n, k in (("dir.a", DIRECTORY.itemsize), ("dir.a.max", 8), ("dir.b", BY_B.itemsize))))
        for axis, own in (("a", e), ("b", e[turn])):
            rows = members.filter(F.col("axis") == axis).orderBy("member_id").collect()
            put(f"mem.{axis}", _members_section(rows, own[f"{axis}_member"], own[f"{axis}_min"], own[f"{axis}_min"] + own[f"{axis}_span"]))
            names = [r["name"].encode() for r in groups.filter(F.col("axis") == axis).orderBy("group_id").collect()]
            if names:
                ends = np.cumsum([0, *map(len, names)]).astype("<u4")
                of = np.array([NO_GROUP if r["group_id"] is None else r["group_id"] for r in rows], "<u4")
                put(f"grp.{axis}", struct.pack("<I", len(names)) + ends.tobytes() + b"".join(names) + of.tobytes())
        pairs = [x.encode() for k in sorted(told, key=str.encode) for x in (k, told[k])]
        put("meta", struct.pack("<I", len(told)) + b"".join(struct.pack("<I", len(x)) + x for x in pairs))
        for r in sections.orderBy("id").toLocalIterator():
            put(r["id"], bytes(r["data"]))
        footer = struct.pack("<I", len(table)) + b"".join(bytes([len(n.encode())]) + n.encode() + SECTION.pack(o, k, k, 0, 0, c) for n, o, k, c in table)
        at += out.write(b"\0" * (-at % 8))
        out.write(footer + TRAILER.pack(at, len(footer), zlib.crc32(footer), zlib.crc32(head), MAGIC))
    fs.move(where + ".part", where)
