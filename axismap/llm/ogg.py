"""Media columns: Ogg containers held in a binary column.

A document's UTF-8 bytes, zero-padded to a positive multiple of 64, become the
8-bit samples of one logical stream (PCM, mono, 8 kHz, 8-bit). A second logical
stream carries a checksum for each ``SECTION`` samples, the unpadded length and the
payload's digest; its pages stand among those of the sound, by time. Reading verifies
every page checksum, separates the logical streams by serial number, puts packets
together from lacing values (over page ends too), turns granule positions into
timestamps, and holds the sound against what the other stream says of it.

Defined results: null and empty texts are 64 zero bytes; equal texts give equal
containers (serial numbers come from the payload, never from the row); repeated
rows stay repeated; an empty table gives an empty result. Of a container that is damaged
or no container, what can be counted is told (size, digest, streams, pages) and the rest
is null; a null container has all nulls. New columns get underscores where a kept one has
their name; other columns are ignored. A container of any length is handled one row at a
time, so memory is bounded by the longest single text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axismap.llm.tables import slices, unused

SAMPLE_RATE = 8000
PACKET_SAMPLES = 5000
SECTION = 40_000
PAD_TO = 64
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_MAGIC, NOTE_MAGIC = b"PCM     ", b"NOTE    "
UNSIGNED_8 = 1
NO_GRANULE = -1
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
MARK = struct.Struct("<8sQ32s")
CHECK = struct.Struct("<8sQI")
CHECK_MAGIC = b"CHECK   "
PCM = struct.Struct(">8sHHIIBBHI")


def page_crc(page: bytes) -> int:
    """The CRC-32 of Ogg (polynomial 04C11DB7, not reflected, zero start and end).

    It is the reflected CRC of the bit-reversed bytes, itself bit-reversed.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: list[int], body: bytes) -> bytes:
    tail = bytes(lacing) + body
    bare = _HEAD.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + tail
    return _HEAD.pack(CAPTURE, 0, kind, granule, serial, number, page_crc(bare), len(lacing)) + tail


def stream_pages(serial: int, packets: list[tuple[bytes, int]], own_page: int = 1) -> list[tuple[int, bytes]]:
    """Pages (granule, bytes) of one logical stream of (packet, granule at its end).

    The first ``own_page`` packets get a page to themselves. A packet that ends on a
    multiple of 255 bytes gets a closing lacing value of 0; one that needs more than
    255 values goes on in a continued page, and a page on which no packet ends has
    granule -1.
    """
    pages: list[tuple[int, bytes]] = []
    lacing: list[int] = []
    parts: list[bytes] = []
    state = {"granule": NO_GRANULE, "continued": False}

    def flush(last: bool, goes_on: bool) -> None:
        kind = (CONTINUED if state["continued"] else 0) | (0 if pages else FIRST) | (LAST if last else 0)
        pages.append((state["granule"], _page(kind, state["granule"], serial, len(pages), lacing, b"".join(parts))))
        lacing.clear()
        parts.clear()
        state.update(granule=NO_GRANULE, continued=goes_on)

    for k, (packet, granule) in enumerate(packets):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while values:
            room = 255 - len(lacing)
            if not room:
                flush(False, at > 0)
                continue
            now, values = values[:room], values[room:]
            lacing.extend(now)
            parts.append(packet[at : at + sum(now)])
            at += sum(now)
        state["granule"] = granule
        if k < own_page and k + 1 < len(packets):
            flush(False, False)
    flush(True, False)
    return pages


def encode(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg physical stream: a PCM stream and a note stream, multiplexed by time."""
    digest = hashlib.sha256(payload).digest()
    serial = int.from_bytes(digest[:4], "little")
    head = PCM.pack(PCM_MAGIC, 0, 0, UNSIGNED_8, SAMPLE_RATE, 8, 1, PACKET_SAMPLES, 0)
    packets = [(head, 0)]
    packets += [(payload[k : k + PACKET_SAMPLES], min(k + PACKET_SAMPLES, len(payload))) for k in range(0, len(payload), PACKET_SAMPLES)]
    sound = stream_pages(serial, packets)
    checks = [(CHECK.pack(CHECK_MAGIC, e := min(k + SECTION, len(payload)), zlib.crc32(payload[k:e])), e) for k in range(0, len(payload), SECTION)]
    notes = [(NOTE_MAGIC, 0), *checks, (MARK.pack(NOTE_MAGIC, n_bytes, digest), len(payload))]
    note = stream_pages(serial ^ 1, notes, own_page=len(notes))
    return sound[0][1] + note[0][1] + b"".join(x[3] for x in sorted([*_timed(sound, 0), *_timed(note, 1)]))


def _timed(pages: list[tuple[int, bytes]], stream: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Pages after the first with what orders them: the samples up to their end (a page without an end: up to the last one)."""
    at = 0
    for k, (granule, page) in enumerate(pages[1:]):
        at = at if granule == NO_GRANULE else granule
        yield at, stream, k, page


@dataclass
class Logical:
    """A demultiplexed logical stream: whole packets and where each ends."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    bad_pages: int = 0
    lost: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)
    _next: int = 0


def pages_of(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes, bool]]:
    """(kind, granule, serial, number, lacing, body, checksum holds) of each page.

    Bytes that belong to no page are skipped up to the next capture pattern.
    """
    at = data.find(CAPTURE)
    while 0 <= at and at + _HEAD.size <= len(data):
        _, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        body_at = at + _HEAD.size + n
        lacing = data[at + _HEAD.size : body_at]
        end = body_at + sum(lacing)
        whole = version == 0 and len(lacing) == n and end <= len(data)
        held = whole and page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc
        if whole:
            yield kind, granule, serial, number, lacing, data[body_at:end], held
        at = data.find(CAPTURE, end if held else at + 4)


def decode(data: bytes) -> dict[int, Logical]:
    """Logical streams by serial number.

    A page with a wrong checksum is left out and counted; the packet that it
    interrupts is counted as lost, and reading goes on with the next packet.
    """
    found: dict[int, Logical] = {}
    for kind, granule, serial, number, lacing, body, held in pages_of(data):
        if not held:
            if serial in found:
                found[serial].bad_pages += 1
            continue
        s = found.setdefault(serial, Logical(serial))
        s.pages += 1
        if number != s._next and s._open:
            s.lost += 1
            s._open.clear()
        s._next = number + 1
        skipping = bool(kind & CONTINUED) and not s._open
        if not kind & CONTINUED and s._open:
            s.lost += 1
            s._open.clear()
        at, ends = 0, []
        for value in lacing:
            s._open.append(body[at : at + value])
            at += value
            if value < 255:
                if skipping:
                    s.lost += 1
                    skipping = False
                else:
                    ends.append(len(s.packets))
                    s.packets.append(b"".join(s._open))
                    s.granules.append(NO_GRANULE)
                s._open.clear()
        if ends:
            s.granules[ends[-1]] = granule
        s.ended = bool(kind & LAST)
    return found


def is_sound(stream: Logical) -> bool:
    """Whether a stream starts with a PCM header."""
    return bool(stream.packets) and len(stream.packets[0]) == PCM.size and stream.packets[0].startswith(PCM_MAGIC)


def timestamps(stream: Logical) -> list[float | None]:
    """Seconds at which each data packet of a PCM stream ends.

    A page states the granule of its last whole packet; those before it on the
    page follow from their lengths, as one byte is one sample. Header: None.
    """
    rate = PCM.unpack(stream.packets[0])[4]
    out: list[float | None] = [None] * len(stream.packets)
    known: int | None = None
    for k in range(len(stream.packets) - 1, 0, -1):
        known = stream.granules[k] if stream.granules[k] != NO_GRANULE else known
        if known is not None:
            out[k] = known / rate
            known -= len(stream.packets[k])
    return out


def pad(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (max(1, -(-len(raw) // PAD_TO)) * PAD_TO - len(raw)), len(raw)


def payload_of(streams: dict[int, Logical]) -> tuple[bytes, int, Logical] | None:
    """The samples, the unpadded length and the sound; None if they aren't what was written."""
    sound = next((s for s in streams.values() if is_sound(s)), None)
    note = next((s for s in streams.values() if s.packets and s.packets[0] == NOTE_MAGIC), None)
    if not sound or not note or len(note.packets) < 2 or len(note.packets[-1]) != MARK.size:
        return None
    payload = b"".join(sound.packets[1:])
    _, n, digest = MARK.unpack(note.packets[-1])
    at = 0
    for packet in note.packets[1:-1]:
        if len(packet) != CHECK.size:
            return None
        _, upto, crc = CHECK.unpack(packet)
        if zlib.crc32(payload[at:upto]) != crc:
            return None
        at = upto
    whole = at == len(payload) == sound.granules[-1] and hashlib.sha256(payload).digest() == digest
    return (payload, n, sound) if whole else None


def features(payload: bytes, sound: Logical) -> str:
    """A digest of the sound: length, packets, level, centre crossings, energy by quarter."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    sign = x >= 0
    quarters = [int((q * q).mean()) for q in np.array_split(x, 4)]
    last = timestamps(sound)[-1]
    return (
        f"ms={round((last or 0) * 1000)};packets={len(sound.packets) - 1};mean={int(x.sum()) / len(x):.3f};"
        f"rms={(int((x * x).sum()) / len(x)) ** 0.5:.3f};crossings={int((sign[1:] != sign[:-1]).sum())};"
        f"peak={int(np.abs(x).max())};energy={','.join(map(str, quarters))}"
    )


def _kept(df: DataFrame, keep: tuple[str, ...], column: str) -> tuple[DataFrame, str]:
    """The kept columns and ``column`` (last, under a name of its own), and the schema of the kept ones."""
    named = [F.col(f"`{c}`") for c in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*named).schema)
    return df.select(*named, F.col(f"`{column}`").alias(unused(keep, "body"))), kinds


def to_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``media``, the Ogg container of each whole text. No shuffle."""
    slim, kinds = _kept(docs, keep, text)
    name = unused(keep, "media")

    def run(batches):
        for b in slices(batches):
            made = [encode(*pad(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(made, pa.binary())], [*keep, name])

    return slim.mapInArrow(run, f"{kinds}, `{name}` binary")


def read_media(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """What is read back from the containers in ``column``: sizes, digests and features of each payload."""
    slim, kinds = _kept(media, keep, column)
    fields = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("n_streams", "int"), ("n_pages", "int"), ("bad_pages", "int"), ("seconds", "double")]
    names = [unused(keep, n) for n, _ in fields]
    kinds += "".join(f", `{n}` {k}" for n, (_, k) in zip(names, fields, strict=True))

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(fields)
        streams = decode(data)
        counts = len(streams), sum(s.pages for s in streams.values()), sum(s.bad_pages for s in streams.values())
        if (found := payload_of(streams)) is None:
            return None, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, *counts, None
        payload, n, sound = found
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD_TO:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, sound), *counts, timestamps(sound)[-1]

    def run(batches):
        kinds_of = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        for b in slices(batches):
            rows = [one(x) for x in b.column(len(keep)).to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds_of)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], [*keep, *names])

    return slim.mapInArrow(run, kinds)


def packets(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """One row per packet of every logical stream: serial, number, granule, seconds, bytes."""
    slim, kinds = _kept(media, keep, column)
    names = [unused(keep, n) for n in ("serial", "packet", "granule", "seconds", "data")]

    def run(batches):
        for b in slices(batches):
            rows, at = [], []
            for k, data in enumerate(b.column(len(keep)).to_pylist()):
                for s in decode(data or b"").values():
                    when = timestamps(s) if is_sound(s) else [None] * len(s.packets)
                    rows += [(s.serial, i, g, t, p) for i, (g, t, p) in enumerate(zip(s.granules, when, s.packets, strict=True))]
                    at += [k] * len(s.packets)
            kinds_of = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds_of)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[: len(keep)]), *cols], [*keep, *names])

    return slim.mapInArrow(run, kinds + "".join(f", `{n}` {k}" for n, k in zip(names, ("bigint", "int", "bigint", "double", "binary"), strict=True)))
