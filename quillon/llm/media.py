"""ISO media containers as columns.

`mux` stores a payload as a one-track file: nested boxes with sample tables,
and the samples in one media-data box.  `probe` walks the boxes of such a file
or any other, decodes the sample tables of the first track, fragments included,
and gives codec, duration and the byte range of each keyframe; it reads no
payload byte.  `payload` follows the tables to the sample bytes and joins them.

Null and empty texts are stored as one frame of padding; a very long text is
one file, with 64-bit offsets where it needs them.  Equal texts give equal
bytes, repeated rows too: no clock or random value goes into a file.  Damaged
files give what can be read: a table stops where its box ends, and samples that
lie outside the file are left out.  Only doc_id and text are read, whatever
other columns are called.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, map_rows

FRAME = 576
RATE = 8000
KEY_EVERY = 12
FRAMES_IN_CHUNK = 25
CODEC = b"raw "
CONTAINERS = frozenset((b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"))
_UNIT = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(data: bytes) -> bytes:
    """A file whose samples are the frames of data, a positive multiple of the frame size."""
    frames = len(data) // FRAME
    chunks = -(-frames // FRAMES_IN_CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, FRAMES_IN_CHUNK, 1)] if chunks > 1 else []
    if (rest := frames - (chunks - 1) * FRAMES_IN_CHUNK) != FRAMES_IN_CHUNK or not runs:
        runs.append((chunks, rest, 1))
    keys = range(1, frames + 1, KEY_EVERY)

    def moov(first: int) -> bytes:
        wide = first + len(data) >= 1 << 32
        offsets = [first + i * FRAMES_IN_CHUNK * FRAME for i in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        long = frames * FRAME
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, long, 0x55C4, 0), version=1),
            full(b"hdlr", struct.pack(">I4s", 0, b"soun"), bytes(12), b"payload\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, long), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _UNIT, bytes(8), version=1, flags=7), media)
        movie = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, long, 0x10000, 0x100), bytes(10), _UNIT, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", movie, track)

    prefix = 8 if len(data) + 8 < 1 << 32 else 16
    size = len(head) + len(moov(0)) + prefix
    table = moov(size)
    if len(table) + len(head) + prefix != size:  # offsets have become wide
        size = len(table) + len(head) + prefix
        table = moov(size)
    return head + table + box(b"mdat", data)


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, begin of the body, end) of each box, parents first. Stops where a size can't be right."""
    todo = [(at, len(data) if end is None else end, path)]
    while todo:
        at, end, path = todo.pop()
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1 and at + 16 <= end:
                size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
            elif size == 0:
                size = end - at
            if size < body - at or at + size > end:
                break
            here = (*path, kind)
            yield here, body, at + size
            if kind in CONTAINERS:
                todo.append((at + size, end, path))
                at, end, path = body, at + size, here
                continue
            at += size


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    #: Begin, end and whether it is a keyframe of each sample that lies in the file.
    samples: list[tuple[int, int, bool]] = field(default_factory=list)


def _numbers(data: bytes, at: int, end: int, count: int, kind: str, stride: int = 0) -> list[int]:
    """`count` numbers from `at` on, fewer where the box ends before."""
    size = struct.calcsize(f">{kind}")
    stride = stride or size
    return [struct.unpack_from(f">{kind}", data, p)[0] for p in range(at, min(at + count * stride, end - size + 1), stride)]


class Fields:
    """Reads numbers one after the other; what lies beyond the end is 0 and `short` tells."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end, self.short = data, at, end, False

    def take(self, kind: str = "I") -> int:
        size = struct.calcsize(f">{kind}")
        self.at += size
        if self.at > self.end:
            self.short = True
            return 0
        return struct.unpack_from(f">{kind}", self.data, self.at - size)[0]


class Probe:
    """What the walk over a file's boxes gathers about its first track."""

    def __init__(self, data: bytes):
        self.data, self.track = data, Track()
        self.tracks, self.id = 0, None
        self.sizes: list[int] | range = []
        self.same, self.count = 0, 0
        self.chunks: list[int] = []
        self.runs: list[tuple[int, int]] = []
        self.keys: set[int] | None = None
        self.defaults: dict[int, tuple[int, int]] = {}
        self.moof = self.base = self.next = 0
        self.here, self.size, self.flags = False, 0, 0

    def run(self) -> Track:
        for path, at, end in walk(self.data):
            kind = path[-1].decode("latin-1").strip()
            if kind == "trak":
                self.tracks += 1
            elif kind == "moof":
                self.moof = self.next = at - 8
            elif b"trak" in path[:-1] and self.tracks != 1:
                continue
            elif (read := getattr(self, f"on_{kind}", None)) is not None:
                read(at, end)
        n = 0
        for i, (first, per) in enumerate(self.runs):
            last = self.runs[i + 1][0] if i + 1 < len(self.runs) else len(self.chunks) + 1
            for place in self.chunks[max(0, first - 1) : max(0, last - 1)]:
                for size in [self.same] * min(per, self.count - n) if self.same else self.sizes[n : n + per]:
                    n += 1
                    self.sample(place, size, self.keys is None or n in self.keys)
                    place += size
        self.track.samples.sort(key=lambda x: x[0]) if self.moof and not self.runs else None
        return self.track

    def sample(self, at: int, size: int, key: bool) -> None:
        if 0 <= at and at + size <= len(self.data):
            self.track.samples.append((at, at + size, key))

    def on_tkhd(self, at: int, end: int) -> None:
        box = Fields(self.data, at, end)
        wide = box.take("B")
        box.at = at + (20 if wide else 12)
        self.id = box.take()

    def on_mdhd(self, at: int, end: int) -> None:
        box = Fields(self.data, at, end)
        wide = box.take("B")
        box.at = at + (20 if wide else 12)
        scale, duration = box.take(), box.take("Q" if wide else "I")
        if not box.short:
            self.track.timescale, self.track.duration = scale, min(duration, (1 << 63) - 1)

    def on_stsd(self, at: int, end: int) -> None:
        if end - at >= 16:
            self.track.codec = self.data[at + 12 : at + 16].decode("latin-1")

    def on_stsz(self, at: int, end: int) -> None:
        box = Fields(self.data, at + 4, end)
        self.same, self.count = box.take(), box.take()
        if self.same:
            self.count = min(self.count, len(self.data) // self.same)
        else:
            self.sizes = _numbers(self.data, at + 12, end, self.count, "I")

    def on_stco(self, at: int, end: int, kind: str = "I") -> None:
        count = Fields(self.data, at + 4, end).take()
        self.chunks = _numbers(self.data, at + 8, end, count, kind)

    def on_co64(self, at: int, end: int) -> None:
        self.on_stco(at, end, "Q")

    def on_stsc(self, at: int, end: int) -> None:
        count = Fields(self.data, at + 4, end).take()
        first, per = (_numbers(self.data, at + 8 + 4 * i, end, count, "I", 12) for i in range(2))
        self.runs = list(zip(first, per))

    def on_stss(self, at: int, end: int) -> None:
        count = Fields(self.data, at + 4, end).take()
        self.keys = set(_numbers(self.data, at + 8, end, count, "I"))

    def on_trex(self, at: int, end: int) -> None:
        box = Fields(self.data, at + 4, end)
        track, _, _, size, flags = (box.take() for _ in range(5))
        self.defaults[track] = size, flags

    def on_tfhd(self, at: int, end: int) -> None:
        box = Fields(self.data, at, end)
        marks, track = box.take() & 0xFFFFFF, box.take()
        self.here = self.id is None or track == self.id
        base = box.take("Q") if marks & 0x1 else self.moof
        self.base = self.next = base
        for mark in (0x2, 0x8):
            if marks & mark:
                box.take()
        size, flags = self.defaults.get(track, (0, 0))
        self.size = box.take() if marks & 0x10 else size
        self.flags = box.take() if marks & 0x20 else flags

    def on_trun(self, at: int, end: int) -> None:
        if not self.here:
            return
        box = Fields(self.data, at, end)
        marks, count = box.take() & 0xFFFFFF, box.take()
        place = self.base + box.take("i") if marks & 0x1 else self.next
        first = box.take() if marks & 0x4 else None
        if not marks & 0xF00:  # nothing is stored for each sample
            count = min(count, len(self.data) // max(1, self.size))
        for i in range(count):
            if marks & 0x100:
                box.take()
            size = box.take() if marks & 0x200 else self.size
            flags = box.take() if marks & 0x400 else self.flags
            if marks & 0x800:
                box.take()
            if box.short:
                break
            self.sample(place, size, not (first if first is not None and i == 0 else flags) & 0x10000)
            place += size
        self.next = place


def probe(data: bytes) -> Track:
    """Codec, duration and samples of the file's first track."""
    return Probe(data).run()


def keyframes(track: Track) -> list[tuple[int, int]]:
    """Byte range of each keyframe; all samples where the file names none."""
    return [(a, b) for a, b, key in track.samples if key]


def payload(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b, _ in track.samples)


def store(documents: DataFrame) -> DataFrame:
    """The media column and what its tables say: doc_id, n_bytes, media, codec, timescale, duration, keyframes."""

    def make():
        def row(doc_id, text):
            media = mux(padded(text))
            track = probe(media)
            return doc_id, len((text or "").encode("utf-8", "surrogatepass")), media, track.codec, track.timescale, track.duration, [{"begin": a, "end": b} for a, b in keyframes(track)]

        return row

    kind, arrow = id_type(documents)
    fields = [("doc_id", arrow), ("n_bytes", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("keyframes", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
    return map_rows(documents, ["doc_id", "text"], make, fields, f"doc_id {kind}, n_bytes bigint, media binary, codec string, timescale bigint, duration bigint, keyframes array<struct<begin:bigint,end:bigint>>")


def digest(stored: DataFrame) -> DataFrame:
    """Reads the stored bytes back and gives their digests, and the feature: codec, duration over time scale, keyframe ranges."""

    def make():
        def row(doc_id, n_bytes, media):
            track = probe(media)
            data = payload(media, track)
            ranges = ",".join(f"{a}-{b}" for a, b in keyframes(track))
            feature = f"{track.codec.strip()};{track.duration}/{track.timescale};{ranges}"
            return doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return row

    kind, arrow = id_type(stored)
    names = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    fields = [("doc_id", arrow), *((n, pa.int64() if t == "bigint" else pa.string()) for n, t in names)]
    return map_rows(stored, ["doc_id", "n_bytes", "media"], make, fields, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in names))
