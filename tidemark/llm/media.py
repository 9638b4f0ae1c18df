"""ISO base media containers as columns.

``wrap`` stores bytes as uncompressed 8-bit grey frames of 24 x 24 samples in an
ISO container. ``inspect`` walks the nested boxes of any such file and decodes
its sample tables, those of movie fragments included: codec, duration, and the byte
ranges of keyframes, without decoding a payload. ``read_samples`` follows the same
tables to the stored bytes. No byte of a file is trusted: boxes that end beyond
what holds them end the walk, tables have no more rows than their box has room for
(nor more samples of one size than the file has), and boxes that are too short for
what they should hold are passed over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
CHUNK = 50
#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(raw: bytes) -> bytes:
    """Bytes 255 up to the next positive multiple of the frame size."""
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def wrap(payload: bytes) -> bytes:
    """A container with one grey video track; every RATE-th frame is a sync sample."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    at = len(ftyp) + (8 if len(payload) + 8 < 1 << 32 else 16)
    wide = at + len(payload) >= 1 << 32
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1),
        bytes(32), struct.pack(">Hh", 40, -1),
    )
    runs = [(1, min(CHUNK, frames), 1)]
    if chunks > 1 and frames % CHUNK:
        runs.append((chunks, frames % CHUNK, 1))
    offsets = [at + i * CHUNK * FRAME for i in range(chunks)]
    sync = range(1, frames + 1, RATE)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, frames, 1)),
        full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, frames)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
    )
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
        full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"grey\0"),
        box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl),
    )
    track = full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
    movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, frames, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
    return ftyp + box(b"mdat", payload) + box(b"moov", movie, box(b"trak", track, media))


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    tables: dict = field(default_factory=dict)
    #: Samples of movie fragments: (offset, size, ticks, whether it is a keyframe).
    fragments: list[tuple[int, int, int, bool]] = field(default_factory=list)

    def samples(self) -> list[tuple[int, int]]:
        """(offset, size) of each sample, from the size, chunk and run tables, then of fragments."""
        return self._listed() + [x[:2] for x in self.fragments]

    def _listed(self) -> list[tuple[int, int]]:
        sizes, offsets, runs = self.tables.get("size", []), self.tables.get("offset", []), self.tables.get("run", [])
        out, k = [], 0
        for i, (first, per, _) in enumerate(runs):
            last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
            for chunk in range(max(first, 1) - 1, min(last, len(offsets))):
                at = offsets[chunk]
                for _ in range(per):
                    if k == len(sizes):
                        return out
                    out.append((at, sizes[k]))
                    at += sizes[k]
                    k += 1
        return out

    def keyframes(self) -> list[tuple[int, int]]:
        """(start, end) byte ranges of sync samples; without a sync table all are."""
        found = self._listed()
        sync = self.tables.get("sync")
        picked = found if sync is None else [found[i - 1] for i in sync if 0 < i <= len(found)]
        return [(at, at + size) for at, size in [*picked, *(x[:2] for x in self.fragments if x[3])]]

    @property
    def count(self) -> int:
        return len(self.tables.get("size", [])) + len(self.fragments)

    @property
    def seconds(self) -> float:
        ticks = sum(n * d for n, d in self.tables.get("time", [])) + sum(x[2] for x in self.fragments)
        return (ticks or self.duration) / max(self.timescale, 1)


def boxes(data: memoryview, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end); sizes 0 (to the end) and 1 (64 bits) are known, broken ones end the walk."""
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= stop:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        end = stop if size == 0 else start + size
        if end > stop or end < body:
            return
        yield kind, body, end
        start = end


def _table(body: memoryview, skip: int, form: str) -> list[tuple]:
    """Rows of a counted table, never more than fit in its box."""
    width = struct.calcsize(">" + form)
    n = min(struct.unpack_from(">I", body, skip)[0], (len(body) - skip - 4) // width)
    return list(struct.iter_unpack(">" + form, body[skip + 4 : skip + 4 + n * width]))


def _read_box(track: Track, kind: bytes, body: memoryview, file_size: int) -> None:
    """What one box says of its track; struct.error or IndexError if it is too short."""
    if kind == b"tkhd":
        track.number = struct.unpack_from(">I", body, 20 if body[0] == 1 else 12)[0]
    elif kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ" if body[0] == 1 else ">II", body, 20 if body[0] == 1 else 12)
    elif kind == b"hdlr":
        track.handler = struct.unpack_from(">4s", body, 8)[0].decode("latin-1")
    elif kind == b"stsd":
        track.codec = struct.unpack_from(">I4s", body, 8)[1].decode("latin-1")
        if track.handler in ("", "vide"):
            track.width, track.height = struct.unpack_from(">HH", body, 40)
    elif kind == b"stts":
        track.tables["time"] = _table(body, 4, "II")
    elif kind == b"stss":
        track.tables["sync"] = [x[0] for x in _table(body, 4, "I")]
    elif kind == b"stsc":
        track.tables["run"] = _table(body, 4, "III")
    elif kind == b"stsz":
        fixed, n = struct.unpack_from(">II", body, 4)
        track.tables["size"] = [fixed] * min(n, file_size // fixed) if fixed else [x[0] for x in _table(body, 8, "I")]
    elif kind in (b"stco", b"co64"):
        track.tables["offset"] = [x[0] for x in _table(body, 4, "Q" if kind == b"co64" else "I")]


@dataclass
class _Fragment:
    """Where a fragment's samples are and what they are like unless they say so."""

    track: Track
    base: int
    ticks: int
    size: int
    flags: int


def _fragment(body: memoryview, moof: int, tracks: list[Track], usual: dict[int, tuple]) -> _Fragment | None:
    """A track fragment's header."""
    flags, number = struct.unpack_from(">II", body)
    track = next((t for t in tracks if t.number == number), None)
    if track is None:
        return None
    at, (ticks, size, marks) = 8, usual.get(number, (0, 0, 0))
    base, names = moof, {0x1: "Q", 0x2: "I", 0x8: "I", 0x10: "I", 0x20: "I"}
    for bit, form in names.items():
        if flags & bit:
            value = struct.unpack_from(">" + form, body, at)[0]
            at += struct.calcsize(form)
            base = value if bit == 0x1 else base
            ticks = value if bit == 0x8 else ticks
            size = value if bit == 0x10 else size
            marks = value if bit == 0x20 else marks
    return _Fragment(track, base, ticks, size, marks)


def _fragment_run(body: memoryview, fragment: _Fragment, start: int, file_size: int) -> int:
    """Add a run's samples to the fragment's track; ``start`` is where they are unless the run says so. Gives their end."""
    flags, n = struct.unpack_from(">II", body)
    at, first = 8, None
    if flags & 0x1:
        start = fragment.base + struct.unpack_from(">i", body, at)[0]
        at += 4
    if flags & 0x4:
        first = struct.unpack_from(">I", body, at)[0]
        at += 4
    own = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    width = 4 * len(own)
    n = min(n, (len(body) - at) // width if width else file_size // max(fragment.size, 1))
    for k in range(n):
        said = dict(zip(own, struct.unpack_from(f">{len(own)}I", body, at + k * width)))
        size = said.get(0x200, fragment.size)
        marks = said.get(0x400, first if k == 0 and first is not None else fragment.flags)
        fragment.track.fragments.append((start, size, said.get(0x100, fragment.ticks), not marks & 0x10000))
        start += size
    return start


def inspect(media: bytes) -> list[Track]:
    """The tracks of a container. Bytes that are no container have none."""
    data, tracks = memoryview(media), []
    usual: dict[int, tuple] = {}
    moof, fragment, following = 0, None, 0
    walks = [boxes(data, 0, len(data))]  # as deep as boxes are nested
    while walks:
        found = next(walks[-1], None)
        if found is None:
            walks.pop()
            continue
        kind, at, end = found
        if kind == b"trak":
            tracks.append(Track())
        elif kind == b"moof":
            moof = following = at - 8
        elif kind == b"traf":
            fragment = None
        if kind in CONTAINERS:
            walks.append(boxes(data, at, end))
            continue
        body = data[at:end]
        try:
            if kind == b"trex":
                number, _, *values = struct.unpack_from(">5I", body, 4)
                usual[number] = tuple(values)
            elif kind == b"tfhd":
                fragment = _fragment(body, moof, tracks, usual)
                following = fragment.base if fragment else following
            elif kind == b"trun" and fragment is not None:
                following = _fragment_run(body, fragment, following, len(data))
            elif tracks:
                _read_box(tracks[-1], kind, body, len(data))
        except (struct.error, IndexError):
            continue
    return tracks


def read_samples(media: bytes, track: Track) -> bytes:
    """A track's stored bytes; samples that touch are read as one run."""
    runs: list[list[int]] = []
    for at, size in track.samples():
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + size
        else:
            runs.append([at, at + size])
    return b"".join(media[a:b] for a, b in runs)


def describe(track: Track) -> str:
    """One line: codec, frame size, seconds, samples, and keyframe ranges (count, first, last, checksum of all)."""
    keys = track.keyframes()
    packed = b"".join(struct.pack(">QQ", *k) for k in keys)
    first, last = (keys[0], keys[-1]) if keys else ((0, 0), (0, 0))
    return (
        f"codec={track.codec.strip()};size={track.width}x{track.height};seconds={track.seconds:.3f};"
        f"samples={track.count};keyframes={len(keys)};first={first[0]}-{first[1]};"
        f"last={last[0]}-{last[1]};ranges={zlib.crc32(packed):08x}"
    )


TRACK_SCHEMA = (
    "struct<handler: string, codec: string, width: int, height: int, duration_seconds: double, samples: bigint, "
    "keyframes: array<struct<start: bigint, end: bigint>>>"
)
MEDIA_SCHEMA = (
    "codec string, width int, height int, duration_seconds double, samples bigint, "
    f"keyframes array<struct<start: bigint, end: bigint>>, tracks array<{TRACK_SCHEMA}>"
)


def media_columns(files: DataFrame, media_col: str = "media") -> DataFrame:
    """``files`` with columns for each container in ``media_col``.

    ``tracks`` has all tracks in order of the file. The other columns are those of the
    first video track, or of the first track where there is none. Null, empty or
    unreadable media give nulls; rows that repeat are read each. Payload bytes are never decoded. Columns
    of ``files`` with the same names as the new ones are replaced.
    """
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), ranges]
    one = pa.struct([("handler", pa.string()), *zip(["codec", "width", "height", "duration_seconds", "samples", "keyframes"], kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for blob in batch.column(batch.schema.get_field_index(media_col)):
                tracks = inspect(blob.as_py()) if blob.is_valid else []
                said = [
                    {"handler": t.handler, "codec": t.codec, "width": t.width, "height": t.height, "duration_seconds": t.seconds, "samples": t.count,
                     "keyframes": [{"start": a, "end": b} for a, b in t.keyframes()]}
                    for t in tracks
                ]
                chosen = next((x for x in said if x["handler"] == "vide"), said[0] if said else None)
                rows.append((*[chosen[c] for c in added[:-1]], said) if chosen else (None,) * len(added))
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([*kinds, pa.list_(one)])]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *new], names)

    added = ["codec", "width", "height", "duration_seconds", "samples", "keyframes", "tracks"]
    keep = [i for i, c in enumerate(files.columns) if c not in added]
    names = [files.columns[i] for i in keep] + added
    old = ", ".join(f"`{files.columns[i]}` {files.schema[i].dataType.simpleString()}" for i in keep)
    return files.mapInArrow(run, f"{old}, {MEDIA_SCHEMA}")


def stored_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a container, read back, with digests of both and a feature line.

    A null text is stored as an empty one; rows that repeat each have a row, and rows
    without an id a null one. Other columns of ``docs`` are not looked at.
    """
    out = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                raw = text.as_py() if text.is_valid else b""
                media = wrap(pad(raw))
                track = inspect(media)[0]
                payload = read_samples(media, track)
                rows.append((
                    len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), describe(track),
                ))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = [x.split()[0] for x in out.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
