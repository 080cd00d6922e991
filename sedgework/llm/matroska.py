"""Media columns: a Matroska container written to and read from binary columns.

``packets`` parses variable-length EBML elements, clusters, simple and grouped blocks with all three
kinds of lacing, and cues, into rows of (track, timestamp, byte range, keyframe).  ``wrap`` stores
bytes as one track of 8-bit mono PCM: frames of 576 samples, eight to a laced block, eight blocks to
a cluster, with a cue for each cluster.  Times are milliseconds: the file's timestamp scale is applied, and
the frames of a laced block follow each other by the track's frame duration, else by an equal share of
the block's duration; where neither is given, all of them have the block's time.

Cases: null text counts as empty and is stored as one frame of padding; texts of any length are
stored whole; equal texts give equal bytes; broken or cut containers give the packets that can be
read and no error; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table

# Element ids of the container format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
TRACK_ENTRY, TRACK_NUMBER, FRAME_NS, SCALE = 0xAE, 0xD7, 0x23E383, 0x2AD7B1
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_AT = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6

FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER, RATE = 576, 8, 8, 8000


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones would mean unknown, so such values take a byte more."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(number: int, n: int) -> bytes:
    return _element(number, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_INFO = _element(INFO, _uint(0x2AD7B1, 1_000_000) + _element(0x4D80, b"sedgework") + _element(0x5741, b"sedgework"))
_TRACKS = _element(TRACKS, _element(0xAE, _uint(0xD7, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + _uint(0x9C, 1) + _uint(FRAME_NS, FRAME * 1_000_000_000 // RATE) + _element(0x86, b"A_PCM/INT/LIT") + _element(0xE1, _element(0xB5, struct.pack(">d", RATE)) + _uint(0x9F, 1) + _uint(0x6264, 8))))


def block(track: int, at: int, frames: list[bytes], lacing: int = FIXED, number: int = SIMPLE_BLOCK) -> bytes:
    """A block of frames; ``at`` is relative to its cluster."""
    lacing = lacing if len(frames) > 1 else NO_LACING
    body = _size(track) + struct.pack(">hB", at, 0x80 * (number == SIMPLE_BLOCK) | lacing)
    if lacing:
        body += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        body += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        body += _size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            d = n - before
            width = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
            body += _size(d + (1 << 7 * width - 1) - 1, width)
    return _element(number, body + b"".join(frames))


def wrap(payload: bytes) -> bytes:
    """The container that stores ``payload``, a multiple of FRAME bytes."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // RATE
    parts, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    step = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for c in range(0, len(frames), step):
        body = [_uint(TIMESTAMP, c * ms)]
        body += [block(1, (i - c) * ms, frames[i : min(i + FRAMES_PER_BLOCK, c + step)]) for i in range(c, min(c + step, len(frames)), FRAMES_PER_BLOCK)]
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * ms) + _element(CUE_PLACES, _uint(CUE_TRACK, 1) + _uint(CUE_AT, at))))
        parts.append(_element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


def _vint(b: bytes, i: int, keep: bool) -> tuple[int, int, bool]:
    """Value, next place, and whether all value bits are ones (an unknown size)."""
    first = b[i]
    width = 9 - first.bit_length()
    if width > 8 or i + width > len(b):
        raise IndexError
    v = int.from_bytes(b[i : i + width], "big")
    low = v & (1 << 7 * width) - 1
    return (v if keep else low), i + width, low == (1 << 7 * width) - 1


def _elements(b: bytes, i: int, end: int, stop: frozenset = frozenset()):
    """(id, start of the element, start of its body, end of its body); unknown sizes reach to ``end``."""
    while i < end:
        try:
            number, j, _ = _vint(b, i, True)
            n, j, unknown = _vint(b, j, False)
        except IndexError:
            return
        if number in stop:
            return
        last = end if unknown else min(end, j + n)
        if unknown and number == CLUSTER:
            last = next((a for k, a, _, _ in _elements(b, j, end) if k in (CLUSTER, CUES)), end)
        yield number, i, j, last
        i = last


def _laced(b: bytes, i: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(i, end)]
    n = b[i] + 1
    i += 1
    sizes: list[int] = []
    if lacing == FIXED:
        sizes = [(end - i) // n] * (n - 1)
    elif lacing == XIPH:
        for _ in range(n - 1):
            k = 0
            while b[i] == 255:
                k += 255
                i += 1
            sizes.append(k + b[i])
            i += 1
    else:
        for k in range(n - 1):
            v, j, _ = _vint(b, i, False)
            sizes.append(sizes[-1] + v - ((1 << 7 * (j - i) - 1) - 1) if k else v)
            i = j
    out = []
    for k in sizes:
        out.append((i, i + k))
        i += k
    return [*out, (i, end)]


def parse(b: bytes) -> tuple[list[tuple[int, int, int, int, bool]], list[tuple[int, int, int]]]:
    """Packets (track, time in ms, start, end, keyframe) and cues (time in ms, track, byte of the cluster)."""
    packets: list[tuple[int, int, int, int, bool]] = []
    cues: list[tuple[int, int, int]] = []

    scale, lasts = 1_000_000, {}  # nanoseconds of a unit; of a frame of each track

    def uint(j: int, e: int) -> int:
        return int.from_bytes(b[j:e], "big")

    def frames(j: int, e: int, base: int, key: bool | None, units: int = 0) -> None:
        track, j, _ = _vint(b, j, False)
        at, flags = struct.unpack_from(">hB", b, j)
        found = _laced(b, j + 3, e, flags & 6)
        step = lasts.get(track) or units * scale // len(found)
        for k, (s, t) in enumerate(found):
            if s <= t <= e:
                packets.append((track, ((base + at) * scale + k * step) // 1_000_000, s, t, bool(flags & 0x80) if key is None else key))

    for top, _, i, end in _elements(b, 0, len(b)):
        if top != SEGMENT:
            continue
        for number, _, j, e in _elements(b, i, end):
            base = 0
            try:
                if number == INFO:
                    scale = next((uint(x, y) for k, _, x, y in _elements(b, j, e) if k == SCALE), scale)
                elif number == TRACKS:
                    for k, _, x, y in _elements(b, j, e):
                        got = {z: uint(r, t) for z, _, r, t in _elements(b, x, y)} if k == TRACK_ENTRY else {}
                        if FRAME_NS in got:
                            lasts[got.get(TRACK_NUMBER, 0)] = got[FRAME_NS]
                elif number == CLUSTER:
                    for k, _, x, y in _elements(b, j, e):
                        if k == TIMESTAMP:
                            base = uint(x, y)
                        elif k == SIMPLE_BLOCK:
                            frames(x, y, base, None)
                        elif k == BLOCK_GROUP:
                            inner = list(_elements(b, x, y))
                            for m, _, p, q in inner:
                                if m == BLOCK:
                                    frames(p, q, base, not any(z[0] == 0xFB for z in inner), next((uint(r, t) for z, _, r, t in inner if z == DURATION), 0))
                elif number == CUES:
                    for k, _, x, y in _elements(b, j, e):
                        if k == CUE_POINT:
                            inner = list(_elements(b, x, y))
                            when = next((uint(p, q) for m, _, p, q in inner if m == CUE_TIME), 0)
                            for m, _, p, q in inner:
                                if m == CUE_PLACES:
                                    got = {z: uint(r, s) for z, _, r, s in _elements(b, p, q)}
                                    cues.append((when * scale // 1_000_000, got.get(CUE_TRACK, 0), i + got.get(CUE_AT, 0)))
            except (IndexError, struct.error):
                continue
    return packets, cues


def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each packet of each container: id, packet number, track, timestamp, first byte, length, keyframe, cue time.

    ``cue`` is the time of the cue that points at the packet's cluster or before it, null without cues.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "packet", "track", "timestamp_ms", "start", "n_bytes", "keyframe", "cue_ms"]

    def run(batches):
        for b in batches:
            for key, media in zip(b.column(0), b.column(1)):
                found, cues = parse(media.as_py() or b"")
                cues.sort(key=lambda c: c[2])
                places, times = [c[2] for c in cues], [None, *accumulate((c[0] for c in cues), max)]  # the latest cue up to each place
                rows = [(n, t, at, s, e - s, k, times[bisect_right(places, s)]) for n, (t, at, s, e, k) in enumerate(found)]
                if rows:
                    n, t, at, s, size, k, cue = map(list, zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), b.schema.types[0]), pa.array(n, pa.int64()), pa.array(t, pa.int64()), pa.array(at, pa.int64()), pa.array(s, pa.int64()), pa.array(size, pa.int64()), pa.array(k, pa.bool_()), pa.array(cue, pa.int64())], names=names)

    return df.select(F.col(id_col), F.col(media_col)).mapInArrow(frugal(run), f"{id_col} {kind}, packet long, track long, timestamp_ms long, start long, n_bytes long, keyframe boolean, cue_ms long")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (FRAME - len(raw) % FRAME if not raw or len(raw) % FRAME else 0)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as a container in the binary column ``media``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([wrap(padded(t.as_py())[1]) for t in part.column(1)], pa.binary())], names=[id_col, "media"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run), f"{id_col} {kind}, media binary")


def digest(text: str | None) -> tuple:
    n, payload = padded(text)
    media = wrap(payload)
    found, cues = parse(media)
    back = b"".join([media[s:e] for _, _, s, e, _ in found])
    ms = FRAME * 1000 // RATE
    feature = f"packets={len(found)};cues={len(cues)};ms={found[-1][1] + ms};sum={sum(back)};min={min(back)};max={max(back)}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads it back through the packet table and returns sizes, digests and features."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            if b.num_rows:
                cols = zip(*(digest(t.as_py()) for t in b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run), f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
