"""Matroska files as columns: written losslessly and parsed into packet tables.

An element is an identifier (1 to 4 bytes) and a size (1 to 8 bytes), both of variable length, then its
data. A Segment holds Info, Tracks, Clusters and Cues. A block of a cluster carries one frame or,
by lacing, several, whose sizes stand before the data in one of three codings (Xiph, EBML, fixed).
The parser walks the elements, undoes the lacing and gives a row per packet with its track, timestamp
and byte range in the file.

Defined results: a null text is stored as the empty payload, which padding makes 192 blanks. A
file that is cut short or holds an impossible size raises ValueError; elements that
the parser doesn't know are skipped. Equal payloads give equal files, since nothing in them depends on
time, chance or the row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

# Fixed values of the format: element identifiers with their length markers.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
MUXING_APP, WRITING_APP = 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, FLAG_LACING = 0x23E383, 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VOID, CRC32 = 0xEC, 0xBF
# Lacing, as in the flags of a block.
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: 8-bit samples of 8 kHz: a frame of 192 lasts 24 ms.
FRAME, RATE, FRAME_MS = 192, 8000, 24
#: Frames in a block and blocks in a cluster.
LACED, BLOCKS = 8, 32


class Packet(NamedTuple):
    """One frame: times in ms, byte range in the file."""

    track: int
    cluster: int
    block: int
    lace: int
    lacing: int
    timestamp: int
    keyframe: bool
    start: int
    size: int


class Cue(NamedTuple):
    time: int
    track: int
    position: int


class Media(NamedTuple):
    doc_type: str
    scale: int
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[Cue]
    clusters: list[tuple[int, int]]  #: offset from the start of the segment's data, timestamp


def vint(value: int, width: int = 0) -> bytes:
    """A size in its shortest coding, or in `width` bytes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def text(ident: int, value: str) -> bytes:
    return element(ident, value.encode())


def lace(frames: list[bytes], kind: int) -> bytes:
    """The part of a block behind its flags."""
    if kind == NO_LACING:
        return frames[0]
    out = bytearray([len(frames) - 1])
    if kind == XIPH:
        for f in frames[:-1]:
            out += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == EBML_LACING and len(frames) > 1:  # a single frame's size is that of the rest
        out += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            out += vint(d + (1 << 7 * width - 1) - 1, width)
    return bytes(out) + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit PCM that holds the payload's bytes as samples.

    The lacing changes from block to block in a fixed turn, and a last block of one frame has none.
    """
    head = element(EBML, uint(VERSION, 1) + uint(READ_VERSION, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + text(DOC_TYPE, "matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + text(MUXING_APP, "kinweave") + text(WRITING_APP, "kinweave"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + text(CODEC_ID, "A_PCM/INT/LIT") + audio
    body = bytearray(info + element(TRACKS, element(TRACK_ENTRY, entry)))
    points = []
    for c in range(0, len(frames), LACED * BLOCKS):
        time = c * FRAME_MS
        data = bytearray(uint(TIMESTAMP, time))
        for b in range(c, min(len(frames), c + LACED * BLOCKS), LACED):
            part = frames[b : b + LACED]
            kind = (FIXED, XIPH, EBML_LACING)[b // LACED % 3] if len(part) > 1 else NO_LACING
            data += element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * FRAME_MS - time, 0x80 | kind << 1) + lace(part, kind))
        points.append((time, len(body)))
        body += element(CLUSTER, bytes(data))
    body += element(CUES, b"".join(element(CUE_POINT, uint(CUE_TIME, t) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))) for t, at in points))
    return head + element(SEGMENT, bytes(body))


def read_vint(raw: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """value, width and the position behind; a size with all bits set means unknown: -1."""
    if at >= len(raw) or not raw[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - raw[at].bit_length()
    if at + width > len(raw):
        raise ValueError(f"a number is cut short at byte {at}")
    value = int.from_bytes(raw[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, width, at + width


def elements(raw: bytes, start: int, end: int, parents: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """identifier, offset, start and end of the data of each element in a range.

    An element of unknown size ends with the range or where an element of `parents` begins.
    """
    at = start
    while at < end:
        ident, _, p = read_vint(raw, at, keep_marker=True)
        size, _, p = read_vint(raw, p)
        if size < 0:
            q = p
            while q < end:
                sub, _, r = read_vint(raw, q, keep_marker=True)
                if sub in parents:
                    break
                n, _, r = read_vint(raw, r)
                q = end if n < 0 else r + n
            size = min(q, end) - p
        if p + size > end:
            raise ValueError(f"element {ident:x} at byte {at} is longer than what holds it")
        yield ident, at, p, p + size
        at = p + size


def sizes_of_laces(raw: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The sizes of a block's frames and where the first one starts."""
    if kind == NO_LACING:
        return [end - at], at
    count, at = raw[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError(f"fixed laces don't fill the block before byte {end}")
        return [(end - at) // count] * count, at
    if kind == XIPH:
        for _ in range(count - 1):
            n = 0
            while raw[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + raw[at])
            at += 1
    elif count > 1:
        first, _, at = read_vint(raw, at)
        sizes.append(first)
        for _ in range(count - 2):
            d, width, at = read_vint(raw, at)
            sizes.append(sizes[-1] + d - ((1 << 7 * width - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"laces are longer than the block before byte {end}")
    return [*sizes, last], at


def number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def real(raw: bytes) -> float:
    return struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if raw else 0.0


def _track(raw: bytes, start: int, end: int) -> dict:
    t = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "frame_ns": 0}
    for ident, _, a, b in elements(raw, start, end):
        data = raw[a:b]
        if ident == TRACK_NUMBER:
            t["number"] = number(data)
        elif ident == TRACK_TYPE:
            t["type"] = number(data)
        elif ident == CODEC_ID:
            t["codec"] = data.rstrip(b"\0").decode()
        elif ident == DEFAULT_DURATION:
            t["frame_ns"] = number(data)
        elif ident == AUDIO:
            for sub, _, c, d in elements(raw, a, b):
                if sub == SAMPLING:
                    t["rate"] = real(raw[c:d])
                elif sub == CHANNELS:
                    t["channels"] = number(raw[c:d])
                elif sub == BIT_DEPTH:
                    t["bits"] = number(raw[c:d])
    return t


def parse(raw: bytes) -> Media:
    """All of a file: header, tracks, packets, cues and clusters."""
    kind, scale = "", 1_000_000
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[Cue] = []
    clusters: list[tuple[int, int]] = []
    top = frozenset((EBML, SEGMENT))
    inner = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES))

    def block(a: int, b: int, time: int, simple: bool, key: bool) -> None:
        track, _, p = read_vint(raw, a)
        if p + 3 > b:
            raise ValueError(f"a block is cut short at byte {a}")
        offset, flags = struct.unpack_from(">hB", raw, p)
        lacing = flags >> 1 & 3
        sizes, at = sizes_of_laces(raw, p + 3, b, lacing)
        each = tracks.get(track, {}).get("frame_ns", 0) / scale
        n = packets[-1].block + 1 if packets else 0
        for i, size in enumerate(sizes):
            packets.append(Packet(track, len(clusters) - 1, n, i, lacing, round((time + offset + i * each) * scale / 1e6), bool(flags & 0x80) if simple else key, at, size))
            at += size

    for ident, _, a, b in elements(raw, 0, len(raw), top):
        if ident == EBML:
            for sub, _, c, d in elements(raw, a, b):
                if sub == DOC_TYPE:
                    kind = raw[c:d].rstrip(b"\0").decode()
        elif ident == SEGMENT:
            for sub, at, c, d in elements(raw, a, b, inner):
                if sub == INFO:
                    for x, _, e, f in elements(raw, c, d):
                        if x == TIMESTAMP_SCALE:
                            scale = number(raw[e:f])
                elif sub == TRACKS:
                    for x, _, e, f in elements(raw, c, d):
                        if x == TRACK_ENTRY:
                            t = _track(raw, e, f)
                            tracks[t["number"]] = t
                elif sub == CLUSTER:
                    time = 0
                    clusters.append((at - a, 0))
                    for x, _, e, f in elements(raw, c, d):
                        if x == TIMESTAMP:
                            time = number(raw[e:f])
                            clusters[-1] = (at - a, time)
                        elif x == SIMPLE_BLOCK:
                            block(e, f, time, True, False)
                        elif x == BLOCK_GROUP:
                            parts = {y: (g, h) for y, _, g, h in elements(raw, e, f)}
                            if BLOCK in parts:
                                block(*parts[BLOCK], time, False, 0xFB not in parts)
                elif sub == CUES:
                    for x, _, e, f in elements(raw, c, d):
                        if x == CUE_POINT:
                            when, where = 0, []
                            for y, _, g, h in elements(raw, e, f):
                                if y == CUE_TIME:
                                    when = number(raw[g:h])
                                elif y == CUE_POSITIONS:
                                    got = {z: number(raw[i:j]) for z, _, i, j in elements(raw, g, h)}
                                    where.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, -1)))
                            cues += [Cue(when, t, p) for t, p in where]
    return Media(kind, scale, tracks, packets, cues, clusters)


def payload_of(text: bytes | None) -> bytes:
    """The bytes with blanks behind, up to a positive multiple of 192."""
    text = text or b""
    return text + b" " * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def samples(raw: bytes, media: Media, track: int = 1) -> bytes:
    """The stored bytes of one track, read through its packets' byte ranges."""
    return b"".join(raw[p.start : p.start + p.size] for p in media.packets if p.track == track)


def feature(raw: bytes, media: Media) -> str:
    """A summary of the packet table; the cues are followed to the clusters they name."""
    heads = dict(media.clusters)
    resolved = sum(heads.get(c.position) == c.time for c in media.cues)
    t = media.tracks.get(1, {})
    laced = ",".join(str(sum(p.lacing == k for p in media.packets)) for k in (NO_LACING, XIPH, FIXED, EBML_LACING))
    last = media.packets[-1] if media.packets else None
    table = zlib.crc32(repr([tuple(p) for p in media.packets]).encode())
    data = samples(raw, media)
    mean = sum(data) / len(data) if data else 0.0
    return f"{media.doc_type};{t.get('codec', '')};{t.get('rate', 0):.0f}Hz;{t.get('bits', 0)}bit;clusters={len(media.clusters)};packets={len(media.packets)};laced={laced};cues={resolved}/{len(media.cues)};end_ms={last.timestamp + FRAME_MS if last else 0};mean={mean:.6f};table={table:08x}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, n_bytes (of the text, without padding) and media, the file."""
    schema = pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 16 << 20):
                texts = batch.column(1).to_pylist()
                arrays = [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per packet of each file: track, timestamp_ms, byte range and place in its cluster and block."""
    names = ["track", "cluster", "block", "lace", "lacing", "timestamp_ms", "keyframe", "byte_start", "byte_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                found = [parse(x).packets if x else [] for x in batch.column(1).to_pylist()]
                flat = [p for ps in found for p in ps]
                if flat:
                    ids = batch.column(0).take(pa.array([i for i, ps in enumerate(found) for _ in ps], pa.int64()))
                    kinds = [pa.int32()] * 5 + [pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True))], names=[id_col, *names])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, track int, cluster int, block int, lace int, lacing int, timestamp_ms long, keyframe boolean, byte_start long, byte_size long")


def read_media(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """What reading the stored files back gives: sizes, digests and the feature of each."""
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def row(raw: bytes) -> tuple:
        media = parse(raw)
        data = samples(raw, media)
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(raw, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(keep) + 1, 16 << 20):
                rows = [row(x) for x in batch.column(len(keep) + 1).to_pylist()]
                arrays = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep) + 1)), *arrays], names=[id_col, *keep, *(n for n, _ in fields)])

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return files.select(id_col, *keep, media_col).mapInArrow(run, kinds + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
