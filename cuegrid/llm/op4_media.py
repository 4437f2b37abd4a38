"""Media columns: ISO base media files that are walked, not decoded.

``store`` writes a payload as 8-bit samples of a PCM track: ``ftyp``, ``mdat`` and ``moov`` with full sample
tables (stsd, stts, stss, stsc, stsz, stco/co64). ``inspect`` walks the nested boxes of any such file, decodes
its sample tables and returns codec, duration and the byte range of every keyframe; it reads no payload.
``payload_of`` joins the sample byte ranges that ``inspect`` found. ``media_files`` gives the files themselves with
those columns, ``media_columns`` what is read back from them; both hold every keyframe's byte range.

Defined cases: null text counts as empty (64 zero bytes); a payload that is a multiple of 64 gets no padding,
an empty one gets 64 bytes; null doc_id is passed on; equal texts give equal files (no times or ids inside);
malformed boxes (size below their header or beyond the parent) and files whose samples are in movie fragments
(moof) raise ValueError; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm.common import prepare

BLOCK = 64
RATE = 8000
#: Samples (bytes) of a chunk, and of the sample groups that start with a keyframe.
CHUNK = 4096
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    """One box; sizes beyond 32 bits take the long form."""
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def _full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """The payload as an 8-bit mono PCM track; a chunk is CHUNK samples, each chunk's first sample is a sync sample."""
    n = len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    mdat = box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - n
    chunks = -(-n // CHUNK)
    at = first + CHUNK * np.arange(chunks, dtype=np.uint64)
    wide = first + n >= 1 << 32
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 or chunks == 1 else [(1, CHUNK, 1), (chunks, n % CHUNK, 1)]
    if chunks == 1:
        runs = [(1, n, 1)]
    sync = (1 + CHUNK * np.arange(chunks, dtype=np.uint64)).astype(">u4")
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    stbl = box(
        b"stbl",
        _full(b"stsd", 0, struct.pack(">I", 1), entry),
        _full(b"stts", 0, struct.pack(">III", 1, n, 1)),
        _full(b"stss", 0, struct.pack(">I", chunks), sync.tobytes()),
        _full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", 0, struct.pack(">II", 1, n)),
        _full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
    )
    mdhd = _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
    hdlr = _full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"soun"), b"\0")
    dinf = box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
    minf = box(b"minf", _full(b"smhd", 0, bytes(4)), dinf, stbl)
    tkhd = _full(b"tkhd", 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0x100, 0), _MATRIX, bytes(8))
    mvhd = _full(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, mdat, box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))))


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, containers before their children."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError(f"{end - at} bytes left at {at}: no room for a box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"no room for a long box header at {at}")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}; {end - at} bytes are left")
        here = (*path, kind)
        yield here, at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, here)
        at += size


@dataclass
class Track:
    """Sample tables of one track, decoded. ``chunks``: byte range of each chunk; ``keyframes``: of each sync sample."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: int = 0
    chunks: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    tables: dict = field(default_factory=dict)


def _need(n: int, at: int, end: int, kind: bytes) -> None:
    if at + n > end:
        raise ValueError(f"box {kind!r} at {at} is cut off: {n} bytes are needed, {end - at} are left")


def _table(data: bytes, at: int, end: int, kind: str, width: int) -> np.ndarray:
    _need(8, at, end, b"table")
    n = struct.unpack_from(">I", data, at + 4)[0]
    item = np.dtype(kind).itemsize
    if at + 8 + n * width * item > end:
        raise ValueError(f"a table of {n} entries at {at} is cut off")
    return np.frombuffer(data, kind, n * width, at + 8).astype(np.int64).reshape(n, width)


def _ranges(t: dict, codec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Samples, chunk byte ranges and keyframe byte ranges, from stsz, stsc, stco and stss."""
    fixed, count, sizes = t["stsz"]
    offsets, runs = t["stco"][:, 0], t["stsc"]
    last = np.append(runs[1:, 0] - 1, len(offsets))
    per = np.repeat(runs[:, 1], np.maximum(last - runs[:, 0] + 1, 0))[: len(offsets)]
    if per.sum() != count:
        raise ValueError(f"chunks hold {per.sum()} samples, sample sizes are {count}")
    first = np.concatenate([[0], np.cumsum(per)])
    cum = None if fixed else np.concatenate([[0], np.cumsum(sizes)])
    upto = lambda k: k * fixed if cum is None else cum[k]
    length = upto(first[1:]) - upto(first[:-1])
    keys = t["stss"][:, 0] - 1 if "stss" in t else np.arange(count)
    chunk = np.searchsorted(first, keys, "right") - 1
    start = offsets[chunk] + upto(keys) - upto(first[chunk])
    size = upto(keys + 1) - upto(keys)
    return count, np.stack([offsets, offsets + length], 1), np.stack([start, start + size], 1)


def inspect(data: bytes) -> list[Track]:
    """Every track of the file."""
    tracks: list[Track] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            raise ValueError(f"the samples of the movie fragment at {at} are not in the sample tables")
        if kind == b"trak":
            tracks.append(Track())
        if b"trak" not in path or not tracks:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            _need(1, at, end, kind)
            long = data[at] == 1
            _need(32 if long else 20, at, end, kind)
            t.timescale, t.duration = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
        elif kind == b"hdlr":
            _need(12, at, end, kind)
            t.handler = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            _need(16, at, end, kind)
            t.codec = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stsz":
            _need(12, at, end, kind)
            fixed, n = struct.unpack_from(">II", data, at + 4)
            _need(12 if fixed else 12 + 4 * n, at, end, kind)
            t.tables["stsz"] = fixed, n, None if fixed else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            t.tables["stco"] = _table(data, at, end, ">u4" if kind == b"stco" else ">u8", 1)
        elif kind in (b"stsc", b"stss", b"stts"):
            t.tables[kind.decode()] = _table(data, at, end, ">u4", {b"stsc": 3, b"stss": 1, b"stts": 2}[kind])
    for t in tracks:
        if {"stsz", "stco", "stsc"} <= t.tables.keys():
            t.samples, t.chunks, t.keyframes = _ranges(t.tables, t.codec)
    return tracks


def payload_of(data: bytes, track: Track) -> bytes:
    """The stored samples in order, by the track's chunk ranges."""
    if (track.chunks[1:, 0] == track.chunks[:-1, 1]).all() and len(track.chunks):
        return data[track.chunks[0, 0] : track.chunks[-1, 1]]
    return b"".join(data[a:b] for a, b in track.chunks)


def feature_of(track: Track) -> str:
    """Codec, duration and keyframe byte ranges, in one line; ranges as first, count and a CRC-32 of all of them."""
    keys = track.keyframes
    head = f"{keys[0, 0]}-{keys[0, 1]}" if len(keys) else "-"
    return f"{track.handler}/{track.codec.strip()} {track.duration}/{track.timescale}s samples={track.samples} chunks={len(track.chunks)} keyframes={len(keys)} first={head} ranges={zlib.crc32(keys.astype('<i8').tobytes()):08x}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


RANGES = "keyframes array<struct<start:long,end:long>>"
SCHEMA = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_keyframes long, duration_s double, {RANGES}"
FILES = f"doc_id long, media binary, handler string, codec string, duration_s double, n_samples long, {RANGES}"


def _columns(rows: list[tuple], ranges: list[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")[:-1]]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ranges])]).astype(np.int32)
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *ranges]).astype(np.int64)
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["start", "end"])
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(ends), spans)], names)


def _over_texts(docs: DataFrame, row_of, schema: str) -> DataFrame:
    """``row_of(doc_id, UTF-8 of the text, its file)`` for every row: the columns of ``schema`` but the ranges."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ranges, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = store(padded(raw))
                track = inspect(media)[0]
                rows.append(row_of(doc_id, raw, media, track))
                ranges.append(track.keyframes)
                size += len(media)
                if size > 1 << 25:
                    yield _columns(rows, ranges, schema)
                    rows, ranges, size = [], [], 0
            yield _columns(rows, ranges, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def media_files(docs: DataFrame) -> DataFrame:
    """Every text as an ISO media file: its bytes, codec, duration and the byte ranges of its keyframes."""
    return _over_texts(docs, lambda i, raw, media, t: (i, media, t.handler, t.codec, t.duration / t.timescale, t.samples), FILES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as media and returns what is read back from the stored bytes."""

    def row_of(doc_id, raw: bytes, media: bytes, track: Track) -> tuple:
        back = payload_of(media, track)
        return doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(track), len(track.keyframes), track.duration / track.timescale

    return _over_texts(docs, row_of, SCHEMA)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as an ISO media file, and what its sample tables say."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_media_columns": op4_media_columns}
ORACLES: dict[str, str] = {}
