"""A data source that reads WAV files by byte ranges, so that a file of any length is many tasks, and windowed RMS over
the pieces.

The driver lists files and their sizes only; each task reads a file's header for itself and then its own samples. A
sample belongs to the piece in which its first byte lies. Files that are not 16-bit mono PCM, or not WAV at all, give
one row with an error, and no samples. Paths are whatever Arrow's file systems open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuegrid.sources.named_files import open_fs

SCHEMA = "path string, rate int, n_samples long, first long, pcm binary, error string"
PIECE_BYTES = 8 << 20
#: Bytes of samples in a row.
ROW_BYTES = 1 << 20


@dataclass
class Piece(InputPartition):
    """The bytes [begin, end) of a file."""

    path: str
    begin: int
    end: int


def sample_range(f: pa.NativeFile, size: int) -> tuple[int, int, int]:
    """(rate, first byte, number of samples) of a WAV file's data."""
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= size:
        f.seek(at)
        kind, length = struct.unpack("<4sI", f.read(8))
        at += 8
        if kind == b"fmt ":
            body = f.read(16)
            if len(body) < 16:
                raise ValueError("its format is cut off")
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body)
            if code not in (1, 0xFFFE) or channels != 1 or bits != 16:
                raise ValueError(f"not 16-bit mono PCM: format {code}, {channels} channels, {bits} bits")
        elif kind == b"data":
            if rate is None:
                raise ValueError("no format before the data")
            # A recorder that does not know the length writes 0 or the largest number.
            known = length if 0 < length < 0xFFFFFFFF else size - at
            return rate, at, min(known, size - at) // 2
        at += length + length % 2
    raise ValueError("no data")


class WavReader(DataSourceReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def partitions(self) -> list[Piece]:
        fs, path = open_fs(self.path)
        info = fs.get_file_info(path)
        found = fs.get_file_info(arrow_fs.FileSelector(path, recursive=True)) if info.type == arrow_fs.FileType.Directory else [info]
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        files = sorted((prefix + x.path, x.size) for x in found if x.type == arrow_fs.FileType.File and x.path.lower().endswith(".wav"))
        return [Piece(p, k, min(k + self.piece, max(n, 1))) for p, n in files for k in range(0, max(n, 1), self.piece)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("n_samples", pa.int64()), ("first", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())])
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(x, schema, strict=True)], schema=schema)
        fs, path = open_fs(partition.path)
        with fs.open_input_file(path) as f:
            try:
                rate, data, n = sample_range(f, f.size())
            except (ValueError, struct.error) as e:
                if partition.begin == 0:
                    yield row(partition.path, None, None, None, None, str(e))
                return
            begin, end = (min(max(-(-(x - data) // 2), 0), n) for x in (partition.begin, partition.end))
            if partition.begin == 0 and n == 0:
                yield row(partition.path, rate, 0, 0, b"", None)
            for k in range(begin, end, ROW_BYTES // 2):
                f.seek(data + 2 * k)
                yield row(partition.path, rate, n, k, f.read(2 * min(ROW_BYTES // 2, end - k)), None)


class WavFiles(DataSource):
    """``wav_pieces``: option path (a file or a folder) and bytes of a piece."""

    @classmethod
    def name(cls) -> str:
        return "wav_pieces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("bytes", PIECE_BYTES)))


def read_wav(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, rate, n_samples, first, pcm, error): pieces of all WAV files of a folder, ``first`` the number of a
    piece's first sample and n_samples those of its file."""
    spark.dataSource.register(WavFiles)
    return spark.read.format("wav_pieces").option("path", path).option("bytes", piece_bytes).load()


def energies(pieces: DataFrame, bins: int) -> DataFrame:
    """(path, n_samples, bin, energy, n): partial sums of squared samples by window; a file has ``bins`` windows of
    max(1, n div bins) samples, what is left over belongs to none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, totals, firsts, pcm = (batch.column(k) for k in range(4))
            out: list[tuple] = []
            for p, total, first, b in zip(paths.to_pylist(), totals.to_pylist(), firsts.to_pylist(), pcm, strict=True):
                x = np.frombuffer(b.as_buffer(), "<i2").astype(np.int64)
                width = max(1, total // bins)
                at = (first + np.arange(len(x))) // width
                x, at = x[at < bins], at[at < bins]
                if len(x):
                    begin = np.flatnonzero(np.diff(at, prepend=-1))
                    out += zip([p] * len(begin), [total] * len(begin), at[begin].tolist(), np.add.reduceat(x * x, begin).tolist(), np.diff(begin, append=len(x)).tolist(), strict=True)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["path", "n_samples", "bin", "energy", "n"])

    return pieces.where("error IS NULL").select("path", "n_samples", "first", "pcm").mapInArrow(run, "path string, n_samples long, bin long, energy long, n long")


def windowed_rms(pieces: DataFrame, bins: int) -> DataFrame:
    """(path, bin, rms): root mean square of each window of samples / 32768, exact sums of whole numbers before the
    root; windows that a short file lacks, or has only a part of, are 0."""
    width = F.greatest(F.floor(F.col("n_samples") / bins), F.lit(1))
    summed = energies(pieces, bins).groupBy("path", "n_samples", "bin").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))
    rms = summed.select("path", "bin", F.when(F.col("n") == width, F.sqrt(F.col("energy") / width) / 32768).otherwise(0.0).alias("rms"))
    every = pieces.where("error IS NULL").select("path").distinct().select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(rms, ["path", "bin"], "left").select("path", "bin", F.coalesce("rms", F.lit(0.0)).alias("rms"))


def envelopes(pieces: DataFrame, bins: int) -> DataFrame:
    """(path, bin, level, raw_peak): windowed RMS over its largest value (as is where that is 0)."""
    peak = F.max("rms").over(W.partitionBy("path"))
    return windowed_rms(pieces, bins).withColumn("raw_peak", peak).select("path", "bin", F.when(F.col("raw_peak") > 0, F.col("rms") / F.col("raw_peak")).otherwise(F.col("rms")).alias("level"), "raw_peak")


def _le(value, n: int):
    """The hexadecimal digits of a whole number's n lowest bytes, the lowest first."""
    return F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(n)))


def wav_parts(samples: DataFrame, name: str, part: str, values: str, rate: int = 16_000) -> DataFrame:
    """(name, part, content) for ``named_files.write_files``: WAV files from rows of whole-number samples (array), in
    order of ``part``, after a header for all of a file's samples."""
    pcm = F.unhex(F.array_join(F.transform(values, lambda v: _le(v, 2)), ""))
    body = samples.select(name, F.col(part).cast("long").alias("part"), pcm.alias("content"))
    size = samples.groupBy(name).agg((F.sum(F.size(values)) * 2).alias("n"), F.min(F.col(part).cast("long")).alias("least"))
    four, two = (lambda v: _le(F.lit(v) if isinstance(v, int) else v, 4)), (lambda v: _le(F.lit(v), 2))
    text = lambda t: F.lit(t.encode().hex())
    head = F.concat(text("RIFF"), four(F.col("n") + 36), text("WAVEfmt "), four(16), two(1), two(1), four(rate), four(2 * rate), two(2), two(16), text("data"), four(F.col("n")))
    return size.select(name, (F.col("least") - 1).alias("part"), F.unhex(head).alias("content")).unionByName(body)
