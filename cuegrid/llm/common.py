"""Session helpers and the vectorised text kernel that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own_dir: str | None = None

#: Rows in an Arrow batch. Texts are long, so the default of 10,000 would hold hundreds of MB.
ARROW_ROWS = 512
#: Bytes of text that the kernel hashes at once; bounds its memory whatever the batch holds.
SLICE_BYTES = 1 << 19


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and workers that can import this package where the driver runs from a checkout."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset and all runs on this machine,
    as in tests, a temporary one; on a cluster that is an error."""
    global _own_dir
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="cuegrid-shared-")
    return f"file://{_own_dir}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/cuegrid/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*written: DataFrame) -> None:
    """Deletes tables of ``materialise`` that no later step reads."""
    for df in written:
        remove(df.sparkSession, df.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --- words and their hashes, without a Python object for each word -------------------------------------------

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLD))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = (np.full(size, x, np.uint64) for x in (_BASE, inverse))
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of whole rows; null counts as empty. A slice has
    SLICE_BYTES at most, or one longer row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of every row, where each row's words start, and each
    word's first and end byte. ``lower``: A-Z count as a-z."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    ink = ~_WS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(_GOLD))
    return h, np.searchsorted(starts, offsets), starts, ends


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (all rows in one sequence: callers drop runs that cross
    a row's end)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (_BASE * (2 * salt + 1)) & _M64
    up, down = (np.full(len(words) + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix64(words + np.uint64((salt * _GOLD) & _M64)) * up[:-1], out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size))


def whole_windows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of every run of ``size`` words that lies inside one row."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return row, start


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """min or max over each run of ``size`` values, by doubling."""
    if len(x) < size:
        return x[:0]
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def sequence_class(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's word sequence."""
    return tuple(row_sums(mix64(words + np.uint64(s)) * _places(words, bounds, s), bounds) for s in (11, 23))


def _places(words: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    at = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    return mix64(at * np.uint64(_GOLD) + np.uint64(salt)) | np.uint64(1)


def row_sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of each row's values, mixed with their count."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return mix64(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(_GOLD))


def unused(name: str, taken: list[str]) -> str:
    """A column name that is not taken, upper or lower case."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name += "_"
    return name


#: Bits of the filter that keeps texts out of shuffles; its broadcast has FILTER_BITS / 64 rows at most.
FILTER_BITS = 1 << 24


def join_texts(docs: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """``docs`` joined (inner, left or left_anti) with a written table on ``key``, so that only texts that may
    have a partner are shuffled: a bit set over the hashes of the side's keys, of a fixed size, is broadcast
    first. A key that is not in it has no partner; the others meet in a shuffled join. The plan is the same for
    any size of the side; a side of very many keys only lets more texts through."""
    from pyspark.sql import functions as F

    word, bits = unused("word", docs.columns), unused("bits", docs.columns)
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    place = F.floor(at / 64)
    filled = side.select(place.alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    marked = docs.withColumn(word, place).join(F.broadcast(filled), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit), F.lit(0)) != 0
    met = marked.where(hit).select(*docs.columns).join(side.hint("merge"), key, how)
    if how == "inner":
        return met
    alone = marked.where(~hit).select(*docs.columns)
    if how == "left":
        alone = alone.select(*docs.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name != key))
    return met.select(*alone.columns).unionAll(alone)


class Seen:
    """Which values a task has met, up to ``most`` of them at once; forgetting only costs repeated work."""

    def __init__(self, most: int = 1_000_000):
        self.values: set[int] = set()
        self.most = most

    def new(self, values: np.ndarray) -> np.ndarray:
        """True for the first occurrence of each value."""
        out = np.zeros(len(values), bool)
        for k, v in enumerate(values.tolist()):
            if v not in self.values:
                self.values.add(v)
                out[k] = True
        if len(self.values) > self.most:
            self.values.clear()
        return out
