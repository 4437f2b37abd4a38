"""Removal of repeated passages: level-wise doubling of repeated windows.

A window is WINDOW consecutive words of one document. Each word goes that is covered by a window whose words
also start a window in a document with a smaller doc_id. All windows are judged on the input.

Documents with the same words form a class; its smallest doc_id owns it. The owner is examined; of the others
every window stands in the owner, so all their words go (if they have WINDOW words at all).

1. Length BASE: in every run of windows of that length inside a WINDOW the one with the least hash is a seed,
   which depends on the run's words alone: two equal WINDOWs have equal seeds at equal places. Seeds that stand
   in one class alone go.
2. Length 2 * BASE: each seed is extended to the left and to the right. In any WINDOW around a seed one of the
   two fits. Extensions that stand in one class alone go.
3. Length WINDOW: the windows around what is left, with 128-bit hashes. For each the smallest doc_id is found.

No step holds pairs of documents. Counts by window are combined before the shuffle; a window that very many
documents share is joined back by a join whose hot partitions Spark splits. Equal seeds of one document with equal
extensions are one row with their places, so a text that repeats itself is not a hot key.

Defined cases: null text counts as no words; a document of fewer than WINDOW words is left as it is; rows with
null doc_id lose nothing and remove nothing, as no comparison with them holds; rows that repeat a doc_id are
compared with smaller ids alone; very long texts are read whole; other columns pass through, whatever their names,
as only doc_id and text are read. Words are compared by hash; 64 bits pick candidates, 128 bits decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm.common import Seen, discard, join_texts, materialise, prepare, sequence_class, signed, sliding, text_slices, unused, whole_windows, window_hashes, word_hashes

WINDOW, BASE = 50, 13
assert 3 * BASE <= WINDOW + 1


def _slices(texts: pa.Array):
    for at, data, offsets in text_slices(texts):
        words, bounds, starts, ends = word_hashes(data, offsets, lower=False)
        yield at, data, words, bounds, starts, ends


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, words, bounds, _, _ in _slices(batch.column(1)):
            a, b = sequence_class(words, bounds)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(signed(a)), pa.array(signed(b)), pa.array(n)], ["doc_id", "c1", "c2", "n_words"])


def seeds_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First words of all seeds (every WINDOW inside a row has one in the same place relative to its words)."""
    run = WINDOW - BASE + 1
    short = window_hashes(words, BASE)
    if len(short) < run:
        return np.zeros(0, np.int64)
    least = sliding(short, run, np.minimum)
    _, inside = whole_windows(bounds, WINDOW)
    # A seed equals the largest of the minima of the runs that hold it; runs across rows count as 0.
    valid = np.zeros(len(least) + 2 * (run - 1), np.uint64)
    valid[inside + run - 1] = least[inside]
    return np.flatnonzero(sliding(valid, run, np.maximum)[: len(short)] == short)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of the classes that the task has not met yet; equal ones of a class are one row with all places."""
    seen = Seen()
    for batch in batches:
        for _, _, words, bounds, _, _ in _slices(batch.column(0)):
            at = seeds_of(words, bounds)
            if not len(at):
                continue
            a, _ = sequence_class(words, bounds)
            row = np.searchsorted(bounds, at, "right") - 1
            first = seen.new(a)[row]
            at, row = at[first], row[first]
            short, double = window_hashes(words, BASE), window_hashes(words, 2 * BASE, 1)
            left, right = at - BASE >= bounds[row], at + 2 * BASE <= bounds[row + 1]
            pick = lambda ok, p: np.where(ok, double[np.clip(p, 0, len(double) - 1)], 0)  # noqa: E731, B023
            keys = np.stack([pick(right, at), pick(left, at - BASE), right, left, short[at], row.astype(np.uint64)])
            order = np.lexsort(np.concatenate([at[None].astype(np.uint64), keys]))
            keys, at, row, left, right = keys[:, order], at[order], row[order], left[order], right[order]
            cut = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            places = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), pa.array((at - bounds[row]).astype(np.int32)))
            column = lambda x, ok=None: pa.array(signed(x[cut]), mask=None if ok is None else ~ok[cut])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([column(keys[4]), column(keys[1], left), column(keys[0], right), column(a[row]), places], ["seed", "left", "right", "c1", "places"])


def _starts(codes: list[int], n: int) -> np.ndarray:
    """Starts of the windows that surviving seeds allow. A code is twice the seed's place, plus 1 for its right
    extension."""
    mark = np.zeros(n + 2, np.int32)
    codes = np.asarray(codes, np.int64)
    at, right = codes >> 1, (codes & 1).astype(bool)
    low = np.where(right, at - (WINDOW - 2 * BASE), at - (WINDOW - BASE))
    high = np.where(right, at, at - BASE)
    top = n - WINDOW
    low, high = np.clip(low, 0, top + 1), np.clip(high, -1, top)
    keep = low <= high
    np.add.at(mark, low[keep], 1)
    np.add.at(mark, high[keep] + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(top + 1, 0)] > 0)


def _long_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, known, codes = batch.column(0), batch.column(2).to_pylist(), batch.column(3)
        for first, _, words, bounds, _, _ in _slices(batch.column(1)):
            a, _ = sequence_class(words, bounds)
            a = signed(a)
            picked = []
            for k in range(len(bounds) - 1):
                if a[k] == known[first + k]:
                    s = _starts(codes[first + k].values.to_numpy(), int(bounds[k + 1] - bounds[k]))
                    picked.append((np.full(len(s), k), s))
            if not picked:
                continue
            row, s = (np.concatenate(x) for x in zip(*picked, strict=True))
            if not len(row):
                continue
            at = bounds[row] + s
            w1, w2 = (signed(window_hashes(words, WINDOW, salt)[at]) for salt in (2, 3))
            order = np.lexsort((s, w2, w1, row))
            w1, w2, row, s = w1[order], w2[order], row[order], s[order]
            cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            places = pa.ListArray.from_arrays(pa.array(np.append(cut, len(s)).astype(np.int32)), pa.array(s.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(w1[cut]), pa.array(w2[cut]), ids.take(pa.array(first + row[cut])), pa.array(a[row[cut]]), places], ["w1", "w2", "doc_id", "c1", "places"])


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, cuts) of the documents that lose words; a cut is (class, starts of removed windows), where no
    starts means all words."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    classes = materialise(rows.mapInArrow(_classes, "doc_id long, c1 long, c2 long, n_words long").where(F.col("n_words") >= WINDOW), "classes")
    owners = classes.groupBy("c1", "c2").agg(F.min("doc_id").alias("owner"))

    seeds = rows.select("text").where(F.length("text") >= 2 * WINDOW - 1).mapInArrow(_seeds, "seed long, left long, right long, c1 long, places array<int>")
    seeds = materialise(seeds, "seeds")
    shared = lambda df, key: df.groupBy(key).agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a < b").select(key)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("double")), F.struct(F.lit(1).alias("side"), F.col("right").alias("double")))
    extended = seeds.join(shared(seeds, "seed"), "seed", "left_semi").select("c1", "places", F.inline(sides)).where("double IS NOT NULL")
    extended = materialise(extended, "extended")
    discard(seeds)
    left = extended.join(shared(extended, "double"), "double", "left_semi").distinct()
    left = left.groupBy("c1").agg(F.collect_list(F.transform("places", lambda p: p * 2 + F.col("side"))).alias("codes"))
    left = left.select("c1", F.array_distinct(F.flatten("codes")).alias("codes"))
    candidates = materialise(owners.where("owner IS NOT NULL").join(left, "c1").select(F.col("owner").alias("doc_id"), "c1", "codes"), "candidates")
    long = join_texts(rows, candidates, "doc_id", "inner").select("doc_id", "text", "c1", "codes").mapInArrow(_long_windows, "w1 long, w2 long, doc_id long, c1 long, places array<int>")
    smallest = long.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("w1", "w2", "a")
    cut = long.join(smallest, ["w1", "w2"]).where("doc_id > a").groupBy("doc_id", "c1").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    copies = classes.join(owners, ["c1", "c2"]).where("doc_id > owner").select("doc_id", "c1").distinct().withColumn("places", F.expr("CAST(NULL AS ARRAY<INT>)"))
    return materialise(cut.unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("c1", "places")).alias("cuts")), "removals")


def kept_mask(n: int, own: int, cuts: list | None) -> np.ndarray:
    """True for the words that stay in a document of class ``own``."""
    for cut in cuts or ():
        if cut["c1"] == own:
            if cut["places"] is None:
                return np.zeros(n, bool)
            mark = np.zeros(n + 1, np.int32)
            at = np.asarray(cut["places"], np.int64)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + WINDOW, -1)
            return np.cumsum(mark[:n]) == 0
    return np.ones(n, bool)


def _kept(batch: pa.RecordBatch, text: int, cuts: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, words, removed words, kept words joined by one space)."""
    listed = batch.column(cuts)
    some = np.asarray(listed.is_valid())
    for first, data, words, bounds, starts, ends in _slices(batch.column(text)):
        own = signed(sequence_class(words, bounds)[0])
        raw = data.tobytes()
        for k in range(len(bounds) - 1):
            a, z = int(bounds[k]), int(bounds[k + 1])
            if not some[first + k]:
                if a < z:
                    yield first + k, z - a, 0, b" ".join(raw[starts[a] : ends[z - 1]].split())
                else:
                    yield first + k, 0, 0, b""
                continue
            mask = kept_mask(z - a, int(own[k]), listed[first + k].as_py())
            at = a + np.flatnonzero(mask)
            yield first + k, z - a, int((~mask).sum()), b" ".join([raw[starts[p] : ends[p]] for p in at])


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` (columns of documents) with the words removed; a document that lost words has the kept words
    joined by one space as its text, one that lost all is dropped."""
    columns = docs.columns
    cuts = unused("cuts", columns)
    gone = removals(docs).withColumnRenamed("cuts", cuts)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(columns.index("text")).to_pylist(), np.ones(batch.num_rows, bool)
            for k, n, removed, kept in _kept(batch, columns.index("text"), len(columns)):
                if removed:
                    texts[k] = kept.decode()
                    keep[k] = removed < n
            out = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(columns)]
            if "n_chars" in columns:
                at = columns.index("n_chars")
                out[at] = pa.array([None if t is None else len(t) for t in texts], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(out, columns).filter(pa.array(keep))

    return join_texts(docs, gone, "doc_id", "left").select(*columns, cuts).mapInArrow(run, schema)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digest(docs: DataFrame) -> DataFrame:
    """What the removal leaves of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, removed, hashlib.sha256(kept).hexdigest()) for _, n, removed, kept in _kept(batch, 1, 2)]
            n, removed, sha = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return join_texts(rows, removals(docs), "doc_id", "left").select("doc_id", "text", "cuts").mapInArrow(run, SCHEMA)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS a FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM h JOIN m USING (k) WHERE doc_id > a),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
}
