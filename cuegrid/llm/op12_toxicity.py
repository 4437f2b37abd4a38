"""Toxicity of whole texts, read through a noisy channel.

``fit`` counts the characters' trigrams of all documents (``channel``), restores disguised words in the labelled
documents with them, picks the words that tell toxic documents from others, and fits a logistic regression to which of
them a document has. ``scored`` restores every whole text in the same way and scores what it then says.

Words are runs of letters and digits of the restored text, A-Z as a-z, held as 64-bit hashes. A word is picked if a
split between toxic and other documents as uneven as its own would be expected of fewer than one of all words by
chance: n * KL(k/n, share of toxic) >= log(number of words), by Chernoff's bound, for n documents with the word of which
k are toxic; of those the MOST_WORDS clearest.

Bounds: the labelled documents are a sample of SAMPLE rows of the labels at most, drawn by hash of their doc_id;
all else (trigrams, scores) covers all documents. The driver gets 28^3 counts and the picked words of the sample's
documents. Copies in the sample, equal or near, count once for each label: texts with the same least hash of five words
in a row are taken for copies, so that the words of a text that is there many times don't look telling.

Defined cases: null text counts as empty; a text without any picked word gets the score of the intercept, as an empty
one does; a null doc_id is not held out; labels without a document, or null, teach nothing; a doc_id that is labelled
twice the same counts once; without any label all scores are 0; without a toxic label or without others, all scores are the
(smoothed) share; very long texts are read whole, ties do not occur, repeated rows get equal scores, an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm import channel
from cuegrid.llm.common import materialise, prepare, signed, text_slices, window_hashes, word_hashes

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SHINGLE = 5
SAMPLE, MOST_WORDS, LEAST_DOCS, RIDGE = 20_000, 512, 3, 0.02

_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[k for k in range(128) if not chr(k).isalnum()]] = 32


@dataclass
class Model:
    """The language model, the picked words' hashes in order, their weights and the intercept (None: nothing learnt)."""

    language: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    intercept: float | None


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def language_model(docs: DataFrame) -> np.ndarray:
    """Trigram log probabilities over the whole texts of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(channel.SYMBOLS**3, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                total += channel.trigram_counts(data, offsets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    found = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(channel.SYMBOLS**3, np.int64)
    for r in found:
        counts[r["code"]] = r["n"]
    return channel.log_model(counts)


def _read(texts: pa.Array, language: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, row of each): the words of the restored texts."""
    for first, data, offsets in text_slices(texts):
        rows = np.flatnonzero(channel.disguised_rows(data, offsets))
        if len(rows):
            raw = data.tobytes()
            parts = [raw[offsets[k] : offsets[k + 1]] for k in range(len(offsets) - 1)]
            for k in rows.tolist():
                parts[k] = channel.restored(parts[k].decode(), language).encode()
            data = np.frombuffer(b"".join(parts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        h, bounds, _, _ = word_hashes(_SPACED[data], offsets, True)
        yield first, h, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def restored(docs: DataFrame, language: np.ndarray) -> DataFrame:
    """The documents' (doc_id, text), the text with its disguised words as they are read."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else channel.restored(t, language) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(run, picked.schema)


def _sampled_words(docs: DataFrame, labels: DataFrame, language: np.ndarray) -> DataFrame:
    """(sketch, toxic, words): the distinct words of the labelled documents of the sample, one of each group of copies."""
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            sketch = np.zeros(batch.num_rows, np.int64)
            for first, h, row in _read(batch.column(1), language):
                ends = np.searchsorted(row, np.arange(row[-1] + 2 if len(row) else 1))
                for k in range(len(ends) - 1):
                    words = h[ends[k] : ends[k + 1]]
                    found[first + k] = np.unique(signed(words))
                    sketch[first + k] = signed(window_hashes(words, min(SHINGLE, len(words)))).min(initial=np.iinfo(np.int64).max) if len(words) else 0
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sketch), batch.column(0), words], ["sketch", "toxic", "words"])

    made = texts.mapInArrow(run, "sketch long, toxic double, words array<long>")
    return materialise(made.groupBy("sketch", "toxic").agg(F.min("words").alias("words")), "labelled-words")


def _picked(sample: DataFrame, share: float) -> np.ndarray:
    """The hashes of the words that tell toxic documents from others, in order."""
    counted = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= LEAST_DOCS)
    counted = materialise(counted, "word-counts")
    total = counted.count()
    if not total:
        return np.zeros(0, np.int64)
    q = F.col("k") / F.col("n")
    term = lambda p, base: F.when(p > 0, p * F.log(p / base)).otherwise(0.0)
    clear = F.col("n") * (term(q, F.lit(share)) + term(1 - q, F.lit(1 - share)))
    best = counted.withColumn("clear", clear).where(F.col("clear") >= float(np.log(total))).orderBy(F.desc("clear"), "word").limit(MOST_WORDS)
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64))


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(a.shape[1], RIDGE)
    ridge[-1] = 1e-6
    base = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(a.shape[1])
    w[-1] = np.log(base / (1 - base))
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * ridge @ (w * w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        slope = a.T @ (p - y) + ridge * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), slope)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, toxic)."""
    prepare(docs.sparkSession)
    language = language_model(docs)
    sample = _sampled_words(docs, labels, language)
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    if not seen["n"]:
        return Model(language, np.zeros(0, np.int64), np.zeros(0), None)
    share = (seen["k"] + 0.5) / (seen["n"] + 1)
    words = _picked(sample, share)
    names = sample.sparkSession.createDataFrame([(int(w), k) for k, w in enumerate(words)], "word long, k int")
    had = sample.select("sketch", "toxic", F.explode("words").alias("word")).join(F.broadcast(names), "word").groupBy("sketch", "toxic").agg(F.collect_list("k").alias("had"))
    rows = sample.select("sketch", "toxic").join(had, ["sketch", "toxic"], "left").orderBy("sketch", "toxic").select("toxic", "had").toPandas()
    x = np.zeros((len(rows), len(words)))
    for k, h in enumerate(rows["had"]):
        if h is not None:
            x[k, list(h)] = 1.0
    weights, intercept = _regression(x, rows["toxic"].to_numpy())
    return Model(language, words, weights, intercept)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = np.full(batch.num_rows, model.intercept if model.intercept is not None else -np.inf)
            if len(model.words):
                for first, h, row in _read(batch.column(2), model.language):
                    h = signed(h)
                    at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                    hit = model.words[at] == h
                    pairs = np.unique(row[hit] * len(model.words) + at[hit])
                    np.add.at(logit, first + pairs // len(model.words), model.weights[pairs % len(model.words)])
            score = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            if model.intercept is None:
                score = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
