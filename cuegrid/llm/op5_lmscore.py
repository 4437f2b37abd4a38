"""Scores of documents under a hidden Markov language model, and under add-one unigrams.

Tokens: lower-cased (A-Z) words and one end for each document. Counts of all training tokens are exact: they are
combined in each task, then by a shuffle on the word's hash.

Model. Symbols are the most frequent tokens (the end always is one), as many as the square root of the training
tokens, between LEAST_SYMBOLS and MOST_SYMBOLS, and CLASSES spelling classes for all other words. A word outside
the symbols has the probability of its class times (c + 1) / (Nc + Vc + 1) inside it, with Nc tokens and Vc
distinct words of the class in training; so unseen words have a share as well. States start from what fits the
counts of all pairs of neighbours in training, START_SYMBOLS words as themselves and all others by their spelling
class, a table of bounded size; then they are fitted ROUNDS times by Baum-Welch over whole texts of all training
documents: every task adds up its expected counts, and the sums by symbol are combined by a shuffle. No text is left
out of any of this. The score is the exact likelihood of the whole token sequence by the scaled forward recursion.

The LEXICON most frequent words and their counts are held by the executors (a bounded size). The counts of the
other words are joined by their hash; equal texts are joined once.

Defined cases: null text counts as empty and has the end token alone; null doc_id is in training and is passed
on; without any training token all counts are 0 and N and V are 0; very long texts are scored whole; repeated rows are
counted each and score alike; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm import hmm
from cuegrid.llm.common import materialise, prepare, sequence_class, signed, text_slices, word_hashes
from cuegrid.llm.op1_langid import held_out

FOLDS, REST = 7, 2
STATES, CLASSES = 8, 64
LEAST_SYMBOLS, MOST_SYMBOLS = 1024, 1 << 16
LEXICON = 1 << 19
START_SYMBOLS, START_ROUNDS, ROUNDS = 448, 30, 2
#: Without effect since the start reads all texts whole; a test of the time when it took excerpts sets it.
START_CHARS = 1 << 18
#: Tokens that run through the recursions at once.
TOKENS = 1 << 21
END = np.uint64(0x5EED0E0D)


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, token hashes with the ends, bounds, spelling classes)."""
    for at, data, offsets in text_slices(texts):
        words, bounds, starts, ends = word_hashes(data, offsets, lower=True)
        rows = len(bounds) - 1
        kind = np.zeros(0, np.int64)
        if len(words):
            kind = np.minimum((ends - starts) // 2, 7) * 8 + (data[ends - 1] & 7)
        # Row r's words move r places on, and its end follows them.
        to = np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(bounds))
        h = np.full(len(words) + rows, END, np.uint64)
        k = np.zeros(len(h), np.int64)
        h[to], k[to] = words, kind
        yield at, h, bounds + np.arange(rows + 1), k


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def combined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, k, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, k, c = h[order], k[order], c[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[cut], k[cut], np.add.reduceat(c, cut)

    size = 0
    for batch in batches:
        for _, h, _, k in tokens(batch.column(0)):
            value, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((value, k[first], n))
            size += len(value)
        if size > 4_000_000:
            held[:] = [combined()]
            if len(held[0][0]) > 2_000_000:
                yield _count_rows(*held.pop())
            size = sum(len(x[0]) for x in held)
    if held:
        yield _count_rows(*combined())


def _count_rows(h: np.ndarray, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(k.astype(np.int32)), pa.array(c.astype(np.int64))], ["h", "kind", "c"])


def vocabulary(h: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Places of the most frequent of n tokens; the end is among them."""
    top = np.lexsort((h, -c))[: min(max(math.isqrt(n), LEAST_SYMBOLS), MOST_SYMBOLS)]
    if END in h and END not in h[top]:
        top[-1] = np.flatnonzero(h == END)[0]
    return top


class Lexicon:
    """Counts of the frequent words, the symbols of the most frequent, and the sizes of the classes."""

    def __init__(self, h: np.ndarray, c: np.ndarray, kind: np.ndarray, kind_tokens: np.ndarray, kind_words: np.ndarray, n: int, v: int):
        top = vocabulary(h, c, n)
        symbol = np.full(len(h), -1, np.int32)
        symbol[top] = np.arange(len(top))
        order = np.argsort(h)
        self.h, self.c, self.symbol = h[order], c[order], symbol[order]
        self.n, self.v, self.known = n, v, len(top)
        self.logs = np.log10(self.c + 1.0)
        self.kind_logs = np.log10(kind_tokens + kind_words + 1.0)
        inside = self.symbol >= 0
        self.small, self.small_symbol = self.h[inside], self.symbol[inside]
        share = np.zeros(self.known + CLASSES)
        share[self.small_symbol] = self.c[inside]
        share[self.known :] = kind_tokens
        self.unigram = (share + 0.1) / (share + 0.1).sum()
        # Of every symbol and spelling class: its class at the start. Symbols are numbered from the most frequent on.
        self.frequent = min(START_SYMBOLS, self.known)
        self.start_class = np.concatenate([np.arange(self.frequent), self.frequent + kind[top[self.frequent :]], self.frequent + np.arange(CLASSES)])

    def symbols(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.small):
            return self.known + kind
        at = np.minimum(np.searchsorted(self.small, h), len(self.small) - 1)
        return np.where(self.small[at] == h, self.small_symbol[at], self.known + kind)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def count(self, h: np.uint64) -> int:
        place, there = self.find(np.array([h], np.uint64))
        return int(self.c[place[0]]) if there[0] else 0


def read_lexicon(counts: DataFrame, most: int = LEXICON) -> Lexicon:
    """Collects the words above the least count that at most ``most`` words reach (by a histogram of count
    classes, bounded whatever the corpus)."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sums = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens")).orderBy(F.desc("b")).collect()
    n, v = sum(r["tokens"] for r in sums), sum(r["words"] for r in sums)
    taken, least = 0, 1 << 30
    for r in sums:
        taken += r["words"]
        if taken > most:
            break
        least = r["b"]
    got = counts.where((step >= least) | (F.col("h") == int(END))).select("h", "c", "kind").toArrow()
    h, c, kind = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy(), got["kind"].to_numpy()
    top = vocabulary(h, c, n)
    kinds = counts.groupBy("kind").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()
    kind_tokens, kind_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in kinds:
        kind_tokens[r["kind"]], kind_words[r["kind"]] = r["tokens"], r["words"]
    kind_tokens -= np.bincount(kind[top], weights=c[top], minlength=CLASSES)
    kind_words -= np.bincount(kind[top], minlength=CLASSES)
    return Lexicon(h, c, kind, kind_tokens, kind_words, n, v)


def _gathered(batches: Iterator[pa.RecordBatch], column: int, symbols) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, bounds) of many rows at once."""
    parts, ends, size = [], [0], 0
    for batch in batches:
        for _, h, bounds, k in tokens(batch.column(column)):
            parts.append(symbols(h, k).astype(np.int32))
            ends.extend((bounds[1:] + size).tolist())
            size += len(h)
            if size >= TOKENS:
                yield np.concatenate(parts), np.array(ends)
                parts, ends, size = [], [0], 0
    if size:
        yield np.concatenate(parts), np.array(ends)


def neighbours(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(pair, n): how often two start classes follow each other in the texts of ``train``, as first * classes + second.
    A task sends as many rows as there are pairs of classes at most."""
    shared, classes = train.sparkSession.sparkContext.broadcast(lexicon), lexicon.frequent + CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes, np.int64)
        for s, bounds in _gathered(batches, 0, shared.value.symbols):
            kind = shared.value.start_class[s]
            follows = np.ones(len(s), bool)
            follows[bounds[:-1]] = False
            at = np.flatnonzero(follows)
            table += np.bincount(kind[at - 1] * classes + kind[at], minlength=len(table))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], ["pair", "n"])

    return train.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def start(pairs: DataFrame, lexicon: Lexicon) -> hmm.Hmm:
    """States fitted to the counts of ``neighbours``. A symbol has its share of what its start class has in a state."""
    classes = lexicon.frequent + CLASSES
    got = pairs.toArrow()
    pair, n = got["pair"].to_numpy(), got["n"].to_numpy()
    unigram = np.bincount(lexicon.start_class, weights=lexicon.unigram, minlength=classes)
    model = hmm.start(STATES, unigram)
    for _ in range(START_ROUNDS if len(n) else 0):
        counts = hmm.Counts.none(STATES, classes)
        # Pairs that occur n times: those with a bit set in n run together and count 2 ** bit times.
        for bit in range(int(n.max()).bit_length()):
            now = pair[(n >> bit) & 1 == 1]
            part = hmm.Counts.none(STATES, classes)
            hmm.expected(model, np.stack([now // classes, now % classes], 1).ravel(), 2 * np.arange(len(now) + 1), part)
            for whole, more in ((counts.first, part.first), (counts.move, part.move), (counts.emit, part.emit)):
                whole += more * 2.0**bit
        model = hmm.estimate(counts, unigram)
    share = lexicon.unigram / unigram[lexicon.start_class]
    return hmm.Hmm(model.first, model.move, model.emit[lexicon.start_class] * share[:, None])


def fit(train: DataFrame, lexicon: Lexicon) -> hmm.Hmm:
    """Baum-Welch over all rows of ``train`` (doc_id, text)."""
    spark = train.sparkSession
    width = lexicon.known + CLASSES
    model = start(neighbours(train, lexicon), lexicon)
    shared = spark.sparkContext.broadcast(lexicon)
    columns = [f"g{k}" for k in range(STATES)]
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            counts = hmm.Counts.none(STATES, width)
            for s, b in _gathered(batches, 1, shared.value.symbols):
                hmm.expected(now.value, s, b, counts)
            rows = np.concatenate([counts.emit, counts.move, counts.first[None]])
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, k]) for k in range(STATES))], ["at", *columns])

        summed = train.mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).collect()
        rows = np.zeros((width + STATES + 1, STATES))
        for r in summed:
            rows[r["at"]] = [r[c] for c in columns]
        model = hmm.estimate(hmm.Counts(rows[-1], rows[width:-1], rows[:width]), lexicon.unigram)
    return model


class Trained:
    """Counts, lexicon and model of a corpus."""

    def __init__(self, docs: DataFrame):
        prepare(docs.sparkSession)
        train = docs.where(~held_out(FOLDS, REST)).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        self.counts = materialise(train.select("text").mapInArrow(_counted, "h long, kind int, c long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c")), "counts")
        self.lexicon = read_lexicon(self.counts)
        self.model = fit(train, self.lexicon)


def score(docs: DataFrame, trained: Trained | None = None) -> DataFrame:
    """The columns of the contract for every document."""
    trained = trained or Trained(docs)
    spark, counts, lexicon, model = docs.sparkSession, trained.counts, trained.lexicon, trained.model
    rows = docs.select(F.col("doc_id").cast("long"), held_out(FOLDS, REST).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    shared, fitted = spark.sparkContext.broadcast(lexicon), spark.sparkContext.broadcast(model)

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[np.ndarray] = []
            for _, h, bounds, _ in tokens(batch.column(0)):
                text = sequence_class(h, bounds)[0]
                out = np.flatnonzero(~shared.value.find(h)[1])
                row = np.searchsorted(bounds, out, "right") - 1
                order = np.lexsort((h[out], row))
                word, row = h[out][order], row[order]
                cut = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])) if len(row) else order
                parts.append(np.stack([word[cut], text[row[cut]], np.diff(np.append(cut, len(row))).astype(np.uint64)]))
            if parts:
                counted = np.unique(np.concatenate(parts, 1), axis=1) if sum(x.shape[1] for x in parts) else np.zeros((3, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(x))) for x in counted], ["h", "text_class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, names = shared.value, ["doc_id", "held_out", "text_class", "n_tokens", "known", "logs", "model"]
        ids, flags, parts, sizes, sums = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            logs = hmm.log10_likelihood(fitted.value, np.concatenate(parts), bounds)
            a, b, c, d = (np.concatenate(x) for x in zip(*sums, strict=True))
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(flags), pa.array(signed(a)), pa.array(np.diff(bounds)), pa.array(b), pa.array(c), pa.array(logs + d)], names)
            for x in (ids, flags, parts, sizes, sums):
                x.clear()
            return out

        for batch in batches:
            for at, h, bounds, k in tokens(batch.column(2)):
                rows = len(bounds) - 1
                ids.append(batch.column(0).slice(at, rows))
                flags.append(batch.column(1).slice(at, rows))
                place, there = lex.find(h)
                logs = np.where(there, lex.logs[place], 0.0) if len(lex.h) else np.zeros(len(h))
                symbol = np.where(there, lex.symbol[place], -1) if len(lex.h) else np.full(len(h), -1)
                symbol = np.where(symbol < 0, lex.known + k, symbol)
                rare = np.where(symbol >= lex.known, logs - lex.kind_logs[k], 0.0)
                add = lambda x, bounds=bounds: np.add.reduceat(x, bounds[:-1])
                sums.append((sequence_class(h, bounds)[0], add(there.astype(np.int64)), add(logs), add(rare)))
                parts.append(symbol)
                sizes.append(np.diff(bounds))
            if sum(map(len, parts)) >= TOKENS:
                yield flush()
        if parts:
            yield flush()

    tails = spark.createDataFrame([], "h long, text_class long, n long") if lexicon.v == 0 else rows.select("text").mapInArrow(tail, "h long, text_class long, n long")
    per_text = tails.groupBy("text_class", "h").agg(F.max("n").alias("n"))  # once for all copies of a text; no word is a key alone
    rest = per_text.join(counts.select("h", "c"), "h").groupBy("text_class").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_logs"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, text_class long, n_tokens long, known long, logs double, model double")
    total = math.log10(lexicon.n + lexicon.v + 1)
    tail_logs, known = F.coalesce("tail_logs", F.lit(0.0)), F.col("known") + F.coalesce("tail_known", F.lit(0))
    return scored.join(rest, "text_class", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(lexicon.n).cast("long").alias("train_tokens"), (F.col("logs") + tail_logs - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("model") + tail_logs).alias("score")
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learning from those that are not held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLES: dict[str, str] = {}
