"""The start of the language model's states reads all training texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cuegrid.llm import hmm, op5_lmscore


def test_all_neighbours_in_training_enter_the_start_of_the_states(spark, monkeypatch):
    monkeypatch.setattr(op5_lmscore, "LEAST_SYMBOLS", 30)
    monkeypatch.setattr(op5_lmscore, "START_SYMBOLS", 12)
    r = random.Random(3)
    texts = ["", "one", *(" ".join(f"W{r.randrange(60)}" for _ in range(r.randrange(12))) for _ in range(2000)), " ".join(f"W{r.randrange(60)}" for _ in range(9000))]
    # Far more texts than the 400 that an earlier start was fitted to.
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trained = op5_lmscore.Trained(docs)
    lexicon = trained.lexicon
    width = lexicon.frequent + op5_lmscore.CLASSES
    want = Counter()
    for (text,) in docs.where(~op5_lmscore.held_out(op5_lmscore.FOLDS, op5_lmscore.REST)).select("text").collect():
        ((_, h, _, kind),) = op5_lmscore.tokens(pa.array([text], pa.string()))
        k = [s if s < lexicon.frequent else lexicon.frequent + c for s, c in zip(lexicon.symbols(h, kind).tolist(), kind.tolist(), strict=True)]
        want.update(a * width + b for a, b in zip(k, k[1:], strict=False))
    pairs = op5_lmscore.neighbours(docs.where(~op5_lmscore.held_out(op5_lmscore.FOLDS, op5_lmscore.REST)), lexicon)
    assert lexicon.frequent == 12 and {x.pair: x.n for x in pairs.collect()} == dict(want) and max(want.values()) > 1

    seen = hmm.Counts.none(op5_lmscore.STATES, width)
    monkeypatch.setattr(op5_lmscore, "START_ROUNDS", 1)
    monkeypatch.setattr(hmm, "estimate", lambda counts, unigram, plain=hmm.estimate: seen.__setattr__("emit", counts.emit) or plain(counts, unigram))
    m = op5_lmscore.start(pairs, lexicon)
    # Each pair counts as often as it occurs, and every symbol keeps a share.
    ends = np.zeros(width)
    for x, n in want.items():
        ends[x // width] += n
        ends[x % width] += n
    assert np.allclose(seen.emit.sum(1), ends, rtol=1e-4) and np.allclose(m.emit.sum(0), 1) and m.emit.min() > 0 and len(m.emit) == lexicon.known + op5_lmscore.CLASSES


def test_start_of_the_states_without_neighbours(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert all(r.n_tokens == 1 and r.score <= 0 for r in op5_lmscore.score(docs).collect())
    none = spark.createDataFrame([], "doc_id long, text string").select(F.col("doc_id"), "text")
    assert op5_lmscore.score(none).count() == 0
