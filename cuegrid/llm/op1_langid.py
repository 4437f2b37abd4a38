"""Language identification by a bidirectional gated recurrent network over bytes (see ``gru``).

The network labels every byte of a text; a document's score is the mean of its bytes' probabilities. It learns
from a bounded sample: of each language about PER_LABEL documents that are not held out (fewer, but LEAST_PER_LABEL,
where there are so many languages that SAMPLE_ROWS is passed), chosen by a hash, an excerpt of EXCERPT characters
from a hashed place of each. Every lang value is a label.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing could
be learned (no labelled rows); null doc_id counts as not held out, null is passed on; very long texts are read
whole, in overlapping windows; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuegrid.llm import gru
from cuegrid.llm.common import prepare, text_slices, unused

PER_LABEL, LEAST_PER_LABEL, SAMPLE_ROWS, EXCERPT = 600, 20, 50_000, 512
FOLDS = 5
#: The pipeline rejects documents whose best language has less than this.
LEAST_SCORE = 0.3
UNKNOWN = "und"


def held_out(folds: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == rest, F.lit(False))


def fit(docs: DataFrame, steps: int = 300) -> gru.Model | None:
    """Trains on the documents that are not held out; None if none has a language."""
    rows = docs.where(~held_out(FOLDS, 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    wanted = min(PER_LABEL, max(LEAST_PER_LABEL, SAMPLE_ROWS // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, wanted / r["count"]))))[F.col("lang")]
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_003))
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1
    picked = rows.where(draw < share * 1_000_003).select("lang", F.substring("text", place.cast("int"), F.lit(EXCERPT)).alias("text"), draw.alias("draw"))
    picked = picked.distinct().orderBy("draw", "lang", "text").limit(2 * wanted * len(counts)).collect()
    labels = sorted({r["lang"] for r in picked})
    if not labels:
        return None
    return gru.train([r["text"].encode() for r in picked], [labels.index(r["lang"]) for r in picked], labels, steps)


def with_prediction(docs: DataFrame, model: gru.Model | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` (default: all) of the columns of ``docs``, with the prediction and its score added under ``names``,
    which the columns must not have. Only ``text`` is an input."""
    prepare(docs.sparkSession)
    added = list(names)
    if model is None:
        return docs.select(*(keep or docs.columns), F.lit(UNKNOWN).alias(added[0]), F.lit(0.0).alias(added[1]))
    columns = docs.columns
    kept = keep or columns
    at, out = columns.index("text"), [columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            letters = np.asarray(batch.column(len(columns)))
            texts = pc.if_else(batch.column(len(columns)), batch.column(at), None)
            p = [gru.pooled(model, data, offsets) for _, data, offsets in text_slices(texts)]
            p = np.concatenate(p) if p else np.zeros((0, len(model.labels)))
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            score = np.where(letters, np.clip(p.max(1, initial=0.0), 0.0, 1.0), 0.0)
            label = labels[np.where(letters, best, len(model.labels))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), pa.array(label, pa.string()), pa.array(score)], [*kept, *added])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return docs.select(*columns, letters.alias(unused("letters", columns))).mapInArrow(run, schema)


def predict(docs: DataFrame, model: gru.Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    return with_prediction(docs.select("doc_id", held_out(FOLDS, 0).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", "text"), fit(docs))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
