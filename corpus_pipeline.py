"""Corpus preparation: five stages, each over all that the one before kept.

1. language: documents whose language cannot be told go (no text, no letter, or no language reaches the least score).
2. near duplicates: of each group of documents linked by shingle similarity one row stays, the one with the
   smallest doc_id; of rows that share it, one.
3. passages: words of repeated passages go from all but the document with the smallest doc_id; emptied documents go.
4. benchmark: documents that hold a benchmark item go.
5. packing: what is left is packed into training sequences.

Every stage but the last returns the columns of documents, and any others that there are, whatever their names.
Stages 2 and 4 decide on rows, whatever their doc_id: in stage 2 a row with null doc_id counts as larger than all
others, and of repeated rows one stays. Only stage 3 compares by id: rows with null doc_id pass it as they are.

Defined cases: null text has no language and goes in stage 1, as does an empty one; very long texts are read whole in
every stage; ties (rows of one group with the same doc_id) leave one of the rows; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm import op1_langid, op3_jaccard, op8_substrings, op9_decontaminate, op10_packing
from cuegrid.llm.common import join_texts, materialise, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the stage's own input."""
    label, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    known = op1_langid.with_prediction(docs, op1_langid.fit(docs), names=(label, score))
    return known.where((F.col(label) != op1_langid.UNKNOWN) & (F.col(score) >= op1_langid.LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a key, which is written with it as it would not be the same in another run over the input."""
    key = unused("row", docs.columns)
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = op3_jaccard.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("group_key"))
    several = materialise(found.join(found.where("group_key <> row_key").select("group_key").distinct(), "group_key", "left_semi"), "groups")
    rows = several.join(keyed.select(F.col(key).alias("row_key"), "doc_id"), "row_key")
    stay = rows.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("row_key")).select("row_key")
    gone = materialise(rows.join(stay, "row_key", "left_anti").select(F.col("row_key").alias(key)), "dropped")
    return join_texts(keyed, gone, key, "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_substrings.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_packing.packed(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("benchmark", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
#: Language identification and packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
ORACLES: dict[str, str] = {}
