"""Batch transcription: manifests as a stream of files, each new one a batch, idempotent by what the media hold.

A batch decides for every medium of its manifests (``sinks.skip_decision``): one with all three outputs and a cached
transcript of the same backend and source hash is skipped, one whose source has changed is made again over the old
outputs, any other is made if its outputs don't exist. The recogniser runs in tasks; what it returns, or the error it
raised, is written to the batch's ledger before anything else is made of it, so a batch that is run again after a crash
only makes its files anew once that is written. Outputs are one file a medium (``named_files``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuegrid.functions import text as X
from cuegrid.operators import folds
from cuegrid.sources import named_files, readers, sinks

ENDINGS = (".txt", ".srt", ".json")
LEDGER = "batch long, media string, path string, backend string, source_hash string, decision string, transcript string, error string"


def source_hash(path: str) -> str:
    """SHA-256 of a file's bytes, read piece by piece."""
    fs, at = named_files.open_fs(path)
    h = hashlib.sha256()
    with fs.open_input_stream(at) as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def _hashed(media: DataFrame) -> DataFrame:
    """Adds source_hash, or error where a medium can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m, p in zip(pdf["media"], pdf["path"], strict=True):
                try:
                    rows.append((m, p, source_hash(p), None))
                except OSError as e:
                    rows.append((m, p, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["media", "path", "source_hash", "error"])

    return media.select("media", "path").mapInPandas(run, "media string, path string, source_hash string, error string")


def _recognised(todo: DataFrame, recognise: Callable[[str], dict]) -> DataFrame:
    """Adds transcript (JSON, with backend and source_hash), or error where the recogniser raised one."""
    columns = ["media", "path", "backend", "source_hash", "decision", "error"]

    kinds = pa.schema([(c, pa.string()) for c in ("media", "path", "backend", "source_hash", "decision", "transcript", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in folds.row_parts(batches):  # a transcript may be large
            rows = []
            for r in part.to_pylist():
                r["transcript"] = None
                if r["decision"] in ("process", "overwrite") and r["error"] is None:
                    try:
                        r["transcript"] = json.dumps(recognise(r["path"]) | {"backend": r["backend"], "source_hash": r["source_hash"]}, ensure_ascii=False)
                    except Exception as problem:  # the row says so
                        r["error"] = f"{type(problem).__name__}: {problem}"[:500]
                rows.append(r)
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return todo.select(*columns).mapInArrow(run, LEDGER.removeprefix("batch long, "))


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """What all batches did: (batch, media, path, backend, source_hash, decision, transcript, error)."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{output}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def existing_outputs(media: DataFrame, folder: str) -> DataFrame:
    """(media, output) of those outputs of the media that are there. Tasks look them up by name: a listing of the folder
    would pass through the driver, with all that earlier batches made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = named_files.open_fs(folder)
        for pdf in batches:
            wanted = [(m, ending) for m in pdf["media"] for ending in ENDINGS]
            found = fs.get_file_info([f"{at}/{m}{ending}" for m, ending in wanted])
            yield pd.DataFrame([w for w, f in zip(wanted, found, strict=True) if f.is_file], columns=["media", "output"])

    return media.select("media").mapInPandas(run, "media string, output string")


def documents(transcripts: DataFrame) -> DataFrame:
    """(media, name, document): the three files of every transcript (media, transcript)."""
    read = readers.parse_transcripts(transcripts.select("media", F.col("transcript").alias("value")))
    made = folds.captions(readers.transcript_segments(read), ("media", "segment"))
    cues = made.select("media", F.row_number().over(W.partitionBy("media").orderBy("segment", "block")).alias("cue"), "start_ms", "end_ms", "text", "speaker")
    named = lambda df, ending: df.select("media", F.concat("media", F.lit(ending)).alias("name"), F.coalesce("document", F.lit("")).alias("document"))
    # Whole documents must not be broadcast, whatever size is guessed for what is made of the ledger's packed texts.
    of = lambda df, ending: named(transcripts.select("media").join(df.hint("merge"), "media", "left"), ending)
    return of(sinks.txt_documents(cues), ".txt").unionByName(of(sinks.srt_documents(cues, speaker="speaker"), ".srt")).unionByName(named(transcripts.select("media", F.col("transcript").alias("document")), ".json"))


def one_batch(manifests: DataFrame, batch: int, output: str, recognise: Callable[[str], dict], backend: str, skip_existing: bool = True, overwrite: bool = False) -> DataFrame:
    """Transcribes the media of manifests (manifest, line_no, line) into {output}/files and returns the batch's part of
    the ledger. Media are named by their stems; of two inputs with one stem the first path counts, the other is an
    error, as they would share their outputs."""
    spark = manifests.sparkSession
    at = f"{output}/ledger/batch={batch}"
    if not _there(spark, at):
        done = _decided_and_recognised(manifests, batch, output, recognise, backend, skip_existing, overwrite)
        done.select(F.lit(batch).cast("long").alias("batch"), "*").write.mode("overwrite").parquet(at)
    mine = spark.read.schema(LEDGER).parquet(at)
    made = mine.where("transcript IS NOT NULL").select("media", "transcript")
    named_files.write_files(documents(made), f"{output}/files", exists="replace")
    return mine


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written and committed."""
    try:
        return bool(spark.read.schema(LEDGER).parquet(path).limit(1).count())
    except AnalysisException:
        return False


def _decided_and_recognised(manifests: DataFrame, batch: int, output: str, recognise: Callable[[str], dict], backend: str, skip_existing: bool, overwrite: bool) -> DataFrame:
    spark = manifests.sparkSession
    paths = readers.manifest_inputs(manifests).select(X.stem(F.col("path")).alias("media"), "path").distinct()
    place = F.row_number().over(W.partitionBy("media").orderBy("path"))
    given = paths.withColumn("_k", place)
    hashed = _hashed(given.where("_k = 1")).withColumn("backend", F.lit(backend))
    before = ledger(spark, output).where(F.col("error").isNull() & F.col("transcript").isNotNull() & (F.col("batch") < batch))
    cached = before.groupBy("media").agg(F.max_by(F.struct("backend", "source_hash"), "batch").alias("c")).select("media", "c.backend", "c.source_hash").hint("merge")
    there = existing_outputs(given.where("_k = 1"), f"{output}/files").hint("merge")
    if skip_existing:
        # Some outputs without all of them are refused like any that exist.
        decided = sinks.skip_decision(hashed, there, cached, some="overwrite" if overwrite else "fail")
    else:
        decided = sinks.output_decision(hashed, there.select("media").distinct(), key="media", overwrite=overwrite)
    decided = decided.withColumn("error", F.coalesce("error", F.when(F.col("decision") == "fail", "its outputs exist")))
    twice = given.where("_k > 1").select("media", "path", F.lit(backend).alias("backend"), F.lit(None).cast("string").alias("source_hash"), F.lit("fail").alias("decision"), F.lit("another input has the same stem").alias("error"))
    return _recognised(decided.select(*twice.columns).unionByName(twice).repartition("path"), recognise)


def transcribe(spark: SparkSession, manifests: str, output: str, recognise: Callable[[str], dict], backend: str, **options: bool) -> StreamingQuery:
    """Runs over all manifests (a folder of text files) that its checkpoint has not seen, and stops."""
    lines = spark.readStream.text(manifests, wholetext=True).select(F.col("_metadata.file_path").alias("manifest"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    run = lambda df, batch: one_batch(df, batch, output, recognise, backend, **options)

    def each(df: DataFrame, batch: int) -> None:
        run(df, batch)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()


def result(spark: SparkSession, output: str) -> DataFrame:
    """(batch, n_ok, n_failed, exit_code): 1 where an item of the batch failed."""
    return sinks.batch_result(ledger(spark, output), by=("batch",))
