"""Sinks: transcripts, SRT, packed Markdown, translation templates, concat manifests, and guards for what exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.sources import named_files


def _joined(order: str, line: Column, between: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"]), between)


def _tagged(text: Column, speaker: str) -> Column:
    return F.concat(F.when(F.col(speaker).isNotNull(), F.concat(F.lit("["), F.col(speaker), F.lit("] "))).otherwise(""), text)


def txt_documents(cues: DataFrame, media: str = "media", order: str = "cue", speaker: str = "speaker") -> DataFrame:
    """(media, document): a line [start --> end] text for each cue, with a line feed at the end."""
    line = F.concat(F.lit("["), X.timecode(F.col("start_ms")), F.lit(" --> "), X.timecode(F.col("end_ms")), F.lit("] "), _tagged(F.col("text"), speaker))
    return cues.groupBy(media).agg(F.concat(_joined(order, line, "\n"), F.lit("\n")).alias("document"))


def srt_documents(cues: DataFrame, media: str = "media", order: tuple[str, ...] = ("cue",), speaker: str | None = None) -> DataFrame:
    """(media, document): cues numbered from 1 in their order."""
    body = _tagged(F.col("text"), speaker) if speaker else F.col("text")
    one = F.struct(F.struct(*order).alias("at"), F.concat(X.srt_time(F.col("start_ms")), F.lit(" --> "), X.srt_time(F.col("end_ms")), F.lit("\n"), body).alias("cue"))
    packed = cues.groupBy(media).agg(F.sort_array(F.collect_list(one)).alias("c"))
    numbered = F.transform("c", lambda x, k: F.concat((k + 1).cast("string"), F.lit("\n"), x["cue"], F.lit("\n")))
    return packed.select(media, F.array_join(numbered, "\n").alias("document"))


def packed_markdown(phrases: DataFrame, media: str = "media") -> DataFrame:
    """(media, document): one line [start-end] Sn text for each phrase."""
    who = F.when(F.col("speaker").isNotNull(), F.concat(F.lit(" S"), F.regexp_replace("speaker", "^speaker_", ""))).otherwise("")
    line = F.concat(F.lit("["), X.seconds_text(F.col("start_ms")), F.lit("-"), X.seconds_text(F.col("end_ms")), F.lit("]"), who, F.lit(" "), F.col("text"))
    return phrases.groupBy(media).agg(_joined("phrase_id", line, "\n").alias("document"))


NO_SPEECH = "_no speech detected_"


def packed_file(documents: DataFrame, silence_ms: int = 500) -> DataFrame:
    """Packed documents as files: a heading, how the phrases were made, the lines, a line feed."""
    # The heading's lines.
    head = "# Packed transcript", "", f"Phrase-level, grouped on silences ≥ {silence_ms / 1000:g}s or speaker change.", "Use `[start-end]` ranges to address cuts in the EDL.", ""
    return documents.withColumn("document", F.concat(F.lit("\n".join(head) + "\n"), F.col("document"), F.lit("\n")))


def with_silent_media(documents: DataFrame, media_table: DataFrame, media: str = "media") -> DataFrame:
    """All media of ``media_table``; those without a document say so."""
    return media_table.select(media).join(documents, media, "left").withColumn("document", F.coalesce("document", F.lit(NO_SPEECH)))


def translation_template(windows: DataFrame, source_language: str, target_language: str, media: str = "media") -> DataFrame:
    """(media, document): the JSON that a translator fills in."""
    one = F.struct(F.col("window_id").alias("id"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "source_text", F.sequence("cue_first", "cue_last").alias("source_cue_indices"), F.lit("").alias("translated_text"))
    packed = windows.groupBy(media).agg(F.sort_array(F.collect_list(one)).alias("windows"))
    return packed.select(media, F.to_json(F.struct(F.col(media).cast("string").alias("source_srt"), F.lit(source_language).alias("source_language"), F.lit(target_language).alias("target_language"), F.size("windows").alias("window_count"), "windows")).alias("document"))


def concat_manifest(paths: DataFrame, key: str, order: str, path: str = "path") -> DataFrame:
    """(key, document): the list that a concat demuxer reads."""
    return paths.groupBy(key).agg(F.concat(_joined(order, F.concat(F.lit("file "), X.quote_concat_path(F.col(path))), "\n"), F.lit("\n")).alias("document"))


def output_decision(inputs: DataFrame, existing: DataFrame, key: str = "output", skip: bool = False, overwrite: bool = False) -> DataFrame:
    """Adds decision (process, skip or fail) for each input by whether its output exists."""
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    taken = "skip" if skip else "process" if overwrite else "fail"
    return inputs.join(there, key, "left").withColumn("decision", F.when(F.col("_there"), taken).otherwise("process")).drop("_there")


def cache_state(inputs: DataFrame, cached: DataFrame, key: str = "media") -> DataFrame:
    """Adds fresh: a cached row of the same backend whose source_hash is missing or equal."""
    c = cached.select(key, F.col("backend").alias("_backend"), F.col("source_hash").alias("_hash"))
    ok = (F.col("_backend") == F.col("backend")) & (F.col("_hash").isNull() | (F.col("_hash") == F.col("source_hash")))
    return inputs.join(c, key, "left").withColumn("fresh", F.coalesce(ok, F.lit(False))).drop("_backend", "_hash")


def skip_decision(inputs: DataFrame, existing: DataFrame, cached: DataFrame, key: str = "media", outputs: int = 3, some: str = "process") -> DataFrame:
    """Adds decision for runs that skip what is done: skip if all outputs are there (existing: key, output) and the
    cache is fresh, overwrite if they are there and stale, ``some`` if only some are there, else process."""
    there = existing.groupBy(key).agg((F.count_distinct("output") >= outputs).alias("_there"))
    decision = F.when(F.col("_there"), F.when(F.col("fresh"), "skip").otherwise("overwrite")).when(~F.col("_there"), some).otherwise("process")
    return cache_state(inputs, cached, key).join(there, key, "left").withColumn("decision", decision).drop("_there", "fresh")


def transcript_documents(words: DataFrame, media: str = "media") -> DataFrame:
    """(media, document): transcripts as JSON that ``readers.transcript_words`` reads, times in seconds."""
    one = F.struct("pos", F.struct("word", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker").alias("w"))
    listed = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["w"])
    return words.groupBy(media).agg(F.to_json(F.struct(listed.alias("words"))).alias("document"))


def translated_metadata(cues: DataFrame, windows: DataFrame, source_language: str, target_language: str, media: str = "media", order: tuple[str, ...] = ("window_id", "block")) -> DataFrame:
    """(media, document): counts, languages and the segments of translated captions, as JSON."""
    one = F.struct(*order, F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text").alias("s"))
    segments = cues.groupBy(media).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
    counts = windows.groupBy(media).agg(F.count("*").alias("window_count"))
    body = F.struct(F.col(media).cast("string").alias("source_srt"), F.lit(source_language).alias("source_language"), F.lit(target_language).alias("target_language"), "window_count", F.size("segments").alias("segment_count"), "segments")
    return counts.join(segments, media).select(media, F.to_json(body).alias("document"))


def report_documents(findings: DataFrame, report: DataFrame, media: str = "media", order: str = "finding") -> DataFrame:
    """(media, json, text): the findings and counts of each medium, as JSON and as lines to read."""
    fields = [F.col(c) for c in findings.columns if c not in (media, order)]
    tag = F.concat(F.when(F.col("severity") != "info", F.concat(F.lit(" ("), F.col("severity"), F.lit(")"))).otherwise(""), F.when(~F.col("passed") & (F.col("severity") == "warning"), " [non-blocking]").otherwise(""))
    line = F.concat(F.lit("  "), F.when(F.col("passed"), "✓").otherwise("✗"), F.lit(" ["), F.col("check"), F.lit("]"), tag, F.lit(" "), F.col("details"))
    one = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(*fields).alias("f"), line.alias("line"))))
    packed = findings.groupBy(media).agg(one.alias("all")).join(report.withColumnRenamed("passed", "_ok"), media)
    counts = F.concat_ws(", ", F.concat(F.col("n_passed"), F.lit(" passed")), F.when(F.col("n_failed") > 0, F.concat(F.col("n_failed"), F.lit(" failed"))), F.when(F.col("n_warnings") > 0, F.concat(F.col("n_warnings"), F.lit(" warning(s)"))))
    rule, thin = F.lit("=" * 60), F.lit("-" * 60)
    text = F.concat_ws("\n", rule, F.concat(F.lit("  Verify Report: "), F.when(F.col("_ok"), "PASS").otherwise("FAIL")), F.concat(F.lit("  Video: "), F.col(media).cast("string")), rule, F.array_join(F.transform("all", lambda x: x["line"]), "\n"), thin, F.concat(F.lit("  Total: "), counts), rule)
    body = F.struct(F.col(media).cast("string").alias("video"), F.col("_ok").alias("passed"), F.col("n_passed").alias("pass_count"), F.col("n_failed").alias("fail_count"), F.col("n_warnings").alias("warning_count"), F.transform("all", lambda x: x["f"]).alias("findings"))
    return packed.select(media, F.to_json(body).alias("json"), text.alias("text"))


def batch_result(outcomes: DataFrame, error: str = "error", by: tuple[str, ...] = ()) -> DataFrame:
    """(n_ok, n_failed, exit_code) of a batch, or of each batch named by the columns ``by``."""
    return outcomes.groupBy(*by).agg(F.count_if(F.col(error).isNull()).alias("n_ok"), F.count_if(F.col(error).isNotNull()).alias("n_failed")).withColumn("exit_code", F.when(F.col("n_failed") > 0, 1).otherwise(0))


def write_documents(documents: DataFrame, path: str, media: str = "media", ending: str = ".txt", exists: str = "fail") -> None:
    """One file for each medium, named by its stem; refuses to overwrite unless told (``named_files``)."""
    named_files.write_files(documents.select(F.concat(X.stem(F.col(media).cast("string")), F.lit(ending)).alias("name"), "document"), path, exists=exists)
