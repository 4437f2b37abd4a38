"""Whole jobs over folders of files, and a command line for them: ``python -m cuegrid.jobs NAME ...``.

Each job reads with ``sources.readers``, applies operators and returns DataFrames; ``main`` writes them.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.operators import edl, folds, islands, signal
from cuegrid.plans import ffmpeg
from cuegrid.sources import readers, sinks, wav
from cuegrid.streaming import ingest


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_transcripts(spark, path)


def pack(spark: SparkSession, path: str, silence_ms: int = islands.PHRASE_SILENCE_MS) -> DataFrame:
    """(media, document): packed Markdown files of all transcripts; those without words say so."""
    t = transcripts(spark, path)
    return sinks.packed_file(sinks.with_silent_media(sinks.packed_markdown(islands.phrases(readers.transcript_words(t), silence_ms)), t), silence_ms)


def probes(spark: SparkSession, path: str) -> DataFrame:
    """(stem, duration, width, height, fps, has_audio, has_video) of the media probes in JSON files, which have the
    names of their media."""
    p = spark.read.text(path, wholetext=True).select(X.stem(F.col("_metadata.file_path")).alias("stem"), readers.probe(F.col("value")).alias("p"))
    return p.select("stem", "p.*")


def _probed(media: DataFrame, spark: SparkSession, path: str | None, name: str = "path") -> DataFrame:
    """``media`` with what the probes say about each path; nulls where there is none."""
    stemmed = media.withColumn("_stem", X.stem(F.col(name)))
    if path is None:
        none = {"duration": "double", "has_audio": "boolean", "has_video": "boolean", "width": "int", "fps": "int"}
        return stemmed.withColumns({k: F.lit(None).cast(v) for k, v in none.items()}).drop("_stem")
    return stemmed.join(probes(spark, path).withColumnRenamed("stem", "_stem").drop("height"), "_stem", "left").drop("_stem")


def caption_cues(spark: SparkSession, path: str) -> DataFrame:
    """(media, cue, start_ms, end_ms, text, speaker): captions of every transcript, segment by segment."""
    made = folds.captions(readers.transcript_segments(transcripts(spark, path)), ("media", "segment"))
    return made.select("media", F.row_number().over(W.partitionBy("media").orderBy("segment", "block")).alias("cue"), "start_ms", "end_ms", "text", "speaker")


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(media, srt, txt) of every transcript."""
    cues = caption_cues(spark, path)
    srt = sinks.srt_documents(cues, speaker="speaker").withColumnRenamed("document", "srt")
    return srt.join(sinks.txt_documents(cues).withColumnRenamed("document", "txt"), "media")


def translation_template(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """(media, document): what a translator fills in, for every SRT file."""
    return sinks.translation_template(folds.translation_windows(readers.read_srt(spark, path).where("error IS NULL")), source, target)


def translated_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(media, document): SRT of every filled-in translation. Times are shared out inside each window."""
    w = readers.read_json(spark, path, readers.TRANSLATION).select("media", F.explode("windows").alias("w"))
    windows = w.select("media", F.col("w.id").alias("window_id"), readers.ms(F.col("w.start")).alias("start_ms"), readers.ms(F.col("w.end")).alias("end_ms"), F.col("w.translated_text").alias("translated_text"))
    cues = islands.allocated(folds.translated_blocks(windows, ("media", "window_id")), ("media", "window_id"))
    return sinks.srt_documents(cues, order=("window_id", "block"))


def styled_captions(spark: SparkSession, path: str, style: str = "bold") -> DataFrame:
    """(media, document): SRT files in the bold (two upper-case words) or natural (sentences) style."""
    cues = readers.read_srt(spark, path).where("error IS NULL").select("media", "cue", "start_ms", "end_ms", "text")
    if style == "bold":
        return sinks.srt_documents(islands.bold_captions(cues, ("media", "cue")), order=("cue", "chunk"))
    return sinks.srt_documents(folds.natural_captions(islands.merged_cues(cues), ("media", "island")), order=("island", "chunk"))


def translation_errors(spark: SparkSession, path: str, srt: str, source: str, target: str) -> DataFrame:
    """(media, window_id, rule, message) of filled-in translations against the SRT files (of the same stem as the
    payload's source_srt) they were made for: languages (rules 1, 2; window_id null), the number of windows (3), and
    window by window what ``payload_violations`` finds, 10 added to its rules. No translation is one of them."""
    t = readers.read_json(spark, path, readers.TRANSLATION).withColumn("media", X.stem(F.col("source_srt")))
    asked = t.select("media", F.lit(source).alias("source_language"), F.lit(target).alias("target_language"))
    cues = readers.read_srt(spark, srt).where("error IS NULL").withColumn("media", X.stem(F.col("media")))
    want = folds.translation_windows(cues).join(t.select("media"), "media", "left_semi")
    w = t.select("media", F.explode("windows").alias("w"))
    got = w.select("media", F.col("w.id").cast(want.schema["window_id"].dataType).alias("window_id"), readers.ms(F.col("w.start")).alias("start_ms"), readers.ms(F.col("w.end")).alias("end_ms"), X.collapse_whitespace(F.col("w.source_text")).alias("source_text"), F.col("w.translated_text").alias("translated_text"))
    nowhere = lambda df: df.withColumn("window_id", F.lit(None).cast(want.schema["window_id"].dataType))
    whole = nowhere(edl.payload_language_violations(asked, t)).unionByName(nowhere(edl.payload_count_violations(want, got)))
    return whole.unionByName(edl.payload_violations(want, got).withColumn("rule", F.col("rule") + 10)).select("media", "window_id", "rule", "message")


def edit_plan(spark: SparkSession, edls: str, words_of: str, quality: str = "final", probed: str | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(violations, segments with their argument lists, captions) of every edit list. A source's transcript is the
    file with its stem, and so is its probe, which gives its end and whether it has sound (where there is none: yes).
    ``keep`` writes a table and reads it back (``_kept``): with it every file is read once, and ranges with their words
    are worked out once for segments and captions."""
    keep = keep or (lambda df, name: df)
    files = keep(readers.json_files(spark, edls), "lists")
    e = readers.json_fields(files, readers.EDL).withColumnRenamed("media", "edl")
    heads = readers.json_fields(files, "version INT, grade STRING, sources STRING, subtitles STRING, overlays STRING").withColumnRenamed("media", "edl")
    sources, ranges, overlays = readers.edl_sources(e), readers.edl_ranges(e), readers.edl_overlays(e)
    raw = e.select("edl", F.posexplode("ranges").alias("range_idx", "r")).select("edl", "range_idx", "r.source", "r.start", "r.end", "r.grade")
    none = lambda c: F.lit(None).cast("int").alias(c)
    bad = edl.range_violations(heads, raw, sources).select("edl", "range_idx", none("overlay_idx"), "rule", "message")
    bad = bad.unionByName(edl.overlay_violations(overlays).select("edl", none("range_idx"), "overlay_idx", "rule", "message"))
    # Two edits may give one name to different media, so words, ends and probes go by the medium behind the name.
    media = sources.withColumn("medium", X.stem(F.col("path")))
    words = readers.spoken(readers.transcript_words(keep(transcripts(spark, words_of).select("media", "words", "segments"), "transcripts"))).select(X.stem(F.col("media")).alias("medium"), "pos", "word", F.col("start_ms").alias("word_start"), F.col("end_ms").alias("word_end"))
    placed = ranges.select("edl", "range_idx", "source", "start_ms", "end_ms").join(media.select("edl", "source", "medium").distinct(), ["edl", "source"], "left")
    joined = keep(edl.ranges_with_words(keep(placed, "ranges"), words, source="medium"), "joined")
    known = keep(_probed(media, spark, probed), "sources")
    lengths = known.where("duration IS NOT NULL").groupBy("medium").agg(readers.ms(F.min("duration")).alias("duration_ms"))
    bounds = edl.snapped_and_padded(joined, lengths, source="medium")
    segments = bounds.join(placed.select("edl", "range_idx", "source"), ["edl", "range_idx"]).join(known.drop("medium"), ["edl", "source"]).join(ranges.select("edl", "range_idx", "grade", "edl_grade"), ["edl", "range_idx"])
    argv = ffmpeg.extract_segment(F.col("path"), F.col("cut_start"), F.col("cut_end") - F.col("cut_start"), ffmpeg.resolved_grade(F.col("grade"), F.col("edl_grade")), ffmpeg.segment_name(F.col("range_idx"), F.col("path")), F.coalesce("has_audio", F.lit(True)), quality)
    captions = sinks.srt_documents(edl.master_cues(bounds, joined), media="edl")
    return bad, segments.select("edl", "range_idx", "source", "cut_start", "cut_end", argv.alias("argv")), captions


def final_passes(spark: SparkSession, edls: str, base: str, output: str, probed: str | None = None, style: str = "bold-overlay") -> DataFrame:
    """(edl, argv): the last pass of every edit list over its joined segments, {base}/stem.mp4 to {output}/stem.mp4:
    overlays that have a source, and captions from {base}/stem.srt where the list has subtitles."""
    e = readers.read_json(spark, edls, readers.EDL).withColumnRenamed("media", "edl")
    at = lambda folder, ending: F.concat(F.lit(folder + "/"), X.stem(F.col("edl")), F.lit(ending))
    o = readers.edl_overlays(e).where("source IS NOT NULL").withColumn("idx", F.col("overlay_idx") + 1)
    o = o.select("edl", "idx", F.col("source").alias("path"), readers.ms(F.col("start")).alias("start_ms"), readers.ms(F.col("end")).alias("end_ms"), "x", "y", "z_order")
    captions = ffmpeg.subtitle_filter(at(base, ".srt"), F.lit(ffmpeg.FORCE_STYLES[style]))
    lists = _probed(e.select("edl", F.col("subtitles").isNotNull().alias("captioned"), at(base, ".mp4").alias("path")), spark, probed)
    graphs = ffmpeg.overlay_graph(ffmpeg.overlay_parts(o).join(lists.select("edl", "captioned"), "edl").withColumn("captions", F.when(F.col("captioned"), captions)), subtitles=F.max("captions"))
    both = lists.join(ffmpeg.overlay_inputs(o), "edl", "left").join(graphs, "edl", "left")
    return both.select("edl", ffmpeg.final_pass(F.col("path"), F.col("inputs"), F.col("filter_complex"), F.when(F.col("captioned"), captions), F.col("duration"), at(output, ".mp4")).alias("argv"))


def rough_cuts(spark: SparkSession, path: str, probed: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(errors, segments, assemblies) of rough-cut specs: segments of no known type; each segment's argument list
    and card text; each spec's manifest and the argument list that joins it."""
    spec = readers.rough_cut_segments(readers.read_json(spark, path, readers.ROUGH_CUT).withColumnRenamed("media", "spec"))
    made = F.concat(F.col("generated_clips_dir"), F.lit("/"), F.col("name"), F.lit(".mp4"))
    picture = F.concat(F.col("text_dir"), F.lit("/"), F.col("name"), F.lit(".png"))
    argv = ffmpeg.rough_cut_segment(F.col("type"), F.col("input"), picture, F.col("start"), F.col("end"), F.col("_lasts"), made, F.coalesce("has_audio", F.lit(True)))
    # A probe has a duration as well.
    known = _probed(spec.withColumnRenamed("duration", "_lasts"), spark, probed, "input")
    text = F.when(F.col("type") == "card", F.concat(ffmpeg.card_text(F.coalesce("header", F.lit("")), F.coalesce("meta", F.lit("")), F.coalesce("body", F.lit(""))), F.lit("\n")))
    rows = known.select("spec", "segment_idx", "name", "type", made.alias("path"), argv.alias("argv"), text.alias("card"), "manifest_path", "assembly_path")
    errors = rows.where("argv IS NULL").select("spec", "segment_idx", F.concat(F.lit("unsupported segment type: "), F.coalesce("type", F.lit("none"))).alias("error"))
    joins = sinks.concat_manifest(rows, "spec", "segment_idx").join(rows.groupBy("spec").agg(F.first("manifest_path").alias("manifest_path"), F.first("assembly_path").alias("assembly_path")), "spec")
    return errors, rows.drop("manifest_path", "assembly_path"), joins.select("spec", "document", ffmpeg.rough_cut_concat(F.col("manifest_path"), F.col("assembly_path")).alias("argv"))


def _outputs(inputs: DataFrame, folder: str, ending: str) -> DataFrame:
    return inputs.withColumn("output", F.concat(F.lit(folder + "/"), X.stem(F.col("path")), F.lit(ending)))


def _decided(inputs: DataFrame, existing: DataFrame | None, skip: bool, overwrite: bool) -> DataFrame:
    return inputs.withColumn("decision", F.lit("process")) if existing is None else sinks.output_decision(inputs, existing.select(F.col("path").alias("output")), skip=skip, overwrite=overwrite)


def contact_sheets(spark: SparkSession, manifest: str, output: str, probed: str, columns: int = 4, rows: int = 4, width: int = 320, existing: DataFrame | None = None, skip: bool = False, overwrite: bool = False) -> DataFrame:
    """(path, output, decision, error, argv) for every medium of the manifests."""
    media = _outputs(_probed(readers.read_manifest(spark, manifest), spark, probed), output, "_contact_sheet.jpg")
    wrong = F.coalesce(ffmpeg.sheet_violation(F.lit(columns), F.lit(rows), F.lit(width)), F.when(F.col("duration").isNull(), "no duration"))
    plan = ffmpeg.contact_sheet(F.col("path"), F.col("output"), F.col("duration"), columns, rows, width)
    return _decided(media, existing, skip, overwrite).select("path", "output", "decision", wrong.alias("error"), F.when(wrong.isNull() & (F.col("decision") == "process"), plan).alias("argv"))


def timeline_views(spark: SparkSession, manifest: str, output: str, probed: str, words_of: str | None = None, start: float = 0.0, end: float | None = None, frames: int = 10, sounds: str | None = None) -> DataFrame:
    """(path, output, error, start, end, frame_argv, sound_argv, layout, ruler, labels, silences, envelope): what a
    picture of each medium's timeline is drawn from: the argument lists of its frames and its sound, vertical places,
    ticks, word labels and silences (arrays, null without words), and the envelope of the sound (null where
    ``sounds``, a folder of WAV files of the media's stems, has none)."""
    media = _outputs(_probed(readers.read_manifest(spark, manifest), spark, probed), output, "_timeline.png").withColumn("media", X.stem(F.col("path")))
    stop = F.lit(end).cast("double") if end is not None else F.col("duration")
    wrong = F.coalesce(F.when(F.col("duration").isNull(), "no duration"), ffmpeg.span_violation(F.lit(start), stop, F.col("duration")))
    media = media.withColumns({"error": wrong, "start": F.lit(start), "end": F.least(stop, F.col("duration"))})
    n = ffmpeg.capped_frames(F.greatest(F.lit(frames), F.lit(1)))
    step = (F.col("end") - F.col("start")) / F.greatest(n - 1, F.lit(1))
    times = F.when(n == 1, F.array((F.col("start") + F.col("end")) / 2)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("start") + k * step))
    shots = F.transform(times, lambda t, k: ffmpeg.frame_picture(F.col("path"), t, F.format_string("f_%03d.jpg", k)))
    rows = media.select("media", "path", "output", "error", "start", "end", F.when(F.col("error").isNull(), shots).alias("frame_argv"), F.when(F.col("error").isNull(), ffmpeg.timeline_sound(F.col("path"), F.col("start"), F.col("end"), F.concat(F.col("media"), F.lit(".wav")))).alias("sound_argv"), ffmpeg.timeline_layout(F.lit(ffmpeg.FRAME_HEIGHT), F.lit(ffmpeg.WAVE_HEIGHT)).alias("layout"), ffmpeg.ruler(F.col("start"), F.col("end")).alias("ruler"))
    if sounds is None:
        rows = rows.withColumn("envelope", F.lit(None).cast("array<double>"))
    else:
        levels = wav.envelopes(wav.read_wav(spark, sounds), ffmpeg.CANVAS - 2 * ffmpeg.MARGIN).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "level"))), lambda x: x["level"]).alias("envelope"))
        rows = rows.join(levels.select(X.stem(F.col("path")).alias("media"), "envelope"), "media", "left")
    if words_of is None:
        return rows.withColumns({k: F.lit(None) for k in ("labels", "silences")}).drop("media")
    words = readers.transcript_words(transcripts(spark, words_of)).withColumn("media", X.stem(F.col("media")))
    spans = rows.select("media", readers.ms(F.col("start")).alias("start_ms"), readers.ms(F.col("end")).alias("end_ms"))
    ranges = spans.select("media", F.col("start_ms").alias("range_start"), F.col("end_ms").alias("range_end"))
    inside = words.join(ranges, "media").where("end_ms > range_start AND start_ms < range_end").select(*words.columns)
    quiet = islands.silences(inside, ranges).groupBy("media").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms"))).alias("silences"))
    return rows.join(ffmpeg.word_labels(words, spans), "media", "left").join(quiet, "media", "left").drop("media")


def boundary_views(spark: SparkSession, edls: str, videos: str, folder: str, frames: int = 4) -> DataFrame:
    """(media, picture_no, cut_time, path, start, end, frame_argv): a picture of the timeline around every cut of the
    renders {videos}/stem.mp4."""
    _, cuts = _verified_media(spark, edls, None)
    spans = signal.boundary_spans(cuts, folder)
    video = F.concat(F.lit(videos + "/"), F.col("media"), F.lit(".mp4"))
    shots = F.transform(signal.frame_times(F.col("start"), F.col("end"), frames), lambda t, k: ffmpeg.frame_picture(video, t, F.format_string("f_%03d.jpg", k)))
    return spans.withColumn("frame_argv", shots)


def grades(spark: SparkSession, manifest: str, output: str, preset: str | None = "subtle", custom: str | None = None) -> DataFrame:
    """(path, output, argv): a graded copy of every medium, by a filter or the name of one."""
    made = _outputs(readers.read_manifest(spark, manifest), output, "_graded.mp4")
    chosen = ffmpeg.resolved_grade(F.lit(custom if custom is not None else preset).cast("string"), F.lit(None).cast("string"))
    return made.select("path", "output", ffmpeg.grade(F.col("path"), F.col("output"), chosen).alias("argv"))


def loudness(spark: SparkSession, manifest: str, output: str, reports: str | None = None, probed: str | None = None) -> DataFrame:
    """(path, output, two_pass, argv): a copy of every medium at the target loudness. ``reports`` are the texts of
    the measuring pass (``measure_loudness``), with the stems of their media; without one a single pass is made."""
    made = _outputs(_probed(readers.read_manifest(spark, manifest), spark, probed), output, "_loudnorm.mp4").withColumn("_stem", X.stem(F.col("path")))
    if reports is not None:
        r = spark.read.text(reports, wholetext=True).select(X.stem(F.col("_metadata.file_path")).alias("_stem"), readers.loudness(F.col("value")).alias("measured"))
        made = made.join(r, "_stem", "left")
    else:
        made = made.withColumn("measured", F.lit(None).cast(readers.LOUDNESS))
    plan = ffmpeg.loudnorm(F.col("path"), F.col("output"), F.col("measured"), F.coalesce("has_video", F.lit(False)))
    return made.select("path", "output", F.col("measured").isNotNull().alias("two_pass"), plan.alias("argv"))


def burn_ins(spark: SparkSession, manifest: str, srt: str, output: str, style: str = "bold-overlay", pre_filters: str | None = None, overwrite: bool = False) -> DataFrame:
    """(path, srt, output, document, error, argv): captions of the same stem, made anew in the style (document is
    what the file {output}/stem.srt has to hold) and burnt into every video of the manifests."""
    videos = _outputs(readers.read_manifest(spark, manifest), output, "_captioned.mp4").withColumn("stem", X.stem(F.col("path")))
    made = styled_captions(spark, srt, "bold" if style == "bold-overlay" else "natural").select(X.stem(F.col("media")).alias("stem"), "document")
    early = ffmpeg.early_filter(F.lit(pre_filters).cast("string"))
    wrong = F.coalesce(F.concat(F.lit("before the captions: "), early), F.when(F.col("document").isNull(), F.concat(F.lit("no captions for "), F.col("stem"))))
    file = F.concat(F.lit(output + "/"), F.col("stem"), F.lit(".srt"))
    plan = ffmpeg.burn_in(F.col("path"), F.col("output"), ffmpeg.subtitle_filter(file, F.lit(ffmpeg.FORCE_STYLES[style]), F.lit(pre_filters).cast("string")), overwrite)
    return videos.join(made, "stem", "left").select("path", file.alias("srt"), "output", "document", wrong.alias("error"), F.when(wrong.isNull(), plan).alias("argv"))


def verify(spark: SparkSession, edls: str, probed: str, deltas: DataFrame, envelopes: DataFrame, samples: DataFrame, again: list[DataFrame] | None = None, measure: Callable[[DataFrame, int], DataFrame] | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(findings, documents: media, json, text) of renders against their edit lists of the same stem. What was
    measured on them is given by stem (see ``signal.verification``). What fails is checked again: ``again`` are the
    findings of later passes, one table for each; or ``measure`` makes them, ``most`` times at most, until nothing
    fails or a pass changes nothing (``signal.verified``, also for ``keep``)."""
    findings = signal.verification(*_verified_media(spark, edls, probed), deltas, envelopes, samples)
    for k, more in enumerate(again or [], 1):
        findings = signal.rechecked(findings, more, retry=k, last=k == len(again))
    if measure is not None:
        findings, _, _ = signal.verified(findings, measure, keep, most)
    return findings, sinks.report_documents(findings, signal.report(findings))


def _verified_media(spark: SparkSession, edls: str, probed: str | None) -> tuple[DataFrame | None, DataFrame]:
    """The durations (None without probes) and cuts of the edit lists."""
    e = readers.read_json(spark, edls, readers.EDL).withColumnRenamed("media", "edl").withColumn("media", X.stem(F.col("edl")))
    ranges = readers.edl_ranges(e).withColumn("media", X.stem(F.col("edl")))
    stated = e.select("media", F.col("total_duration_s").alias("expected"))
    durations = None if probed is None else stated.join(probes(spark, probed).select(F.col("stem").alias("media"), F.col("duration").alias("actual")), "media", "left").select("media", "actual", "expected")
    cuts = islands.cut_boundaries(ranges.drop("edl").withColumnRenamed("media", "edl")).select(F.col("edl").alias("media"), (F.col("boundary_ms") / 1000).alias("cut_time"))
    return durations, cuts


def measured_passes(spark: SparkSession, edls: str, probed: str, folder: str) -> Callable[[DataFrame, int], DataFrame]:
    """A measuring function over folders of tables, ``folder``/pass-1, pass-2 and so on; where the next is missing,
    nothing new is measured."""

    def measure(failing: DataFrame, k: int) -> DataFrame:
        try:
            tables = [spark.read.parquet(f"{folder}/pass-{k}/{x}") for x in ("deltas", "envelopes", "samples")]
        except AnalysisException:
            return failing.limit(0)
        return signal.verification(*_verified_media(spark, edls, probed), *tables).join(failing.select("media", "check").distinct(), ["media", "check"], "left_semi")

    return measure


def _kept(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def batch_subtitles(spark: SparkSession, manifests: str, output: str, recogniser: str, backend: str, skip_existing: bool = True, overwrite: bool = False) -> dict[str, DataFrame]:
    """Transcribes what new manifests of a folder name (``streaming.ingest``); ``recogniser`` is module:function. The
    ledger of all batches, and their results with an exit code each."""
    module, _, name = recogniser.partition(":")
    ingest.transcribe(spark, manifests, output, getattr(importlib.import_module(module), name), backend, skip_existing=skip_existing, overwrite=overwrite).awaitTermination()
    return {"ledger": ingest.ledger(spark, output), "results": ingest.result(spark, output)}


def _jobs(spark: SparkSession, a: argparse.Namespace) -> dict:
    """What each name runs: one table, or several by name."""
    out = a.media_output or a.output
    three = lambda names, made: dict(zip(names, made, strict=True))
    return {
        "pack": lambda: pack(spark, a.input),
        "subtitles": lambda: subtitles(spark, a.input),
        "translation-template": lambda: translation_template(spark, a.input, *a.languages),
        "translated-subtitles": lambda: {"documents": translated_subtitles(spark, a.input)} | ({"errors": translation_errors(spark, a.input, a.srt, *a.languages)} if a.srt else {}),
        "styled-captions": lambda: styled_captions(spark, a.input, a.style),
        "edit-plan": lambda: three(("violations", "segments", "captions"), edit_plan(spark, a.input, a.words, probed=a.probes, keep=_kept(spark, f"{a.output}_parts"))),
        "final-passes": lambda: final_passes(spark, a.input, a.base, out, a.probes, "bold-overlay" if a.style == "bold" else "natural-sentence"),
        "rough-cuts": lambda: three(("errors", "segments", "assemblies"), rough_cuts(spark, a.input, a.probes)),
        "contact-sheets": lambda: contact_sheets(spark, a.input, out, a.probes),
        "timeline-views": lambda: timeline_views(spark, a.input, out, a.probes, a.words, sounds=a.sounds),
        "grades": lambda: grades(spark, a.input, out, a.grade),
        "loudness": lambda: loudness(spark, a.input, out, a.reports, a.probes),
        "verify": lambda: three(("findings", "documents"), verify(spark, a.input, a.probes, *(spark.read.parquet(f"{a.measured}/{x}") for x in ("deltas", "envelopes", "samples")), measure=measured_passes(spark, a.input, a.probes, a.measured), keep=_kept(spark, f"{a.output}_passes"), most=a.max_passes)),
        "batch-subtitles": lambda: batch_subtitles(spark, a.input, out, a.recogniser, a.backend, overwrite=a.overwrite),
        "burn-ins": lambda: burn_ins(spark, a.input, a.srt, out, "bold-overlay" if a.style == "bold" else "natural-sentence"),
    }


#: Jobs whose tables are documents: (table, column, ending of the files).
FILES = {"pack": [("", "document", ".md")], "subtitles": [("", "srt", ".srt"), ("", "txt", ".txt")], "translation-template": [("", "document", ".json")], "translated-subtitles": [("documents", "document", ".srt")], "styled-captions": [("", "document", ".srt")], "verify": [("documents", "json", ".json"), ("documents", "text", ".txt")]}


#: Jobs that read JSON files; those that can't be read are written beside the output, as {output}_rejects.
JSON_INPUTS = ("pack", "subtitles", "translated-subtitles", "edit-plan", "final-passes", "rough-cuts", "verify")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cuegrid")
    p.add_argument("job", choices=["pack", "subtitles", "translation-template", "translated-subtitles", "styled-captions", "edit-plan", "final-passes", "rough-cuts", "contact-sheets", "timeline-views", "grades", "loudness", "burn-ins", "batch-subtitles", "verify"])
    p.add_argument("input")
    p.add_argument("output", help="where the tables are written")
    p.add_argument("--words", help="transcripts of the media")
    p.add_argument("--probes", help="probes of the media")
    p.add_argument("--reports", help="loudness reports of the media")
    p.add_argument("--srt", help="captions of the media")
    p.add_argument("--measured", help="folder of the tables deltas, envelopes and samples")
    p.add_argument("--max-passes", type=int, default=3, help="how often what fails is checked again, against the folder's pass-1, pass-2 ...")
    p.add_argument("--sounds", help="folder of WAV files of the media")
    p.add_argument("--base", help="folder of joined segments")
    p.add_argument("--media-output", help="folder of the media that the argument lists make")
    p.add_argument("--recogniser", help="module:function that returns the transcript of a path")
    p.add_argument("--backend", default="custom", help="name under which transcripts are cached")
    p.add_argument("--grade", default="subtle")
    p.add_argument("--style", choices=["bold", "natural"], default="bold")
    p.add_argument("--languages", nargs=2, default=["en", "de"])
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--files", help="folder that gets a file of each medium's document as well")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName(f"cuegrid {a.job}").getOrCreate()
    made = _jobs(spark, a)[a.job]()
    for given in (x for x in (a.input if a.job in JSON_INPUTS else None, a.words) if x):
        wrong = readers.rejects(spark, given)
        if wrong.limit(1).count():
            wrong.write.mode("append").json(f"{a.output}_rejects")
    for name, df in (made if isinstance(made, dict) else {"": made}).items():
        df.write.mode("overwrite" if a.overwrite else "errorifexists").json(f"{a.output}/{name}" if name else a.output)
        for _, column, ending in (x for x in FILES.get(a.job, []) if a.files and x[0] == name):
            sinks.write_documents(df.select("media", F.col(column).alias("document")), a.files, ending=ending, exists="replace" if a.overwrite else "fail")


if __name__ == "__main__":
    main()
