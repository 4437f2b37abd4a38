"""Sources: manifests, transcripts in three layouts, SRT, edit decision lists, rough-cut specs, translation
payloads, media probes, frame statistics and loudness reports, each as a DataFrame.

Readers take a path (file, folder or glob) that Spark reads; parsers take a column. Times become whole
milliseconds. Bad rows are kept with an error text or null, and not raised, unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.functions import text as X

WORD = "STRUCT<word: STRING, text: STRING, start: DOUBLE, end: DOUBLE, speaker: STRING, speaker_id: STRING, type: STRING>"
TRANSCRIPT = f"text STRING, language STRING, language_code STRING, backend STRING, source_hash STRING, words ARRAY<{WORD}>, segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, speaker_id: STRING, words: ARRAY<{WORD}>>>, audio_events ARRAY<STRUCT<text: STRING, start: DOUBLE, end: DOUBLE, type: STRING>>"
EDL = "version INT, sources STRING, ranges ARRAY<STRUCT<source: STRING, start: DOUBLE, end: DOUBLE, beat: STRING, quote: STRING, reason: STRING, note: STRING, grade: STRING>>, overlays ARRAY<STRUCT<source: STRING, card: STRUCT<type: STRING, text: STRING, counter_start: DOUBLE, counter_end: DOUBLE, width: DOUBLE, height: DOUBLE, font_size: DOUBLE, color: STRING, bg_color: STRING>, start: DOUBLE, end: DOUBLE, position: STRUCT<x: DOUBLE, y: DOUBLE>, z_order: DOUBLE, duration_type: STRING>>, subtitles STRING, grade STRING, total_duration_s DOUBLE"
ROUGH_CUT = "generated_clips_dir STRING, text_dir STRING, manifest_path STRING, assembly_path STRING, segments ARRAY<STRUCT<name: STRING, type: STRING, input: STRING, start: STRING, end: STRING, duration: STRING, header: STRING, meta: STRING, body: STRING>>"
TRANSLATION = "source_srt STRING, source_language STRING, target_language STRING, window_count INT, windows ARRAY<STRUCT<id: INT, start: DOUBLE, end: DOUBLE, source_text: STRING, source_cue_indices: ARRAY<INT>, translated_text: STRING>>"
PROBE = "STRUCT<format: STRUCT<duration: STRING>, streams: ARRAY<STRUCT<codec_type: STRING, width: INT, height: INT, avg_frame_rate: STRING, r_frame_rate: STRING, duration: STRING>>>"
LOUDNESS = "STRUCT<input_i: STRING, input_tp: STRING, input_lra: STRING, input_thresh: STRING, target_offset: STRING>"


def ms(seconds: Column) -> Column:
    """Whole milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("long")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(manifest, line_no, path): inputs of manifest files; blank lines and # comments are skipped, relative paths
    stand against the manifest's folder, ~ against the value of spark.cuegrid.home (default /root)."""
    home = spark.conf.get("spark.cuegrid.home", "/root")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("manifest"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return manifest_inputs(whole, home)


def manifest_inputs(lines: DataFrame, home: str = "/root") -> DataFrame:
    line = F.trim("line")
    folder = F.regexp_replace(F.regexp_replace("manifest", "^file:/*", "/"), "/[^/]*$", "")
    full = F.when(line.startswith("~/"), F.concat(F.lit(home), F.substring(line, F.lit(2), F.length(line)))).when(line.startswith("/"), line).otherwise(F.concat_ws("/", folder, line))
    return lines.where((line != "") & ~line.startswith("#")).select("manifest", "line_no", X.normal_path(full).alias("path"))


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(media, value) of whole files. Of files without a byte Spark makes no row."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("media"), F.col("content").cast("string").alias("value"))


def _braced(value: Column) -> Column:
    """Whether a text that is JSON is an object. A variant's schema would say so as well, but takes all its fields."""
    return value.rlike(r"^[\s\x{FEFF}]*\{")


def json_error(value: Column) -> Column:
    """Why a text is not one JSON object; null if it is."""
    parsed = F.try_parse_json(value)
    return F.when(~F.coalesce(value, F.lit("")).rlike(r"\S"), "empty").when(parsed.isNull(), "not JSON").when(~_braced(value), "not an object")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(media, value) of the files that are one JSON object; the others are rows of ``rejects``."""
    return _whole_files(spark, path).where(json_error(F.col("value")).isNull())


def json_fields(files: DataFrame, schema: str) -> DataFrame:
    """The fields of ``json_files``, and ``media``. A field of another kind is null."""
    return files.select(F.from_json("value", schema).alias("j"), "media").select("j.*", "media")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object for each file, with its path as ``media``. A field of another kind is null; a file that is not one
    JSON object is left out here and a row of ``rejects``."""
    return json_fields(json_files(spark, path), schema)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(media, error) of the files that ``read_json`` and ``read_transcripts`` leave out."""
    return rejected(_whole_files(spark, path))


def rejected(documents: DataFrame, value: str = "value") -> DataFrame:
    """(media, error) of the documents (media, value) that are no transcripts: not one JSON object, or with a segment
    that is neither an object nor a list of three."""
    bad = documents.withColumn("error", F.coalesce(json_error(F.col(value)), segment_error(F.try_parse_json(value))))
    return bad.where("error IS NOT NULL").select("media", "error")


# Transcripts differ by who made them: words at the top or inside segments, segments as objects or as [start_ms, end_ms,
# text], numbers as numbers or as text, ``language`` or ``language_code``. As VARIANT each value is looked at where it is.


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _variant_words(v: Column) -> Column:
    """array<WORD> of a variant's field ``words``, taken over in one step; what is no object has no fields."""
    none = F.from_json(F.lit("{}"), "word STRING, text STRING, start DOUBLE, end DOUBLE, speaker STRING, speaker_id STRING, type STRING")
    return F.transform(_get(v, "$.words", f"array<{WORD}>"), lambda w: F.coalesce(w, none))


def _is_list(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def segment_error(v: Column) -> Column:
    """The first segment that is neither an object nor a list of three at least; null if there is none."""
    ok = lambda s: F.schema_of_variant(s).startswith("OBJECT") | (_is_list(s) & (F.size(_get(s, "$", "array<variant>")) >= 3))
    wrong = F.filter(F.transform(_get(v, "$.segments", "array<variant>"), lambda s, k: F.when(~F.coalesce(ok(s), F.lit(False)), k)), lambda k: k.isNotNull())
    return F.when(F.size(wrong) > 0, F.concat(F.lit("segment "), wrong[0], F.lit(" is neither an object nor a list of three")))


def _variant_segments(v: Column) -> Column:
    none = F.expr(f"CAST(ARRAY() AS ARRAY<{WORD}>)")

    def one(s: Column) -> Column:
        third = lambda k: (_get(s, f"$[{k}]", "double") / 1000)
        given = F.struct(_get(s, "$.start", "double").alias("start"), _get(s, "$.end", "double").alias("end"), _get(s, "$.text", "string").alias("text"), _get(s, "$.speaker_id", "string").alias("speaker_id"), F.coalesce(_variant_words(s), none).alias("words"))
        listed = F.struct(third(0).alias("start"), third(1).alias("end"), _get(s, "$[2]", "string").alias("text"), F.lit(None).cast("string").alias("speaker_id"), none.alias("words"))
        return F.when(_is_list(s), listed).otherwise(given)

    return F.transform(_get(v, "$.segments", "array<variant>"), one)


def parse_transcripts(documents: DataFrame, value: str = "value") -> DataFrame:
    """The columns of TRANSCRIPT and ``media`` for the documents (media, value) that ``rejected`` does not name."""
    v = F.col("_v")
    events = F.transform(_get(v, "$.audio_events", "array<variant>"), lambda e: F.struct(_get(e, "$.text", "string").alias("text"), _get(e, "$.start", "double").alias("start"), _get(e, "$.end", "double").alias("end"), _get(e, "$.type", "string").alias("type")))
    text = lambda k: _get(v, f"$.{k}", "string").alias(k)
    # A row's text is parsed once: a filter over a parsed column would be pushed below it, and parse again for each use.
    good = documents.select("media", F.explode(F.filter(F.array(F.try_parse_json(value)), lambda x: x.isNotNull() & _braced(F.col(value)) & segment_error(x).isNull())).alias("_v"))
    return good.select("media", text("text"), F.coalesce(_get(v, "$.language", "string"), _get(v, "$.language_code", "string")).alias("language"), text("language_code"), text("backend"), text("source_hash"), _variant_words(v).alias("words"), _variant_segments(v).alias("segments"), events.alias("audio_events"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of any known layout, one a file; the others are rows of ``rejects``."""
    return parse_transcripts(_whole_files(spark, path))


def audio_events(transcripts: DataFrame, media: str = "media") -> DataFrame:
    """(media, event, text, start_ms, end_ms, type): what is heard beside speech. Entries of ``words`` that say so
    count as well, after those of ``audio_events``; events without a start are left out, a missing end is the start."""
    none = F.expr("CAST(ARRAY() AS ARRAY<STRUCT<text: STRING, start: DOUBLE, end: DOUBLE, type: STRING>>)")
    among = F.transform(F.filter(F.coalesce("words", F.expr(f"CAST(ARRAY() AS ARRAY<{WORD}>)")), lambda w: w["type"] == "audio_event"), lambda w: F.struct(F.coalesce(w["text"], w["word"]).alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["type"].alias("type")))
    rows = transcripts.select(media, F.posexplode(F.concat(F.coalesce("audio_events", none), among)).alias("event", "e")).where("e.start IS NOT NULL")
    return rows.select(media, "event", "e.text", ms(F.col("e.start")).alias("start_ms"), ms(F.coalesce("e.end", "e.start")).alias("end_ms"), F.coalesce("e.type", F.lit("audio_event")).alias("type"))


def transcript_words(transcripts: DataFrame, media: str = "media") -> DataFrame:
    """(media, pos, word, start_ms, end_ms, speaker, type): flat words win over those of segments; words without
    start or end are dropped; ``text`` counts as word, ``speaker_id`` as speaker."""
    none = F.expr(f"CAST(ARRAY() AS ARRAY<{WORD}>)")
    inner = lambda segments: F.flatten(F.transform(F.coalesce(segments, F.expr("CAST(ARRAY() AS ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, speaker_id: STRING, words: ARRAY<" + WORD + ">>>)")), lambda s: F.coalesce(s["words"], none)))
    # Inside one value, as an exploded expression is worked out again wherever it is named.
    given = F.array(F.struct(F.coalesce("words", none).alias("words"), F.col("segments").alias("segments")))
    words = F.transform(given, lambda t: F.when(F.size(t["words"]) > 0, t["words"]).otherwise(inner(t["segments"])))[0]
    rows = transcripts.select(media, F.posexplode(words).alias("pos", "w")).where("w.start IS NOT NULL AND w.end IS NOT NULL")
    return rows.select(media, "pos", F.coalesce("w.word", "w.text").alias("word"), ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"), F.coalesce("w.speaker", "w.speaker_id").alias("speaker"), F.col("w.type").alias("type"))


def words_between(transcripts: DataFrame, start_ms: Column | int, end_ms: Column | int, media: str = "media") -> DataFrame:
    """(media, pos, word, start_ms, end_ms) of the words that overlap a span: a missing start counts as 0, a missing
    end as the start."""
    begin = lambda w: F.coalesce(w["start"], F.lit(0.0))
    whole = lambda w: w.withField("end", F.coalesce(w["end"], begin(w))).withField("start", begin(w))
    none = F.expr(f"CAST(ARRAY() AS ARRAY<{WORD}>)")
    filled = transcripts.withColumn("words", F.transform(F.coalesce("words", none), whole)).withColumn("segments", F.transform("segments", lambda s: s.withField("words", F.transform(F.coalesce(s["words"], none), whole))))
    bound = lambda x: F.lit(x) if isinstance(x, int) else x
    return transcript_words(filled, media).where((F.col("end_ms") > bound(start_ms)) & (F.col("start_ms") < bound(end_ms))).drop("speaker", "type")


def spoken(words: DataFrame) -> DataFrame:
    """The words among typed entries: spacing and audio events are no words; entries without a type are."""
    return words.where("type IS NULL OR type = 'word'")


def full_text(segments: DataFrame, media: str = "media", order: str = "segment") -> DataFrame:
    """(media, text): the segments' texts that are not blank, joined by a space."""
    at = F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct(F.col(order), F.trim("text").alias("t")))))
    return segments.groupBy(media).agg(F.array_join(F.transform(at, lambda x: x["t"]), " ").alias("text"))


def transcript_segments(transcripts: DataFrame, media: str = "media") -> DataFrame:
    """(media, segment, start_ms, end_ms, text, speaker, words) in the form of ``folds.captions``."""
    rows = transcripts.select(media, F.posexplode("segments").alias("segment", "s"))
    timed = F.transform(F.filter(F.coalesce("s.words", F.expr(f"CAST(ARRAY() AS ARRAY<{WORD}>)")), lambda w: w["start"].isNotNull() & w["end"].isNotNull()), lambda w: F.struct(F.coalesce(w["word"], w["text"]).alias("word"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms")))
    return rows.select(media, "segment", ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"), F.trim("s.text").alias("text"), F.col("s.speaker_id").alias("speaker"), timed.alias("words"))


def tuple_segments(rows: DataFrame, column: str = "segment") -> DataFrame:
    """Segments given as JSON arrays [start_ms, end_ms, text]: adds start_ms, end_ms, text (null if malformed)."""
    parts = F.from_json(column, "array<string>")
    ok = F.size(parts) >= 3
    return rows.withColumns({"start_ms": F.when(ok, F.try_element_at(parts, F.lit(1)).try_cast("long")), "end_ms": F.when(ok, F.try_element_at(parts, F.lit(2)).try_cast("long")), "text": F.when(ok, F.trim(F.try_element_at(parts, F.lit(3))))})


def parse_srt(documents: DataFrame, column: str = "value", media: str = "media") -> DataFrame:
    """(media, block, cue, start_ms, end_ms, text, error) of SRT texts: blocks split at blank lines."""
    body = F.replace(F.replace(F.regexp_replace(column, "^﻿", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # A block's lines and times are worked out before it becomes a row: columns and filters below name them many times.
    parted = F.transform(F.filter(F.split(F.trim(body), r"\n\s*\n"), lambda b: F.trim(b) != ""), lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    split = F.transform(parted, lambda l: F.struct(l.alias("l"), F.split(F.try_element_at(l, F.lit(2)), r"\s*-->\s*").alias("t")))
    time = lambda b, k: X.parse_srt_time(F.try_element_at(b["t"], F.lit(k)))
    timed = F.transform(split, lambda b: F.struct(b["l"].alias("l"), time(b, 1).alias("start_ms"), time(b, 2).alias("end_ms")))
    blocks = documents.select(media, F.posexplode(timed).alias("block", "b")).select(media, "block", "b.*")
    lines = F.col("l")
    rows = blocks.select(media, "block", F.try_element_at(lines, F.lit(1)).try_cast("int").alias("cue"), "start_ms", "end_ms", F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), " ").alias("text"), F.size(lines).alias("n"))
    error = F.when(F.col("n") < 3, "a block needs an index, times and text").when(F.col("cue").isNull(), "the index is not a number").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "malformed times")
    return rows.withColumn("error", error).drop("n")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(spark.read.text(path, wholetext=True).withColumn("media", F.col("_metadata.file_path")))


def edl_sources(edls: DataFrame, key: str = "edl") -> DataFrame:
    """(edl, source, path): sources given as an object, or as a list whose names are the base names."""
    as_map = F.from_json("sources", "map<string,string>")
    as_list = F.from_json("sources", "array<string>")
    entries = F.when(F.ltrim("sources").startswith("["), F.transform(as_list, lambda p: F.struct(X.base_name(p).alias("key"), p.alias("value")))).otherwise(F.map_entries(as_map))
    return edls.select(key, F.explode(entries).alias("e")).select(key, F.col("e.key").alias("source"), F.col("e.value").alias("path"))


def edl_ranges(edls: DataFrame, key: str = "edl") -> DataFrame:
    """(edl, range_idx, source, start_ms, end_ms, grade, edl_grade, beat, quote, reason)."""
    return edls.select(key, F.col("grade").alias("edl_grade"), F.posexplode("ranges").alias("range_idx", "r")).select(key, "range_idx", "r.source", ms(F.col("r.start")).alias("start_ms"), ms(F.col("r.end")).alias("end_ms"), "r.grade", "edl_grade", "r.beat", "r.quote", "r.reason")


def edl_overlays(edls: DataFrame, key: str = "edl") -> DataFrame:
    """(edl, overlay_idx, source, card_type, card_text, counter_start, counter_end, width, height, font_size, start,
    end, x, y, z_order, duration_type)."""
    o = edls.select(key, F.posexplode("overlays").alias("overlay_idx", "o"))
    card = [F.col(f"o.card.{c}") for c in ("counter_start", "counter_end", "width", "height", "font_size")]
    return o.select(key, "overlay_idx", "o.source", F.col("o.card.type").alias("card_type"), F.col("o.card.text").alias("card_text"), *card, "o.start", "o.end", F.col("o.position.x").alias("x"), F.col("o.position.y").alias("y"), "o.z_order", "o.duration_type")


def rough_cut_segments(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """(spec, segment_idx, and the fields of each segment) of rough-cut specs, with the folders they go to."""
    return specs.select(spec, "generated_clips_dir", "text_dir", "manifest_path", "assembly_path", F.posexplode("segments").alias("segment_idx", "s")).select(spec, "generated_clips_dir", "text_dir", "manifest_path", "assembly_path", "segment_idx", "s.*")


def probe(column: Column) -> Column:
    """struct<duration, width, height, fps, has_audio, has_video> of a media probe's JSON; null where it is missing."""
    p = F.from_json(column, PROBE)
    of = lambda kind: F.filter(p["streams"], lambda s: s["codec_type"] == kind)
    video = F.try_element_at(of("video"), F.lit(1))
    rate = F.split(F.coalesce(video["avg_frame_rate"], video["r_frame_rate"]), "/")
    top, low = F.try_element_at(rate, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(rate, F.lit(2)).try_cast("double"), F.lit(1.0))
    size_ok = (video["width"] > 0) & (video["height"] > 0)
    return F.struct(p["format"]["duration"].try_cast("double").alias("duration"), F.when(size_ok, video["width"]).alias("width"), F.when(size_ok, video["height"]).alias("height"), F.when((low != 0) & (top > 0), F.rint(top / low)).cast("int").alias("fps"), (F.size(of("audio")) > 0).alias("has_audio"), (F.size(of("video")) > 0).alias("has_video"))


def frame_stats(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds key and value of lavfi.signalstats.KEY=value lines (the last = splits); other lines are dropped."""
    part = lambda k: F.regexp_extract(column, r"lavfi\.signalstats\.([A-Z]+).*=([^=]*)$", k)
    return lines.withColumns({"key": part(1), "value": F.trim(part(2)).try_cast("double")}).where("key <> '' AND value IS NOT NULL")


def loudness(report: Column) -> Column:
    """The measurement in a tool's report (the text from the first { to the last }), null if a key is missing."""
    found = F.from_json(F.regexp_extract(report, r"(?s)(\{.*\})", 1), LOUDNESS)
    whole = F.lit(True)
    for k in ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset"):
        whole = whole & found[k].isNotNull()
    return F.when(whole, found)


def pcm_samples(content: Column) -> Column:
    """float32 samples of 16-bit little-endian PCM bytes, by an Arrow function."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<i2").astype(np.float32) / 32768)

    return decode(content)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def retry_wait(attempt: Column, retry_after: Column, now: Column | None = None) -> Column:
    """Seconds before another try: what the server asks for, in seconds or as an HTTP date, 60 at most and 0 at
    least, or else 2, 4, 8 and so on."""
    date = F.try_to_timestamp(F.regexp_replace(retry_after, "^[A-Za-z]+, *", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    until = F.unix_timestamp(date) - F.unix_timestamp(now if now is not None else F.current_timestamp())
    asked = F.coalesce(retry_after.try_cast("double"), until.cast("double"))
    return F.when(asked.isNotNull(), F.greatest(F.least(asked, F.lit(60.0)), F.lit(0.0))).otherwise(F.pow(F.lit(2.0), attempt + 1))


def retries(status: Column, attempt: Column, most: int = 3) -> Column:
    """Whether a call is tried again: too many requests or a server's error, three times in all."""
    return ((status == 429) | (status >= 500)) & (attempt + 1 < most)
