"""Render plans: filter strings and argument lists as columns. Nothing here runs a program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.functions import text as X

# Grades by name, and the styles of burnt-in captions.
GRADES = {
    "subtle": "eq=contrast=1.03:saturation=0.98",
    "neutral_punch": "eq=contrast=1.06:brightness=0.0:saturation=1.0,curves=master='0/0 0.25/0.23 0.75/0.77 1/1'",
    "warm_cinematic": "eq=contrast=1.12:brightness=-0.02:saturation=0.88,colorbalance=rs=0.02:gs=0.0:bs=-0.03:rm=0.04:gm=0.01:bm=-0.02:rh=0.08:gh=0.02:bh=-0.05,curves=master='0/0 0.25/0.22 0.75/0.78 1/1'",
    "none": "",
}
# Loudness target, caption styles, picture size and encoding of rough cuts.
LOUDNORM = "loudnorm=I=-14:TP=-1:LRA=11"
FORCE_STYLES = {
    "bold-overlay": "FontName=Helvetica,FontSize=18,Bold=1,PrimaryColour=&H00FFFFFF,OutlineColour=&H00000000,BackColour=&H00000000,BorderStyle=1,Outline=2,Shadow=0,Alignment=2,MarginV=35",
    "natural-sentence": "FontName=Helvetica,FontSize=22,Bold=1,PrimaryColour=&H00FFFFFF,OutlineColour=&H00000000,BackColour=&H00000000,BorderStyle=1,Outline=2,Shadow=0,Alignment=2,MarginV=35",
}
IMAGE_SEGMENT_FILTER = "scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2:black,fps=30"
ROUGH_CUT_CODECS = ("-c:v", "libx264", "-preset", "veryfast", "-crf", "20", "-pix_fmt", "yuv420p", "-c:a", "aac", "-ar", "48000", "-ac", "2")
SILENT_STEREO = "anullsrc=channel_layout=stereo:sample_rate=48000"
FADE_MS = 30


def argv(*items: Column | str) -> Column:
    """An argument list; null items are left out, arrays are spliced in by ``spliced``."""
    return F.array_compact(F.array(*(F.lit(x) if isinstance(x, str) else x for x in items)))


def spliced(*parts: Column) -> Column:
    return F.concat(*parts)


def optional(condition: Column, *items: Column | str) -> Column:
    return F.when(condition, argv(*items)).otherwise(F.expr("CAST(ARRAY() AS ARRAY<STRING>)"))


def resolved_grade(range_grade: Column, edl_grade: Column) -> Column:
    """The range's grade before the list's; names become filters, 'auto' stays for the analysis, others pass."""
    chosen = F.coalesce(range_grade, edl_grade, F.lit("none"))
    known = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, chosen), chosen)


def audio_fades(duration_ms: Column) -> Column:
    """Fades of 30 ms at both ends; '' for what is shorter than two of them."""
    return F.when(duration_ms < 2 * FADE_MS, "").otherwise(F.concat(F.lit("afade=t=in:st=0:d=0.03,afade=t=out:st="), X.seconds_text(duration_ms - FADE_MS), F.lit(":d=0.03")))


def extract_segment(source: Column, start_ms: Column, duration_ms: Column, grade: Column, output: Column, has_audio: Column, quality: str = "final") -> Column:
    """One cut range as a file of its own. quality: draft, preview or final."""
    scale, preset, crf = {"draft": ("1280", "ultrafast", "28"), "preview": ("1920", "medium", "22"), "final": ("1920", "fast", "20")}[quality]
    video = F.concat_ws(",", F.lit(f"scale={scale}:-2"), F.when(grade != "", grade))
    fades = audio_fades(duration_ms)
    return spliced(
        argv("ffmpeg", "-y", "-ss", X.seconds_text(start_ms), "-i", source, "-t", X.seconds_text(duration_ms), "-vf", video),
        optional(has_audio & (fades != ""), "-af", fades),
        F.when(has_audio, argv("-c:a", "aac", "-b:a", "192k", "-ar", "48000")).otherwise(argv("-an")),
        argv("-c:v", "libx264", "-preset", preset, "-crf", crf, "-pix_fmt", "yuv420p", "-movflags", "+faststart", output),
    )


def segment_name(range_idx: Column, source: Column) -> Column:
    return F.concat(F.lit("seg_"), F.when(range_idx < 100, F.lpad(range_idx.cast("string"), 2, "0")).otherwise(range_idx.cast("string")), F.lit("_"), X.stem(source), F.lit(".mp4"))


def concat(manifest: Column, output: Column) -> Column:
    return argv("ffmpeg", "-y", "-f", "concat", "-safe", "0", "-i", manifest, "-c", "copy", "-movflags", "+faststart", output)


def extract_audio(source: Column, output: Column, overwrite: bool = False, transcode: bool = False) -> Column:
    codec = argv("-c:a", "aac", "-b:a", "192k") if transcode else argv("-c:a", "copy")
    return spliced(argv("ffmpeg", "-y" if overwrite else "-n", "-i", source, "-vn"), codec, argv(output))


def extract_pcm(source: Column, output: Column) -> Column:
    return argv("ffmpeg", "-y", "-i", source, "-vn", "-ac", "1", "-ar", "16000", "-c:a", "pcm_s16le", output)


def loudnorm(source: Column, output: Column, measured: Column | None, has_video: Column) -> Column:
    """Two-pass with a measurement (null: single pass)."""
    two = F.concat(F.lit(LOUDNORM), F.lit(":measured_I="), measured["input_i"], F.lit(":measured_TP="), measured["input_tp"], F.lit(":measured_LRA="), measured["input_lra"], F.lit(":measured_thresh="), measured["input_thresh"], F.lit(":offset="), measured["target_offset"], F.lit(":linear=true")) if measured is not None else F.lit(None).cast("string")
    return spliced(argv("ffmpeg", "-y", "-hide_banner", "-nostats", "-i", source), optional(has_video, "-c:v", "copy"), argv("-af", F.coalesce(two, F.lit(LOUDNORM)), "-c:a", "aac", "-b:a", "192k", "-ar", "48000"), optional(F.lower(output).endswith(".mp4"), "-movflags", "+faststart"), argv(output))


def measure_loudness(source: Column) -> Column:
    return argv("ffmpeg", "-hide_banner", "-nostats", "-i", source, "-af", LOUDNORM + ":print_format=json", "-f", "null", "-")


def grade(source: Column, output: Column, filter_string: Column) -> Column:
    """A copy where the filter is empty."""
    fast = optional(X.suffix(output).isin(".mp4", ".m4v", ".mov"), "-movflags", "+faststart")
    made = argv("-vf", filter_string, "-c:v", "libx264", "-preset", "fast", "-crf", "18", "-pix_fmt", "yuv420p", "-c:a", "copy")
    return spliced(argv("ffmpeg", "-y", "-i", source), F.when(filter_string == "", argv("-c", "copy")).otherwise(made), fast, argv(output))


def contact_sheet(source: Column, output: Column, duration: Column, columns: int, rows: int, width: int) -> Column:
    fps = F.when(duration > 0, F.lit(float(columns * rows)) / duration).otherwise(F.lit(1.0))
    return argv("ffmpeg", "-y", "-i", source, "-vf", F.concat(F.lit("fps="), F.format_string("%.8f", fps), F.lit(f",scale={width}:-1,tile={columns}x{rows}")), "-frames:v", "1", output)


def subtitle_filter(srt: Column, style: Column, before: Column | None = None) -> Column:
    """The caption filter, always the last of the chain."""
    burnt = F.concat(F.lit("subtitles='"), X.ass_escape(srt), F.lit("':force_style='"), F.replace(style, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return burnt if before is None else F.when(F.coalesce(before, F.lit("")) != "", F.concat(before, F.lit(","), burnt)).otherwise(burnt)


def early_filter(filters: Column) -> Column:
    """The caption or overlay filter that a chain holds although it has to come later; null if it holds none."""
    at = lambda name: filters.rlike(rf"(^|[\s,;]){name}=")
    return F.when(at("subtitles"), "subtitles").when(at("ass"), "ass").when(at("overlay"), "overlay").when(at("setpts"), "setpts")


def misused_concat(arguments: Column) -> Column:
    """Whether an argument list joins segments by a filter graph and not by the concat demuxer."""
    return F.arrays_overlap(arguments, F.array(F.lit("-filter_complex"), F.lit("-lavfi")))


def image_segment(source: Column, duration: Column, output: Column) -> Column:
    """A still with a silent stereo track."""
    return argv("ffmpeg", "-y", "-loop", "1", "-t", duration, "-i", source, "-f", "lavfi", "-t", duration, "-i", SILENT_STEREO, "-vf", IMAGE_SEGMENT_FILTER, *ROUGH_CUT_CODECS, "-shortest", "-movflags", "+faststart", output)


def card_segment(picture: Column, duration: Column, output: Column) -> Column:
    """A drawn card with a silent stereo track."""
    return argv("ffmpeg", "-y", "-loop", "1", "-t", duration, "-i", picture, "-f", "lavfi", "-t", duration, "-i", SILENT_STEREO, "-vf", "fps=30,format=yuv420p", *ROUGH_CUT_CODECS, "-shortest", output)


def clip_segment(source: Column, start: Column, end: Column, output: Column, has_audio: Column) -> Column:
    """A cut of a clip with fades; clips without sound get a silent track."""
    lasts = X.parse_time(end.cast("string")) - X.parse_time(start.cast("string"))
    fades = F.concat(F.lit("afade=t=in:st=0:d=0.03,afade=t=out:st="), (lasts - FADE_MS / 1000).cast("string"), F.lit(":d=0.03"))
    return spliced(
        argv("ffmpeg", "-y", "-ss", start.cast("string"), "-to", end.cast("string"), "-i", source),
        optional(~has_audio, "-f", "lavfi", "-i", SILENT_STEREO),
        argv("-vf", IMAGE_SEGMENT_FILTER),
        optional(has_audio & (lasts >= 2 * FADE_MS / 1000), "-af", fades),
        argv(*ROUGH_CUT_CODECS, "-movflags", "+faststart"),
        optional(~has_audio, "-shortest"),
        argv(output),
    )


def rough_cut_segment(kind: Column, source: Column, picture: Column, start: Column, end: Column, duration: Column, output: Column, has_audio: Column) -> Column:
    """The argument list of a segment by its type; null for a type that is not known."""
    return F.when(kind == "card", card_segment(picture, duration, output)).when(kind == "image", image_segment(source, duration, output)).when(kind == "clip", clip_segment(source, start, end, output, has_audio))


def rough_cut_concat(manifest: Column, output: Column) -> Column:
    """Joins the segments of a rough cut, encoded anew."""
    return argv("ffmpeg", "-y", "-fflags", "+genpts", "-f", "concat", "-safe", "0", "-i", manifest, *ROUGH_CUT_CODECS, "-movflags", "+faststart", output)


def frame_picture(source: Column, at: Column, output: Column) -> Column:
    """One frame at a time in seconds, 320 pixels wide."""
    return argv("ffmpeg", "-y", "-ss", F.format_string("%.3f", at), "-i", source, "-frames:v", "1", "-q:v", "4", "-vf", "scale=320:-2", output)


def timeline_sound(source: Column, start: Column, end: Column, output: Column) -> Column:
    """The sound of a span as 16-bit mono PCM."""
    return argv("ffmpeg", "-y", "-ss", F.format_string("%.3f", start), "-i", source, "-t", F.format_string("%.3f", end - start), "-vn", "-ac", "1", "-ar", "16000", "-c:a", "pcm_s16le", output)


def copied(source: Column, output: Column) -> Column:
    """A copy of the streams; null where source and output are the same."""
    made = spliced(argv("ffmpeg", "-y", "-i", source, "-c", "copy"), optional(X.suffix(output) == ".mp4", "-movflags", "+faststart"), argv(output))
    return F.when(source != output, made)


def burn_in(source: Column, output: Column, filters: Column, overwrite: bool = False) -> Column:
    """Captions burnt into a video; ``filters`` is the chain of ``subtitle_filter``."""
    return argv("ffmpeg", *(["-y"] if overwrite else []), "-i", source, "-vf", filters, "-c:v", "libx264", "-preset", "veryfast", "-crf", "20", "-pix_fmt", "yuv420p", "-c:a", "copy", "-movflags", "+faststart", output)


def card_text(header: Column, meta: Column, body: Column) -> Column:
    """The parts that are not blank, with a blank line between."""
    return F.concat_ws("\n\n", *(F.when(F.trim(c) != "", F.trim(c)) for c in (header, meta, body)))


def overlay_parts(overlays: DataFrame, edl: str = "edl", base_width: int | None = None, base_fps: int = 30) -> DataFrame:
    """(edl, idx, prepare, compose): the two filters of each overlay (edl, idx from 1, path, start_ms, end_ms, x, y,
    z_order). Overlays are composed by rising z_order, equal ones by idx; each reads the label of the one below."""
    w = W.partitionBy(edl).orderBy(F.coalesce("z_order", F.lit(0.0)), "idx")
    idx = F.col("idx").cast("string")
    scale = F.lit(f"scale={base_width // 2 * 2}:-2" if base_width else "scale='trunc(iw/2)*2:trunc(ih/2)*2'")
    steps = F.concat_ws(",", F.when(X.media_kind(F.col("path")) == "image", F.lit(f"fps={base_fps}")), scale, F.lit("format=yuva420p"), F.concat(F.lit("setpts=PTS-STARTPTS+"), X.seconds_text(F.col("start_ms")), F.lit("/TB")))
    below = F.coalesce(F.concat(F.lit("[v"), F.lag("idx").over(w).cast("string"), F.lit("]")), F.lit("[0:v]"))
    place = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("string")
    compose = F.concat(below, F.lit("[a"), idx, F.lit("]overlay=enable='between(t,"), X.seconds_text(F.col("start_ms")), F.lit(","), X.seconds_text(F.col("end_ms")), F.lit(")':eof_action=pass:x="), place(F.col("x")), F.lit(":y="), place(F.col("y")), F.lit("[v"), idx, F.lit("]"))
    return overlays.select(edl, "idx", F.row_number().over(w).alias("rank"), F.concat(F.lit("["), idx, F.lit(":v]"), steps, F.lit("[a"), idx, F.lit("]")).alias("prepare"), compose.alias("compose"))


def overlay_graph(parts: DataFrame, edl: str = "edl", subtitles: Column | None = None) -> DataFrame:
    """(edl, filter_complex): all overlays, then the captions (a filter string, an aggregate over the rows of parts;
    null: none), to [outv]."""
    one = lambda key, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(c).alias("t")))), lambda x: x["t"]), ";")
    burnt = subtitles if subtitles is not None else F.max(F.lit(None).cast("string"))
    packed = parts.groupBy(edl).agg(one("idx", "prepare").alias("p"), one("rank", "compose").alias("c"), F.max_by("idx", "rank").alias("top"), burnt.alias("burnt"))
    last = F.concat(F.lit("[v"), F.col("top").cast("string"), F.lit("]"), F.coalesce("burnt", F.lit("null")), F.lit("[outv]"))
    return packed.select(edl, F.concat_ws(";", "p", "c", last).alias("filter_complex"))


def overlay_inputs(overlays: DataFrame, edl: str = "edl") -> DataFrame:
    """(edl, inputs): the input arguments of all overlays (edl, idx, path) in order; stills are looped."""
    one = F.when(X.media_kind(F.col("path")) == "image", F.array(F.lit("-loop"), F.lit("1"), F.lit("-i"), F.col("path"))).otherwise(F.array(F.lit("-i"), F.col("path")))
    listed = F.sort_array(F.collect_list(F.struct("idx", one.alias("a"))))
    return overlays.groupBy(edl).agg(F.flatten(F.transform(listed, lambda x: x["a"])).alias("inputs"))


def composite(base: Column, inputs: Column, graph: Column, duration: Column, output: Column) -> Column:
    """The pass that lays overlays over a video; ``inputs`` is the argument list of their inputs, a null duration ends
    with the shortest."""
    length = F.when(duration.isNotNull(), argv("-t", F.format_string("%.3f", duration))).otherwise(argv("-shortest"))
    return spliced(argv("ffmpeg", "-y", "-i", base), inputs, argv("-filter_complex", graph, "-map", "[outv]", "-map", "0:a?"), length, argv("-c:v", "libx264", "-preset", "veryfast", "-crf", "20", "-pix_fmt", "yuv420p", "-c:a", "copy", "-movflags", "+faststart", output))


def final_pass(base: Column, inputs: Column, graph: Column, captions: Column, duration: Column, output: Column) -> Column:
    """The last pass of an edit: overlays (inputs and graph, null if there are none) with captions in their graph, or
    captions alone (a filter chain, null if there are none), or a copy, null where that is the same file."""
    return F.when(inputs.isNotNull(), composite(base, inputs, graph, duration, output)).when(captions.isNotNull(), burn_in(base, output, captions, overwrite=True)).otherwise(copied(base, output))


def sample_stats(source: Column, start_ms: Column, duration_ms: Column, fps: Column, report: Column) -> Column:
    path = F.replace(F.replace(report, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return argv("ffmpeg", "-y", "-hide_banner", "-nostats", "-ss", X.seconds_text(start_ms), "-i", source, "-t", X.seconds_text(duration_ms), "-vf", F.concat(F.lit("fps="), F.format_string("%.2f", fps), F.lit(",signalstats,metadata=print:file="), path), "-f", "null", "-")


# The timeline picture's layout in pixels.
CANVAS, MARGIN, STRIP_Y, FRAME_HEIGHT, FRAME_GAP, FRAME_MIN_WIDTH, WAVE_HEIGHT = 1920, 50, 50, 180, 4, 10, 220


def capped_frames(n: Column, width: int = CANVAS - 2 * MARGIN) -> Column:
    return F.least(n, F.greatest(F.lit(1), F.lit(width // (FRAME_MIN_WIDTH + FRAME_GAP))))


def time_to_x(t: Column, start: Column, end: Column, width: int = CANVAS - 2 * MARGIN, left: int = MARGIN) -> Column:
    """A time's place on the strip, cut to whole pixels. Whole times are multiplied before they are divided, so that a
    place on a pixel's edge is not rounded below it."""
    return (F.lit(left) + (t - start) * width / F.greatest(end - start, F.lit(1e-6))).cast("int")


def timeline_layout(frame_height: Column, wave_height: Column) -> Column:
    """struct of the vertical places of a timeline picture."""
    wave = STRIP_Y + frame_height + 20
    ruler = wave + wave_height + 2
    return F.struct(F.lit(STRIP_Y).alias("filmstrip_y"), frame_height.alias("frame_height"), wave.alias("wave_y"), wave_height.alias("waveform_height"), ruler.alias("ruler_y"), (ruler + 24).alias("label_y"), (ruler + 64).alias("canvas_height"))


def ruler_ticks(start: Column, end: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: start + (end - start) * k / 6)


def ruler(start: Column, end: Column, width: int = CANVAS - 2 * MARGIN) -> Column:
    """array<struct<x, label>> of the seven ticks."""
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct((MARGIN + (k / F.lit(6) * width).cast("int")).alias("x"), F.format_string("%.2fs", start + k / F.lit(6) * (end - start)).alias("label")))


def word_labels(words: DataFrame, spans: DataFrame, key: str = "media", spacing: int = 28, least_ms: int = 50) -> DataFrame:
    """(key, labels array<struct<pos, x, word>>): the word labels that fit over a span's (key, start_ms, end_ms)
    waveform: not blank, ``least_ms`` long, ``spacing`` pixels from the last one placed."""
    s = spans.select(key, F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    near = words.join(s, key).where((F.trim("word") != "") & (F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.col("end_ms") > F.col("s0")) & (F.col("start_ms") < F.col("s1")))
    x = F.floor((time_to_x(F.col("start_ms"), F.col("s0"), F.col("s1")) + time_to_x(F.col("end_ms"), F.col("s0"), F.col("s1"))) / 2).cast("int")
    listed = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", x.alias("x"), F.trim("word").alias("word")))).alias("w"))
    start = F.struct(F.lit(-9999).alias("last"), F.filter("w", lambda _: F.lit(False)).alias("kept"))
    step = lambda a, w: F.when(w["x"] - a["last"] < spacing, a).otherwise(F.struct(w["x"].alias("last"), F.array_append(a["kept"], w).alias("kept")))
    return listed.select(key, F.aggregate("w", start, step)["kept"].alias("labels"))


def span_violation(start: Column, end: Column, duration: Column) -> Column:
    """Why a span of a medium cannot be drawn (seconds); null if it can. Its end is cut to the duration."""
    return F.when(start < 0, "start must not be negative").when(end <= start, "end must be greater than start").when(start >= duration, "start is beyond the medium's end")


def sheet_violation(columns: Column, rows: Column, width: Column) -> Column:
    return F.when((columns <= 0) | (rows <= 0), "columns and rows must be positive").when(width <= 0, "width must be positive")
