"""Column expressions for texts and timecodes. Times are whole milliseconds (BIGINT) unless a name says seconds.

Null in, null out, unless stated. All expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation classes of captions.
HARD_PUNCTUATION = ".!?。！？"
SOFT_PUNCTUATION = ";:;,，、"
CLOSERS = "\"')]}”’"
CAPTION_BREAKS = ".,!?;:"
STRONG_BREAKS = ".?!;:,"


def char_class(characters: str) -> str:
    """A regular expression class of exactly these characters."""
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in characters) + "]"


def collapse_whitespace(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words of a text; an empty array for a blank text."""
    return F.filter(F.split(collapse_whitespace(c), " "), lambda w: w != "")


def join_phrase(words: Column) -> Column:
    """Words joined by a space, none before , . ? or !."""
    stripped = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    return F.regexp_replace(F.array_join(stripped, " "), r" ([,.?!])", "$1")


def count_spoken(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.trim(w) != ""))


def sentence_case(c: Column) -> Column:
    """The first letter upper-case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def ends_sentence(c: Column) -> Column:
    """Whether a text ends with hard punctuation, closing quotes and brackets aside."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+$", ""), char_class(CLOSERS) + "+$", "")
    return bare.rlike(char_class(HARD_PUNCTUATION) + "$")


def uses_spaces(c: Column) -> Column:
    return c.rlike(r"(?U)\s")


def block_weight(c: Column) -> Column:
    """Characters without white space, 1 at least."""
    return F.greatest(F.length(F.regexp_replace(c, r"(?U)\s", "")), F.lit(1))


def preferred_break(word: Column, gap_to_next_ms: Column) -> Column:
    """A good place for a caption to end after a word: the last word (null gap), punctuation, or a pause of 450 ms."""
    return gap_to_next_ms.isNull() | F.rtrim(word).rlike(char_class(STRONG_BREAKS) + "$") | (gap_to_next_ms >= 450)


def _two(c: Column) -> Column:
    return F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))


def timecode(ms: Column, point: str = ".") -> Column:
    """HH:MM:SS.mmm of whole milliseconds; carries are exact."""
    ms = ms.cast("long")
    part = lambda q, m: F.floor(ms / q).cast("long") % m
    return F.concat(_two(F.floor(ms / 3_600_000).cast("long")), F.lit(":"), _two(part(60_000, 60)), F.lit(":"), _two(part(1000, 60)), F.lit(point), F.lpad((ms % 1000).cast("string"), 3, "0"))


def srt_time(ms: Column) -> Column:
    return timecode(ms, ",")


def srt_time_seconds(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds: total milliseconds rounded half to even."""
    return srt_time(F.rint(seconds * 1000).cast("long"))


def srt_time_uncarried(seconds: Column) -> Column:
    """The form whose milliseconds carry into the seconds but not on into the minutes: 59.9996 gives 00:00:60,000."""
    whole = F.floor(seconds).cast("long")
    ms = F.rint((seconds - whole) * 1000).cast("long")
    s = whole % 60 + F.when(ms == 1000, 1).otherwise(0)
    return F.concat(_two(F.floor(whole / 3600).cast("long")), F.lit(":"), _two(F.floor(whole / 60).cast("long") % 60), F.lit(":"), _two(s), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parse_srt_time(c: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm, as ``srt_time`` writes it: from 100 hours on with more digits; null for anything else."""
    g = lambda k: F.regexp_extract(c, r"^(\d{2,9}):(\d{2}):(\d{2}),(\d{3})$", k).cast("long")
    return F.when(c.rlike(r"^\d{2,9}:\d{2}:\d{2},\d{3}$"), ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + g(4))


def parse_time(c: Column) -> Column:
    """Seconds (double) of S, M:S or H:M:S; null for anything else."""
    p = F.split(F.trim(c), ":")
    at = lambda k: F.try_element_at(p, F.lit(k)).try_cast("double")
    return F.when(F.size(p) == 1, at(1)).when(F.size(p) == 2, at(1) * 60 + at(2)).when(F.size(p) == 3, at(1) * 3600 + at(2) * 60 + at(3))


def seconds_text(ms: Column) -> Column:
    """Seconds with three places, from whole milliseconds."""
    ms = ms.cast("long")
    return F.concat(F.floor(ms / 1000).cast("long").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def even_slice(start: Column, end: Column, k: Column, n: Column) -> Column:
    """Start of slice k of n equal slices of [start, end], rounded half up; k = n gives end."""
    return (start + F.floor((2 * (end - start) * k + n) / (2 * n))).cast("long")


def ass_escape(c: Column) -> Column:
    """A path inside a filter argument. The backslash comes first."""
    for mark in "\\:,'[]%;":
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def quote_concat_path(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path's last part, with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def normal_path(path: Column) -> Column:
    """An absolute path without empty, . and .. parts."""
    empty = F.expr("CAST(ARRAY() AS ARRAY<STRING>)")
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", up(kept)).otherwise(F.array_append(kept, part))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^/])\.[^.]*$", "")


# Suffixes by kind of media.
VIDEO_SUFFIXES = [".avi", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".webm"]
AUDIO_SUFFIXES = [".aac", ".aif", ".aiff", ".flac", ".m4a", ".mp3", ".ogg", ".wav"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tiff", ".tif"]


def media_kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(VIDEO_SUFFIXES), "video").when(s.isin(AUDIO_SUFFIXES), "audio").when(s.isin(IMAGE_SUFFIXES), "image").otherwise("other")


def output_paths(path: Column, folder: Column | None = None) -> Column:
    """struct<audio, txt, srt, json>: what a recording's captions are written to, in a folder or beside it; the audio
    of a recording is itself. Null for what is neither video nor audio."""
    kind, base = media_kind(path), stem(path)
    to = folder if folder is not None else F.regexp_replace(path, "/[^/]*$", "")
    made = lambda ending: F.concat(to, F.lit("/"), base, F.lit(ending))
    return F.when(kind.isin("video", "audio"), F.struct(F.when(kind == "video", made(".m4a")).otherwise(path).alias("audio"), made(".txt").alias("txt"), made(".srt").alias("srt"), made(".json").alias("json")))


def register(spark) -> None:
    """The expressions that SQL text can use, as functions of the session."""
    q = r"""
    CREATE OR REPLACE TEMPORARY FUNCTION cue_collapse(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '(?U)\\s+', ' '));
    CREATE OR REPLACE TEMPORARY FUNCTION cue_timecode(ms BIGINT) RETURNS STRING RETURN concat(lpad(ms div 3600000, greatest(2, length(ms div 3600000)), '0'), ':', lpad(ms div 60000 % 60, 2, '0'), ':', lpad(ms div 1000 % 60, 2, '0'), '.', lpad(ms % 1000, 3, '0'));
    CREATE OR REPLACE TEMPORARY FUNCTION cue_srt_time(ms BIGINT) RETURNS STRING RETURN replace(cue_timecode(ms), '.', ',');
    CREATE OR REPLACE TEMPORARY FUNCTION cue_overlaps(s BIGINT, e BIGINT, t0 BIGINT, t1 BIGINT) RETURNS BOOLEAN RETURN e > t0 AND s < t1
    """
    for statement in q.split(";\n"):
        spark.sql(statement.strip())
