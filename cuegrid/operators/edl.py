"""Edit decision lists: range joins with words, snapping and padding, captions on the output timeline, and rules.

Words are joined to ranges by source and overlap. For long sources ``ranges_with_words`` first deals both sides
into buckets of time, so that a range meets only the words near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.operators import islands

PAD_MS = 30
BUCKET_MS = 60_000
ZERO_CAPTION_MS = 400
SUBTITLE_KEYS = ("style", "path", "force_style")
PRESETS = ["subtle", "neutral_punch", "warm_cinematic", "none"]


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether two spans share more than an end."""
    return (end > low) & (start < high)


def ranges_with_words(ranges: DataFrame, words: DataFrame, keys: tuple[str, ...] = ("edl", "range_idx"), bucket_ms: int = BUCKET_MS, source: str = "source") -> DataFrame:
    """Each range (keys, source, start_ms, end_ms) with every word (source, pos, word, word_start, word_end) that
    overlaps it; ranges without words stay, with nulls. ``source`` names what both sides are joined by: names of
    sources hold inside one edit only, so over several edits it must be a column that tells media apart."""
    spread = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor(F.greatest(F.col(e), F.col(s)) / bucket_ms))))
    r = spread(ranges.select(*keys, source, "start_ms", "end_ms"), "start_ms", "end_ms")
    w = spread(words.select(source, "pos", "word", "word_start", "word_end"), "word_start", "word_end")
    near = overlaps(F.col("word_start"), F.col("word_end"), F.col("start_ms"), F.col("end_ms"))
    # A pair meets in each bucket that both touch; the first of them counts.
    first = F.col("_b") == F.greatest(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("word_start") / bucket_ms))
    hits = r.join(w, [source, "_b"]).where(near & first).select(*keys, "pos", "word", "word_start", "word_end")
    return ranges.join(hits, list(keys), "left")


def snapped_and_padded(joined: DataFrame, durations: DataFrame | None = None, keys: tuple[str, ...] = ("edl", "range_idx"), pad_ms: int = PAD_MS, source: str = "source") -> DataFrame:
    """(keys, source, start_ms, end_ms, cut_start, cut_end, n_words) from ``ranges_with_words``: a cut inside a
    word moves to the word's edge, then both ends get the pad, clamped at 0 and at the source's end
    (durations: source, duration_ms; unknown ends clamp nothing). ``source`` as in ``ranges_with_words``."""
    first = F.min_by("word_start", F.struct("pos"))
    last = F.max_by("word_end", F.struct("pos"))
    snapped = joined.groupBy(*keys).agg(F.first(source).alias(source), F.first("start_ms").alias("start_ms"), F.first("end_ms").alias("end_ms"), F.least(F.first("start_ms"), first).alias("s"), F.greatest(F.first("end_ms"), last).alias("e"), F.count("pos").alias("n_words"))
    if durations is not None:
        snapped = snapped.join(durations.select(source, "duration_ms"), source, "left")
    limit = F.col("duration_ms") if durations is not None else F.lit(None).cast("long")
    begin = F.greatest(F.col("s") - pad_ms, F.lit(0))
    end = F.greatest(F.least(F.col("e") + pad_ms, limit), begin)
    return snapped.select(*keys, source, "start_ms", "end_ms", begin.cast("long").alias("cut_start"), end.cast("long").alias("cut_end"), F.col("n_words").cast("long").alias("n_words"))


def master_cues(bounds: DataFrame, joined: DataFrame, edl: str = "edl", order: str = "range_idx") -> DataFrame:
    """(edl, cue, range_idx, chunk, start_ms, end_ms, text): captions of all ranges on the output timeline, two
    words at a time, in order of their start. Ranges of no length have none."""
    placed = islands.output_offsets(bounds.select(edl, order, F.col("cut_start").alias("start_ms"), F.col("cut_end").alias("end_ms")), edl, order).where("end_ms > start_ms").withColumnsRenamed({"start_ms": "cut_start", "end_ms": "cut_end"})
    words = joined.where("pos IS NOT NULL").select(edl, order, "pos", F.trim("word").alias("word"), "word_start", "word_end").where("word <> ''")
    chunked = islands.with_chunk(words, (edl, order))
    grouped = chunked.groupBy(edl, order, "chunk").agg(F.min_by("word_start", "pos").alias("ws"), F.max_by("word_end", "pos").alias("we"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    timed = grouped.join(placed, [edl, order])
    begin = F.greatest(F.col("ws") - F.col("cut_start"), F.lit(0)) + F.col("offset_ms")
    end = F.least(F.col("we"), F.col("cut_end")) - F.col("cut_start") + F.col("offset_ms")
    text = islands.chunk_text(F.transform("w", lambda x: x["word"]), ",;:")
    cues = timed.select(edl, order, "chunk", begin.alias("start_ms"), F.when(end <= begin, begin + ZERO_CAPTION_MS).otherwise(end).alias("end_ms"), text.alias("text"))
    return cues.withColumn("cue", F.row_number().over(W.partitionBy(edl).orderBy("start_ms", order, "chunk")))


def _known_grade(c: Column) -> Column:
    return c.isNull() | (c == "auto") | c.isin(PRESETS) | c.rlike("[=,]")


def range_violations(edls: DataFrame, ranges: DataFrame, sources: DataFrame, key: str = "edl") -> DataFrame:
    """(edl, range_idx, rule, message) of broken rules: range_idx is -1 for rules of the whole list. Rules are
    numbered in the order of checking. ``edls`` has version and grade, and may have the JSON of its fields sources,
    subtitles and overlays; a list's first error is its least of the rules 1 to 4, then the least (range_idx, rule)
    of its ranges, then the least of the rules from 20 on."""
    given = lambda c: F.trim(c) if c in edls.columns else F.lit(None).cast("string")
    bare = F.regexp_replace(F.regexp_replace(given("sources"), r'"(?:[^"\\]|\\.)*"', "s"), r"\s", "")
    subtitles, overlays = given("subtitles"), given("overlays")
    is_object = subtitles.startswith("{")
    wrong = lambda k: is_object & F.array_contains(F.json_object_keys(subtitles), k) & ~subtitles.rlike(rf'"{k}"\s*:\s*"')
    counts = ranges.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    dupes = sources.groupBy(key, "source").count().where("count > 1").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("dupes"))
    heads = edls.join(counts, key, "left").join(dupes, key, "left")
    head_rules = [
        (1, F.col("version").isNull(), "missing version"),
        (2, F.col("version") != 1, "unsupported version"),
        (3, ~bare.rlike(r"^(\{(s:s(,s:s)*)?\}|\[(s(,s)*)?\])$"), "sources must be a list or an object of strings"),
        (3, F.col("dupes").isNotNull(), "duplicate base names in sources"),
        (4, F.coalesce("n", F.lit(0)) == 0, "ranges must not be empty"),
        (20, ~_known_grade(F.col("grade")), "unknown grade of the list"),
        (21, is_object & (F.size(F.array_except(F.json_object_keys(subtitles), F.array(*(F.lit(k) for k in SUBTITLE_KEYS)))) > 0), "unknown keys in subtitles"),
        *((22 + n, wrong(k), f"{k} of subtitles must be a string") for n, k in enumerate(("path", "style", "force_style"))),
        (25, subtitles.rlike(r"^(\[.*|true|false|-?[0-9.eE+-]+)$"), "subtitles must be a path or an object"),
        (26, ~overlays.startswith("["), "overlays must be a list"),
    ]
    named = ranges.join(sources.select(key, "source").distinct().withColumn("_known", F.lit(True)), [key, "source"], "left")
    range_rules = [
        (10, F.col("source").isNull() | F.col("start").isNull() | F.col("end").isNull(), "missing source, start or end"),
        (11, F.col("source").isNotNull() & F.col("_known").isNull(), "source not found"),
        (12, F.isnan("start") | F.isnan("end") | (F.abs("start") == float("inf")) | (F.abs("end") == float("inf")), "start and end must be finite"),
        (13, F.col("end") <= F.col("start"), "end must be greater than start"),
        (14, ~_known_grade(F.col("grade")), "unknown grade"),
    ]
    return _broken(heads.withColumn("range_idx", F.lit(-1)), [key, "range_idx"], head_rules).unionByName(_broken(named, [key, "range_idx"], range_rules))


def overlay_violations(overlays: DataFrame, key: tuple[str, ...] = ("edl", "overlay_idx")) -> DataFrame:
    """(keys, rule, message) for overlays (source, card_type, card_text, counter_start, counter_end, width, height,
    font_size, start, end, duration_type; x, y and z_order as text where they are to be checked). The rules 15 and 16
    come before 12 in the order of checking."""
    c = F.col
    number = lambda k: c(k).cast("string").try_cast("double") if k in overlays.columns else F.lit(0.0)
    no_number = lambda *ks: F.greatest(*(F.lit(0), *((c(k).isNotNull() & number(k).isNull()).cast("int") for k in ks if k in overlays.columns)), F.lit(0)) > 0
    lasts = c("end") - c("start")
    has_source, has_card = c("source").isNotNull(), c("card_type").isNotNull()
    rules = [
        (1, ~has_source & ~has_card, "needs a source or a card"),
        (2, has_source & has_card, "has both a source and a card"),
        (3, ~c("card_type").isin("text", "counter"), "card type must be text or counter"),
        (4, (c("card_type") == "text") & c("card_text").isNull(), "a text card needs text"),
        (5, (c("card_type") == "counter") & (c("counter_start").isNull() | c("counter_end").isNull()), "a counter card needs its start and end"),
        (6, (c("width") <= 0) | (c("height") <= 0), "width and height must be positive"),
        (7, c("font_size") <= 0, "font size must be positive"),
        (8, c("start").isNull() | c("end").isNull(), "missing start or end"),
        (9, (F.abs("start") == float("inf")) | (F.abs("end") == float("inf")) | F.isnan("start") | F.isnan("end"), "start and end must be finite"),
        (10, c("start") < 0, "start must not be negative"),
        (11, c("end") <= c("start"), "end must be greater than start"),
        (12, ~c("duration_type").isin("sync", "beat"), "duration type must be sync or beat"),
        (13, (c("duration_type") == "sync") & ((lasts < 3) | (lasts > 14)), "sync overlays last 3 to 14 s"),
        (14, (c("duration_type") == "beat") & ((lasts < 0.5) | (lasts > 2)), "beat overlays last 0.5 to 2 s"),
        (15, no_number("x", "y"), "position must be numeric"),
        (16, no_number("z_order"), "z_order must be numeric"),
    ]
    return _broken(overlays, list(key), rules)


def payload_violations(expected: DataFrame, actual: DataFrame, key: tuple[str, ...] = ("media", "window_id")) -> DataFrame:
    """(keys, rule, message): a translation payload against the windows it was made for, position by position."""
    e = expected.select(*key, F.col("start_ms").alias("es"), F.col("end_ms").alias("ee"), F.col("source_text").alias("et"), F.lit(True).alias("_e"))
    a = actual.select(*key, "start_ms", "end_ms", "source_text", "translated_text", F.lit(True).alias("_a"))
    rules = [
        (1, F.col("_a").isNull(), "missing window"),
        (2, F.col("_e").isNull(), "unexpected window"),
        (3, (F.col("start_ms") != F.col("es")) | (F.col("end_ms") != F.col("ee")), "times differ"),
        (4, F.col("source_text") != F.col("et"), "source text differs"),
        (5, F.col("_a") & (F.coalesce(F.trim("translated_text"), F.lit("")) == ""), "no translation"),
    ]
    return _broken(e.join(a, list(key), "full"), list(key), rules)


def payload_language_violations(expected: DataFrame, actual: DataFrame, key: str = "media") -> DataFrame:
    """(key, rule, message): the languages (key, source_language, target_language) of payloads against those asked
    for; to be looked at before ``payload_violations``. A language that is not given differs."""
    e = expected.select(key, F.col("source_language").alias("es"), F.col("target_language").alias("et"))
    rules = [
        (1, ~F.col("source_language").eqNullSafe(F.col("es")), "source language differs"),
        (2, ~F.col("target_language").eqNullSafe(F.col("et")), "target language differs"),
    ]
    return _broken(e.join(actual.select(key, "source_language", "target_language"), key), [key], rules)


def payload_count_violations(expected: DataFrame, actual: DataFrame, key: str = "media") -> DataFrame:
    """(key, rule, message) of payloads whose number of windows differs; checked after the languages."""
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    both = n(expected, "ne").join(n(actual, "na"), key, "left")
    return _broken(both, [key], [(3, F.coalesce("na", F.lit(0)) != F.col("ne"), "number of windows differs")])


def missing_overlays(overlays: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("edl", "overlay_idx")) -> DataFrame:
    """(keys, source) of overlays whose source file is not among ``existing`` (path)."""
    return overlays.where("source IS NOT NULL").join(existing.select(F.col("path").alias("source")), "source", "left_anti").select(*keys, "source")


def _broken(df: DataFrame, keys: list[str], rules: list[tuple[int, Column, str]]) -> DataFrame:
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(m).alias("message"))) for n, bad, m in rules)), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.rule", "v.message")


MATCHED = "media-duration-matched-observed-mlx-ten-x-compression"


def timestamp_correction(media: DataFrame) -> DataFrame:
    """Adds factor and reason for media (backend, n_segments, last_end_ms, duration_ms): one backend sometimes
    writes times a tenth of what they are; then all times are to be multiplied by the exact ratio."""
    ratio = F.col("duration_ms") / F.col("last_end_ms")
    near = F.rint(ratio)
    skip = (F.col("backend") != "mlx") | (F.col("n_segments") == 0) | F.col("duration_ms").isNull()
    reason = F.when(skip, F.lit(None).cast("string")).when(F.coalesce("last_end_ms", F.lit(0)) <= 0, "missing-or-invalid-segment-end").when(near == 1, "ratio-close-to-1").when(F.abs(ratio - near) > 0.02, "ratio-not-close-enough-to-integer").when(near != 10, "ratio-does-not-match-observed-mlx-compression").otherwise(MATCHED)
    return media.withColumn("reason", reason).withColumn("factor", F.when(F.col("reason") == MATCHED, ratio).otherwise(F.lit(1.0)))


def corrected_times(segments: DataFrame, media: DataFrame, key: str = "media") -> DataFrame:
    """Segments (key, start_ms, end_ms, words array<struct<..., start_ms, end_ms>>, ...) with all times multiplied by
    their medium's factor (key, factor), in whole milliseconds; other columns and fields stay."""
    scaled = lambda c: F.rint(c * F.col("_factor")).cast("long")
    joined = segments.join(media.select(key, F.col("factor").alias("_factor")), key)
    word = lambda w: w.withField("start_ms", scaled(w["start_ms"])).withField("end_ms", scaled(w["end_ms"]))
    return joined.withColumns({"start_ms": scaled(F.col("start_ms")), "end_ms": scaled(F.col("end_ms")), "words": F.transform("words", word)}).select(*segments.columns)
