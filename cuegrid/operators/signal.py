"""Signal analytics over decoded arrays: envelopes, pops at cuts, frame differences, grades, and reports of checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of the checks.
DURATION_TOLERANCE, VISUAL_LIMIT, POP_LIMIT, QUIET, GRADE_LIMIT = 0.5, 0.25, 0.80, 0.05, 0.15
CUT_TOLERANCE = 0.01


def windowed_rms(samples: Column, bins: int) -> Column:
    """Root mean square of ``bins`` whole windows of max(1, n div bins) samples; what is left over is ignored, and
    missing windows are 0."""
    n = F.size(samples)
    width = F.greatest(F.floor(n / bins), F.lit(1)).cast("int")
    part = lambda k: F.slice(samples, k * width + 1, width)
    energy = lambda k: F.sqrt(F.aggregate(part(k), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / width)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.when((k + 1) * width <= n, energy(k)).otherwise(F.lit(0.0)))


def envelope(samples: Column, bins: int) -> Column:
    """struct<bins, raw_peak>: windowed RMS over its largest value (as is if that is 0)."""
    rms = windowed_rms(samples, bins)
    peak = F.coalesce(F.array_max(rms), F.lit(0.0))
    return F.struct(F.when(peak > 0, F.transform(rms, lambda x: x / peak)).otherwise(rms).alias("bins"), peak.alias("raw_peak"))


def frame_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference over the common length; null if one is null or empty."""
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total / n)


def with_next(rows: DataFrame, key: str, order: str, value: str, step: int, name: str = "next") -> DataFrame:
    """Adds the value of the next row of the same key, in the order of a whole number (null for the last). Rows are
    dealt into steps of that number, so a key of very many rows is many tasks; a step's last row gets the first
    value of the key's next step, and only those go through one window for each key."""
    at = F.floor(F.col(order) / step).cast("long")
    dealt = rows.withColumn("_step", at)
    first = dealt.groupBy(key, "_step").agg(F.min_by(F.struct(value), order).alias("_first"))
    after = first.select(F.col(key).alias("_key"), F.col("_step").alias("_at"), F.lead("_first").over(W.partitionBy(key).orderBy("_step")).alias("_after"))
    inside = W.partitionBy(key, "_step").orderBy(order)
    ahead = dealt.withColumn("_next", F.lead(F.struct(value)).over(inside))
    joined = ahead.join(after, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_step") == F.col("_at")), "left")
    return joined.withColumn(name, F.coalesce("_next", "_after")[value]).select(*rows.columns, name)


def signal_stats(frames: DataFrame, clip: str = "clip") -> DataFrame:
    """(clip, y_mean, y_range, sat_mean) from (clip, line_no, key, value); neutral values without any YAVG."""
    mean = lambda k: F.avg(F.when(F.col("key") == k, F.col("value")))
    depth = F.coalesce(F.max_by("value", F.when(F.col("key") == "YBITDEPTH", F.col("line_no"))), F.lit(8.0))
    top = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), depth) - 1)
    found = frames.groupBy(clip).agg(mean("YAVG").alias("a"), mean("YMIN").alias("l"), mean("YMAX").alias("h"), mean("SATAVG").alias("s"), top.alias("top"))
    some = F.col("a").isNotNull()
    return found.select(clip, F.when(some, F.col("a") / F.col("top")).otherwise(0.5).alias("y_mean"), F.when(some, (F.col("h") - F.col("l")) / F.col("top")).otherwise(0.7).alias("y_range"), F.when(some, F.coalesce("s", F.lit(0.0)) / F.col("top")).otherwise(0.25).alias("sat_mean"))


def _ramp(x: Column, low: float, span: float) -> Column:
    return F.least(F.greatest((x - low) / span, F.lit(0.0)), F.lit(1.0))


def grade_factors(y_mean: Column, y_range: Column, sat: Column) -> dict[str, Column]:
    """contrast, gamma and saturation factors, each within 0.92 to 1.08; 1 where the footage needs nothing."""
    one, step = F.lit(1.0), 0.08
    contrast = F.when(y_range < 0.65, 1.08 - step * _ramp(y_range, 0.40, 0.25)).otherwise(one)
    gamma = F.when(y_mean < 0.42, 1.08 - step * _ramp(y_mean, 0.30, 0.12)).when(y_mean > 0.60, 1.0 - step * _ramp(y_mean, 0.60, 0.20)).otherwise(one)
    saturation = F.when(sat < 0.15, 1.08 - step * _ramp(sat, 0.05, 0.10)).when(sat > 0.40, 1.0 - step * _ramp(sat, 0.40, 0.15)).otherwise(one)
    return {k: F.least(F.greatest(v, F.lit(0.92)), F.lit(1.08)) for k, v in (("contrast", contrast), ("gamma", gamma), ("saturation", saturation))}


def grade_filter(y_mean: Column, y_range: Column, sat: Column) -> Column:
    """The filter string of the factors that move by more than 0.005; '' if none does."""
    parts = [F.when(F.abs(v - 1) > 0.005, F.concat(F.lit(f"{k}="), F.format_string("%.3f", v))) for k, v in grade_factors(y_mean, y_range, sat).items()]
    text = F.concat_ws(":", *parts)
    return F.when(text == "", "").otherwise(F.concat(F.lit("eq="), text))


def sampling_fps(duration: Column, samples: int = 10) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(samples) / F.greatest(duration, F.lit(0.1)), F.lit(10.0)))


def grade_sample_times(duration: Column) -> Column:
    return F.array(F.least(F.lit(1.0), 0.1 * duration), duration / 4, duration / 2, 3 * duration / 4, F.greatest(duration - 1, 0.9 * duration))


def frame_times(start: Column, end: Column, n: int) -> Column:
    """n times from start to end, both included; the middle for one."""
    if n <= 1:
        return F.array((start + end) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + (end - start) * k / (n - 1))


def grade_consistency(samples: DataFrame, media: str = "media", order: str = "sample", value: str = "luminance", limit: float = GRADE_LIMIT) -> DataFrame:
    """(media, max_delta, first, second, passed): the largest difference between two samples, and the first such
    pair in order. It lies between extremes, so two aggregates over the samples find it without a self join or lists."""
    ends = samples.groupBy(media).agg(F.max(value).alias("_high"), F.min(value).alias("_low"))
    first = lambda c: F.min(F.when(F.col(value) == F.col(c), F.col(order)))
    found = samples.join(ends, media).groupBy(media).agg((F.max("_high") - F.min("_low")).alias("max_delta"), first("_high").alias("hi"), first("_low").alias("lo"))
    # The first pair in (i, j) order is that of the first samples at both ends.
    apart = F.col("max_delta") != 0
    return found.select(media, "max_delta", F.when(apart, F.least("hi", "lo")).alias("first"), F.when(apart, F.greatest("hi", "lo")).alias("second"), (F.col("max_delta") <= limit).alias("passed"))


def pop_check(envelope_bins: Column, raw_peak: Column, cut: Column, bins: int = 500, around: float = 1.5, near: float = 0.5) -> Column:
    """struct<passed, severity, loudest> of the envelope over [max(0, cut - 1.5), cut + 1.5]: no bin within half a
    second of the cut may pass 0.80 of the peak, unless all is quiet."""
    start, end = F.greatest(cut - around, F.lit(0.0)), cut + around
    at = lambda t: F.least(F.greatest(((t - start) / (end - start) * bins).cast("int"), F.lit(0)), F.lit(bins))
    low, high = at(cut - near), at(cut + near)
    loudest = F.array_max(F.slice(envelope_bins, low + 1, F.greatest(high - low, F.lit(0))))
    quiet = raw_peak < QUIET
    return F.struct(F.when(loudest.isNull(), False).otherwise(quiet | (loudest <= POP_LIMIT)).alias("passed"), F.when(loudest.isNull(), "warning").when(quiet, "info").when(loudest <= POP_LIMIT, "info").otherwise("fail").alias("severity"), loudest.alias("loudest"))


def duration_check(actual: Column, expected: Column) -> Column:
    """struct<passed, severity>: within half a second; a missing expectation only warns."""
    off = F.abs(actual - expected) <= DURATION_TOLERANCE
    return F.struct(F.coalesce(off, F.lit(False)).alias("passed"), F.when(expected.isNull(), "warning").when(off, "info").otherwise("fail").alias("severity"))


def visual_check(delta: Column) -> Column:
    return F.struct(F.coalesce(delta <= VISUAL_LIMIT, F.lit(False)).alias("passed"), F.when(delta.isNull(), "warning").when(delta <= VISUAL_LIMIT, "info").otherwise("fail").alias("severity"))


def report(findings: DataFrame, media: str = "media") -> DataFrame:
    """(media, n_passed, n_failed, n_warnings, passed) over (media, check, passed, severity)."""
    failed = ~F.col("passed") & (F.col("severity") == "fail")
    return findings.groupBy(media).agg(F.count_if("passed").alias("n_passed"), F.count_if(failed).alias("n_failed"), F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("n_warnings")).withColumn("passed", F.col("n_failed") == 0)


def luminance(pixels: Column) -> Column:
    """Mean of a frame's 8-bit channel values, from 0 to 1; null for no frame."""
    n = F.size(pixels)
    return F.when(n > 0, F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double")) / n / 255)


def cropped_frame_delta(a: Column, b: Column) -> Column:
    """``frame_delta`` of two frames struct<width, height, pixels (rows of width * 3 channel values)> after cropping
    both to the common width and height, over 255."""
    w, h = F.least(a["width"], b["width"]), F.least(a["height"], b["height"])
    row = lambda f, k: F.slice(f["pixels"], k * f["width"] * 3 + 1, w * 3)
    crop = lambda f: F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda k: row(f, k)))
    return F.when((w > 0) & (h > 0), frame_delta(crop(a), crop(b)) / 255)


def grade_check(samples: DataFrame, durations: DataFrame, media: str = "media", order: str = "sample", value: str = "luminance") -> DataFrame:
    """(media, passed, severity, max_delta, first, second) for every medium of ``durations`` (media, duration in
    seconds or null): those of unknown or under 4 s length, or with less than two samples, only warn."""
    there = samples.where(F.col(value).isNotNull())
    found = grade_consistency(there, media, order, value).join(there.groupBy(media).agg(F.count("*").alias("_n")), media)
    both = durations.join(found, media, "left")
    able = (F.col("duration") >= 4) & (F.coalesce("_n", F.lit(0)) >= 2)
    able = F.coalesce(able, F.lit(False))
    kept = lambda c: F.when(able, F.col(c)).alias(c)
    severity = F.when(~able, "warning").when(F.col("passed"), "info").otherwise("fail")
    return both.select(media, (able & F.coalesce("passed", F.lit(False))).alias("passed"), severity.alias("severity"), kept("max_delta"), kept("first"), kept("second"))


def verification(durations: DataFrame, cuts: DataFrame, deltas: DataFrame, envelopes: DataFrame, samples: DataFrame, media: str = "media") -> DataFrame:
    """(media, finding, check, cut_time, passed, severity, details) of every medium: its duration (media, actual,
    expected), its cuts (media, cut_time), frame differences and envelopes at them (media, cut_time, delta; bins,
    raw_peak), and its luminance samples (media, sample, luminance). Findings are numbered in this order; a cut that
    was not measured only warns."""
    none = F.lit(None).cast("double")
    num = lambda c, n=4: F.coalesce(F.format_string(f"%.{n}f", c.cast("double")), F.lit("unknown"))

    def rows(df: DataFrame, kind: int, check: str, cut, passed, severity, details) -> DataFrame:
        return df.select(media, F.lit(kind).alias("_kind"), F.lit(check).alias("check"), cut.alias("cut_time"), passed.alias("passed"), severity.alias("severity"), details.alias("details"))

    c = duration_check(F.col("actual"), F.col("expected"))
    found = rows(durations, 1, "duration", none, c["passed"], c["severity"], F.concat(F.lit("actual="), num(F.col("actual"), 3), F.lit("s expected="), num(F.col("expected"), 3), F.lit("s")))
    n = durations.select(media).join(cuts.groupBy(media).agg(F.count("*").alias("n")), media, "left")
    text = F.when(F.col("n").isNull(), "No internal cut boundaries (single segment or no ranges).").otherwise(F.concat(F.lit("Found "), F.col("n"), F.lit(" cut boundary/ies")))
    found = found.unionByName(rows(n, 2, "cut_boundaries", none, F.lit(True), F.lit("info"), text))
    # Cuts meet by whole milliseconds: a double that is written in another way is the same cut.
    whole = lambda df: df.withColumn("_ms", F.rint(F.col("cut_time") * 1000).cast("long"))
    at = lambda df: whole(cuts.select(media, "cut_time")).join(whole(df).drop("cut_time"), [media, "_ms"], "left").drop("_ms")
    v = visual_check(F.col("delta"))
    found = found.unionByName(rows(at(deltas), 3, "visual_discontinuity", F.col("cut_time"), v["passed"], v["severity"], F.concat(F.lit("delta="), num(F.col("delta")))))
    p = pop_check(F.col("bins"), F.col("raw_peak"), F.col("cut_time"))
    pops = at(envelopes).withColumn("p", p)
    found = found.unionByName(rows(pops, 4, "audio_pop", F.col("cut_time"), F.coalesce("p.passed", F.lit(False)), F.coalesce("p.severity", F.lit("warning")), F.concat(F.lit("peak="), num(F.col("p.loudest")))))
    graded = grade_check(samples, durations.select(media, F.col("actual").alias("duration")), media)
    found = found.unionByName(rows(graded, 5, "grade_consistency", none, F.col("passed"), F.col("severity"), F.concat(F.lit("max_delta="), num(F.col("max_delta")))))
    order = W.partitionBy(media).orderBy("_kind", "cut_time")
    return found.withColumn("finding", F.row_number().over(order)).select(media, "finding", "check", "cut_time", "passed", "severity", "details")


UNRESOLVED = " [unresolved after max passes]"


def _failing() -> Column:
    return ~F.col("passed") & (F.col("severity") == "fail")


def _matched(failing: DataFrame, again: DataFrame, media: str) -> DataFrame:
    """(media, finding, _new): for each failing finding the first new result of its check that is left, in order, within
    0.01 s of its cut or, where it has none, without a cut. Cuts that are further apart than that from the next make
    groups of their own, so no array holds a medium's findings; those without a cut meet by their number."""
    result = F.struct(F.col("finding").alias("f"), F.col("cut_time").alias("cut"), "passed", "severity", "details")
    number = F.row_number().over(W.partitionBy(media, "check").orderBy("finding"))
    loose = failing.where("cut_time IS NULL").select(media, "check", "finding", number.alias("_k")).join(again.where("cut_time IS NULL").select(media, "check", result.alias("_new"), number.alias("_k")), [media, "check", "_k"]).select(media, "finding", "_new")
    side = lambda df, new: df.where("cut_time IS NOT NULL").select(media, "check", "cut_time", F.lit(new).alias("_is_new"), result.alias("_r"))
    both = side(failing, False).unionByName(side(again, True))
    order = W.partitionBy(media, "check").orderBy("cut_time")
    apart = F.coalesce(F.col("cut_time") - F.lag("cut_time").over(order) > CUT_TOLERANCE, F.lit(False))
    grouped = both.withColumn("_apart", apart.cast("int")).withColumn("_group", F.sum("_apart").over(order))
    listed = lambda new: F.sort_array(F.collect_list(F.when(F.col("_is_new") == F.lit(new), F.col("_r"))))
    groups = grouped.groupBy(media, "check", "_group").agg(listed(False).alias("old"), listed(True).alias("new")).where("size(old) > 0 AND size(new) > 0")

    def step(state: Column, x: Column) -> Column:
        hit = F.try_element_at(F.filter(state["left"], lambda y: F.abs(x["cut"] - y["cut"]) <= CUT_TOLERANCE), F.lit(1))
        left = F.when(hit.isNull(), state["left"]).otherwise(F.filter(state["left"], lambda y: y["f"] != hit["f"]))
        return F.struct(left.alias("left"), F.array_append(state["out"], F.struct(x["f"].alias("finding"), hit.alias("new"))).alias("out"))

    kinds = dict(failing.dtypes)
    hit_type = f"struct<f:{dict(again.dtypes)['finding']},cut:{kinds['cut_time']},passed:boolean,severity:string,details:string>"
    start = F.struct(F.col("new").alias("left"), F.expr(f"CAST(ARRAY() AS ARRAY<STRUCT<finding: {kinds['finding']}, new: {hit_type}>>)").alias("out"))
    timed = groups.select(media, F.explode(F.aggregate("old", start, step)["out"]).alias("h")).where("h.new IS NOT NULL").select(media, "h.finding", F.col("h.new").alias("_new"))
    return loose.unionByName(timed)


def rechecked(findings: DataFrame, again: DataFrame, media: str = "media", retry: int = 1, last: bool = True) -> DataFrame:
    """Findings (media, finding, check, cut_time, passed, severity, details) with failed ones replaced by the first
    new result of the same check at the same cut (within 0.01 s, or both without). A new result serves one finding:
    in order, each takes the first that is left. After the ``last`` pass those still failing say so."""
    joined = findings.join(_matched(findings.where(_failing()), again, media), [media, "finding"], "left")
    passed, severity = F.coalesce("_new.passed", "passed"), F.coalesce("_new.severity", "severity")
    details = F.when(F.col("_new").isNotNull(), F.concat(F.lit(f"[retry {retry}] "), F.col("_new.details"))).otherwise(F.col("details"))
    made = joined.select(*(c for c in findings.columns if c not in ("passed", "severity", "details")), passed.alias("passed"), severity.alias("severity"), details.alias("details"))
    return unresolved(made) if last else made


def unresolved(findings: DataFrame) -> DataFrame:
    """Findings that still fail say so, once."""
    say = _failing() & ~F.contains(F.col("details"), F.lit("unresolved"))
    return findings.withColumn("details", F.concat("details", F.when(say, UNRESOLVED).otherwise("")))


def verified(findings: DataFrame, measure: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame, str], DataFrame], most: int = 3, media: str = "media") -> tuple[DataFrame, str, int]:
    """(findings, ending, passes): what fails is measured again, pass by pass. ``measure`` gets the findings that still
    fail and the number of the pass, and returns new results of them in the same columns; ``keep`` writes a table
    under a name and reads it back, so that no pass is worked out twice. The endings: ``passed``, nothing fails any
    more; ``settled``, a pass changed nothing, so no other will; ``limit``, after ``most`` passes."""
    now, ending, k = keep(findings, "pass-0"), "limit", 0
    while True:
        failing = now.where(_failing())
        if not failing.limit(1).count():
            ending = "passed"
            break
        if k == most:
            break
        k += 1
        again = keep(measure(failing, k), f"measured-{k}")
        after = keep(rechecked(now, again, media, k, last=False), f"pass-{k}")
        bare = lambda df: df.select(media, "finding", "passed", "severity", F.regexp_replace("details", r"^\[retry [0-9]+\] ", "").alias("details"))
        same = not bare(after).exceptAll(bare(now)).limit(1).count()
        now = after
        if same:
            ending = "settled"
            break
    return unresolved(now), ending, k


def nearest_picture(findings: DataFrame, pictures: DataFrame, media: str = "media") -> DataFrame:
    """Adds the first picture (media, picture_no, cut_time, path) within 0.01 s of each finding's cut."""
    # Cuts are dealt into steps of the tolerance; a finding looks into its own and both neighbours.
    place = lambda c: F.floor(F.col(c) / CUT_TOLERANCE).cast("long")
    p = pictures.select(media, "picture_no", F.col("cut_time").alias("_cut"), "path", place("cut_time").alias("_at"))
    near = findings.withColumn("_at", F.explode(F.sequence(place("cut_time") - 1, place("cut_time") + 1)))
    hits = near.join(p, [media, "_at"]).where(F.abs(F.col("cut_time") - F.col("_cut")) <= CUT_TOLERANCE).groupBy(media, "finding").agg(F.min_by("path", "picture_no").alias("timeline_png"))
    return findings.join(hits, [media, "finding"], "left")


def boundary_spans(cuts: DataFrame, folder: str, media: str = "media", window: float = 1.5) -> DataFrame:
    """(media, picture_no, cut_time, start, end, path): the span around every cut (media, cut_time) that a picture of it
    shows, and the picture's name."""
    number = F.row_number().over(W.partitionBy(media).orderBy("cut_time")) - 1
    path = F.concat(F.lit(folder + "/"), F.col(media).cast("string"), F.format_string("/boundary_%03d_%.2fs.png", number, F.col("cut_time")))
    return cuts.select(media, number.alias("picture_no"), "cut_time", F.greatest(F.col("cut_time") - window, F.lit(0.0)).alias("start"), (F.col("cut_time") + window).alias("end"), path.alias("path"))


def with_pictures(findings: DataFrame, pictures: DataFrame, media: str = "media") -> DataFrame:
    """Findings with timeline_png, the picture of each visual check's cut, and with new ones about the pictures (media,
    picture_no, cut_time, path, error: null where it was made): how many there are, then each that could not be made."""
    made, kinds = pictures.where("error IS NULL"), dict(findings.dtypes)
    visual = F.col("check") == "visual_discontinuity"
    seen = nearest_picture(findings.where(visual), made, media).unionByName(findings.where(~F.coalesce(visual, F.lit(False))).withColumn("timeline_png", F.lit(None).cast("string")))
    n = pictures.groupBy(media).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("ok"))
    whole = F.col("ok") == F.col("n")
    text = F.when(F.col("ok") == 0, F.concat(F.lit("timeline PNG generation failed for all "), F.col("n"), F.lit(" cut boundary/ies"))).otherwise(F.concat(F.lit("Generated "), F.col("ok"), F.lit("/"), F.col("n"), F.lit(" timeline PNG(s)")))
    row = lambda df, place, check, passed, severity, details: df.select(media, place.alias("_place"), F.lit(check).alias("check"), F.lit(None).cast(kinds["cut_time"]).alias("cut_time"), passed.alias("passed"), severity.alias("severity"), details.alias("details"), F.lit(None).cast("string").alias("timeline_png"))
    failed = F.concat(F.lit("Timeline PNG failed at boundary "), F.col("picture_no"), F.lit(" ("), F.format_string("%.2f", "cut_time"), F.lit("s): "), F.col("error"))
    more = row(n, F.lit(-1), "timeline_pngs", whole, F.when(whole, "info").otherwise("warning"), text).unionByName(row(pictures.where("error IS NOT NULL"), F.col("picture_no"), "timeline_png_generation", F.lit(False), F.lit("warning"), failed))
    last = findings.groupBy(media).agg(F.max("finding").alias("_last"))
    number = F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy(media).orderBy("_place"))
    numbered = more.join(last, media, "left").withColumn("finding", number.cast(kinds["finding"])).drop("_last", "_place")
    return seen.unionByName(numbered)
