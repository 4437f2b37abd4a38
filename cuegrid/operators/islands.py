"""Gaps and islands over timed rows: phrases, silences, speakers, merged cues, caption chunks, offsets.

Every function takes a DataFrame with a medium's key (``media``) and times in whole milliseconds, and works on
all media at once. Windows are partitioned by medium; where a medium may be large, rows are first combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.operators.folds import _fold as fold

PHRASE_SILENCE_MS = 500
SILENCE_MS = 400
CUE_GAP_MS = 450


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def with_phrase_id(words: DataFrame, silence_ms: int = PHRASE_SILENCE_MS, media: str = "media", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Adds phrase_id (1-based). A phrase ends at a silence of ``silence_ms`` or more, or where a known speaker
    follows another known speaker of the same phrase. Words with unknown (null) speaker never break."""
    w = W.partitionBy(media).orderBy(*order)
    silent = F.col("start_ms") - F.lag("end_ms").over(w) >= silence_ms
    stretch = words.withColumn("_stretch", F.sum(_flag(silent)).over(w))
    inside = W.partitionBy(media, "_stretch").orderBy(*order)
    before = F.last("speaker", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    changed = F.coalesce(before != F.col("speaker"), F.lit(False))
    first = F.row_number().over(inside) == 1
    return stretch.withColumn("_start", _flag(changed | first)).withColumn("phrase_id", F.sum("_start").over(w)).drop("_stretch", "_start")


def phrases(words: DataFrame, silence_ms: int = PHRASE_SILENCE_MS, media: str = "media", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(media, phrase_id, speaker, start_ms, end_ms, n_words, text); phrases without text are dropped."""
    at = F.struct(*order)
    packed = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("word").alias("word"))))
    return (
        with_phrase_id(words, silence_ms, media, order)
        .groupBy(media, "phrase_id")
        .agg(F.min_by("speaker", F.when(F.col("speaker").isNotNull(), at)).alias("speaker"), F.min_by("start_ms", at).alias("start_ms"), F.max_by("end_ms", at).alias("end_ms"), F.count(F.lit(1)).alias("n_words"), packed.alias("_w"))
        .withColumn("text", X.join_phrase(F.transform("_w", lambda x: x["word"])))
        .drop("_w")
        .where("text <> ''")
    )


def silences(words: DataFrame, ranges: DataFrame, silence_ms: int = SILENCE_MS, media: str = "media") -> DataFrame:
    """(media, start_ms, end_ms) of the pauses of ``silence_ms`` or more in each medium's range
    (media, range_start, range_end), the ends of the range included. Media without words have none."""
    w = W.partitionBy(media).orderBy("start_ms", "end_ms").rowsBetween(W.unboundedPreceding, -1)
    both = words.join(ranges, media).withColumn("_before", F.greatest(F.coalesce(F.max("end_ms").over(w), F.col("range_start")), F.col("range_start")))
    inner = both.select(media, F.col("_before").alias("start_ms"), F.greatest("range_start", "start_ms").alias("end_ms"))
    tail = both.groupBy(media).agg(F.greatest(F.max("end_ms"), F.max("range_start")).alias("start_ms"), F.max("range_end").alias("end_ms"))
    return inner.unionByName(tail).where(F.col("end_ms") - F.col("start_ms") >= silence_ms)


def with_speaker_segment(words: DataFrame, media: str = "media", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Fills unknown speakers (with the one before, at the start with the first known) and adds segment_id."""
    w = W.partitionBy(media).orderBy(*order)
    known = F.coalesce(F.last("speaker", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("speaker", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    filled = words.withColumn("speaker", known)
    new = (F.row_number().over(w) == 1) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    return filled.withColumn("_new", _flag(new)).withColumn("segment_id", F.sum("_new").over(w)).drop("_new")


def speaker_segments(words: DataFrame, media: str = "media", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(media, segment_id, speaker, start_ms, end_ms, n_words, text): first start, last end, words by a space."""
    at = F.struct(*order)
    packed = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("word").alias("word"))))
    return with_speaker_segment(words, media, order).groupBy(media, "segment_id").agg(F.first("speaker").alias("speaker"), F.min_by("start_ms", at).alias("start_ms"), F.max_by("end_ms", at).alias("end_ms"), F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(packed, lambda x: x["word"]), " ").alias("text"))


def merged_cues(cues: DataFrame, gap_ms: int = CUE_GAP_MS, media: str = "media", order: tuple[str, ...] = ("cue",)) -> DataFrame:
    """(media, island, start_ms, end_ms, n_cues, text) of cues that follow each other with less than ``gap_ms``."""
    w = W.partitionBy(media).orderBy(*order)
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) >= gap_ms, F.lit(True))
    at = F.struct(*order)
    packed = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("text").alias("text"))))
    return cues.withColumn("island", F.sum(_flag(new)).over(w)).groupBy(media, "island").agg(F.min_by("start_ms", at).alias("start_ms"), F.max_by("end_ms", at).alias("end_ms"), F.count(F.lit(1)).alias("n_cues"), F.array_join(F.transform(packed, lambda x: x["text"]), " ").alias("text"))


def with_chunk(words: DataFrame, keys: tuple[str, ...], pos: str = "pos", breaks: str = X.CAPTION_BREAKS, size: int = 2) -> DataFrame:
    """Adds chunk (1-based inside ``keys``): ``size`` words, or fewer where a word ends in one of ``breaks``."""
    w = W.partitionBy(*keys).orderBy(pos)
    closes = F.rtrim("word").rlike(X.char_class(breaks) + "$")
    run = words.withColumn("_run", F.coalesce(F.sum(_flag(closes)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy(*keys, "_run").orderBy(pos)
    return run.withColumn("_new", _flag((F.row_number().over(inside) - 1) % size == 0)).withColumn("chunk", F.sum("_new").over(w)).drop("_run", "_new")


def chunk_text(words: Column, soft: str) -> Column:
    """A chunk's caption: words by a space, soft punctuation at the end dropped, upper case."""
    return F.upper(F.regexp_replace(F.array_join(words, " "), X.char_class(soft) + "+$", ""))


def bold_captions(cues: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, chunk, start_ms, end_ms, text): two upper-case words at a time, each cue's time in equal slices."""
    closes = lambda w: F.rtrim(w).rlike(X.char_class(X.HARD_PUNCTUATION + X.SOFT_PUNCTUATION) + "$")
    # A cue is one row: its words are dealt out inside it, without a shuffle or a sort.
    step = lambda a, w: F.struct(((a["n"] + 1) % F.when(closes(w), 1).otherwise(2)).alias("n"), F.array_append(a["out"], a["n"] == 0).alias("out"))
    cut = cues.select(*keys, "start_ms", "end_ms", X.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    begins = F.flatten(fold(F.col("w"), {"n": F.lit(0)}, step, "BOOLEAN")["outs"])
    cut = cut.withColumn("first", F.filter(F.transform(begins, lambda b, k: F.when(b, k)), lambda k: k.isNotNull()))
    chunks = cut.select("*", F.size("first").alias("n"), F.posexplode("first").alias("k", "at"))
    size = F.coalesce(F.get("first", F.col("k") + 1), F.size("w")) - F.col("at")
    text = chunk_text(F.slice("w", F.col("at") + 1, size), X.SOFT_PUNCTUATION)
    return chunks.select(*keys, (F.col("k") + 1).cast("long").alias("chunk"), X.even_slice(F.col("start_ms"), F.col("end_ms"), F.col("k"), F.col("n")).alias("_s"), X.even_slice(F.col("start_ms"), F.col("end_ms"), F.col("k") + 1, F.col("n")).alias("_e"), text.alias("text")).withColumnsRenamed({"_s": "start_ms", "_e": "end_ms"})


def cut_boundaries(ranges: DataFrame, edl: str = "edl", order: str = "range_idx") -> DataFrame:
    """(edl, range_idx, boundary_ms): running sums of the raw durations, without the last."""
    w = W.partitionBy(edl).orderBy(order)
    return ranges.withColumn("boundary_ms", F.sum(F.col("end_ms") - F.col("start_ms")).over(w)).withColumn("_last", F.lead(order).over(w).isNull()).where("NOT _last").select(edl, order, "boundary_ms")


def output_offsets(ranges: DataFrame, edl: str = "edl", order: str = "range_idx") -> DataFrame:
    """Adds offset_ms: where a range starts on the output timeline. Ranges of no length take no place."""
    w = W.partitionBy(edl).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return ranges.withColumn("offset_ms", F.coalesce(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).over(w), F.lit(0)))


def allocated(blocks: DataFrame, keys: tuple[str, ...], order: str = "block") -> DataFrame:
    """(keys, block, start_ms, end_ms): a window's time shared out by the blocks' characters (white space aside)."""
    w = W.partitionBy(*keys).orderBy(order)
    whole = W.partitionBy(*keys)
    weighted = blocks.withColumn("_w", X.block_weight(F.col("text")).cast("long")).withColumn("_upto", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(whole))
    cut = lambda upto: (F.col("start_ms") + F.floor((2 * (F.col("end_ms") - F.col("start_ms")) * upto + F.col("_all")) / (2 * F.col("_all")))).cast("long")
    return weighted.select(*keys, order, "text", cut(F.col("_upto") - F.col("_w")).alias("_s"), cut(F.col("_upto")).alias("_e")).withColumnsRenamed({"_s": "start_ms", "_e": "end_ms"})
