"""Phrases over streams of timed words.

``phrase_sessions`` packs words into phrases by silence with session windows and a watermark; it runs alike over
a stream and a table. A session merges events whose gap equals the limit, while a phrase ends at that gap; so
the limit is one microsecond less. Words later than the watermark are dropped by Spark. A stream appends a phrase
once the watermark has passed its end, so the last ones of a run stay open: ``still_open`` gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def phrase_sessions(words: DataFrame, silence: str = "1800 seconds", late: str = "1 hour", media: str = "media", at: str = "ts") -> DataFrame:
    """(media, start, end, n_words): ``at`` is a timestamp; ``silence`` in whole seconds."""
    n = int(silence.split()[0])
    gap = f"{n - 1} seconds 999 milliseconds 999 microseconds"
    return words.withWatermark(at, late).groupBy(media, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_words"), F.min(at).alias("start"), F.max(at).alias("end")).select(media, "start", "end", "n_words")


def still_open(words: DataFrame, finished: DataFrame, media: str = "media", at: str = "ts", **limits: str) -> DataFrame:
    """The sessions of a table of words that follow each medium's last one in ``finished`` (what a stream over the
    same words has appended). One watermark ends the sessions of all media, so none before them is missing."""
    last = finished.groupBy(F.col(media).alias("_media")).agg(F.max("end").alias("_last"))
    later = words.join(last, F.col(media).eqNullSafe(F.col("_media")), "left").where(F.col("_last").isNull() | (F.col(at) > F.col("_last")))
    return phrase_sessions(later.select(*words.columns), media=media, at=at, **limits)


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished phrases to a Parquet folder and stops when all there is has been read."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
