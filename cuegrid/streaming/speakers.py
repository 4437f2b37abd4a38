"""Phrases over a stream of words that end at a silence or at a change of speaker, as ``islands.phrases`` packs them.

A session window knows gaps only, so a stateful processor keeps, for each medium, the words that the watermark has not
passed and the phrase that is open. Words may come in any order within the watermark: a timer at the earliest waiting
word hands all words before the watermark to the open phrase, in order of (start_ms, pos), and another one closes
the phrase when no word can follow it within the silence. What comes later than the watermark is dropped by Spark and
counted (``late_words``). State is bounded by the words of the watermark's delay and one phrase a medium.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cuegrid.operators import islands

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WORD = "start_ms long, end_ms long, pos long, speaker string, word string"
_PHRASE = "phrase_id long, speaker string, start_ms long, end_ms long, n_words long, text string, last_start long, last_pos long"
_COLUMNS = ["phrase_id", "speaker", "start_ms", "end_ms", "n_words", "text", "last_start", "last_pos"]


def said(text: str, word: str | None) -> str:
    """A phrase's words so far and one more: stripped, by a space, none before punctuation."""
    word = (word or "").strip()
    return re.sub(r" ([,.?!])", r"\1", f"{text} {word}".strip()) if word else text


class PhrasePacker(StatefulProcessor):
    """One medium's words to its phrases."""

    def __init__(self, silence_ms: int, media: str):
        self.silence_ms, self.media = silence_ms, media

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WORD)
        self.open = handle.getValueState("open", _PHRASE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = [(int(r.start_ms), int(r.end_ms), int(r.pos), None if pd.isna(r.speaker) else r.speaker, None if pd.isna(r.word) else r.word) for r in pdf.itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
        self._wake()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        words = sorted(self.waiting.get() if self.waiting.exists() else [], key=lambda w: (w[0], w[2]))
        phrase = list(self.open.get()) if self.open.exists() else None
        done, at = [], 0
        for start, end, pos, speaker, word in words:
            if start >= passed:
                break
            at += 1
            if phrase is None or not phrase[4]:
                phrase = [phrase[0] if phrase else 1, None, start, end, 0, "", start, pos]
            elif start - phrase[3] >= self.silence_ms or phrase[1] and speaker and phrase[1] != speaker:
                done.append(phrase)
                phrase = [phrase[0] + 1, None, start, end, 0, "", start, pos]
            phrase[1], phrase[3], phrase[4], phrase[5], phrase[6], phrase[7] = phrase[1] or speaker, end, phrase[4] + 1, said(phrase[5], word), start, pos
        if at:
            self.waiting.clear()
            if words[at:]:
                self.waiting.put(words[at:])
        if phrase is not None and phrase[4] and passed - phrase[3] >= self.silence_ms:
            done.append(phrase)
            phrase = [phrase[0] + 1, None, 0, 0, 0, "", 0, 0]
        if phrase is not None:
            self.open.update(tuple(phrase))
        self._wake()
        if done:
            yield pd.DataFrame([(key[0], *p) for p in done if p[5]], columns=[self.media, *_COLUMNS])

    def _wake(self) -> None:
        """One timer: at the earliest waiting word, or when the open phrase can't go on."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waiting = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        phrase = self.open.get() if self.open.exists() else None
        due = [min(waiting) + 1] if waiting else []
        if phrase is not None and phrase[4]:
            due.append(phrase[3] + self.silence_ms)
        if due:
            self.handle.registerTimer(max(1, min(due)))

    def close(self) -> None:
        pass


def speaker_phrases(words: DataFrame, silence_ms: int = islands.PHRASE_SILENCE_MS, late: str = "1 hour", media: str = "media", at: str = "ts") -> DataFrame:
    """(media, phrase_id, speaker, start_ms, end_ms, n_words, text, last_start, last_pos) over a stream of words
    (media, pos, word, speaker, start_ms, end_ms, and start_ms as a timestamp ``at``). Phrases without text are left
    out; last_start and last_pos name a phrase's last word."""
    kind = dict(words.dtypes)[media]
    rows = words.select(media, "pos", "word", "speaker", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), at).withWatermark(at, late)
    return rows.groupBy(media).transformWithStateInPandas(PhrasePacker(silence_ms, media), f"{media} {kind}, {_PHRASE}", "append", "eventTime")


def start(phrases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished phrases to a Parquet folder and stops when all there is has been read. Such state needs the
    RocksDB store, which the session is set to while the query starts."""
    conf, name = phrases.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        return phrases.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def finished(spark: SparkSession, path: str, kind: str = "long", media: str = "media") -> DataFrame:
    """What ``start`` has written."""
    return spark.read.schema(f"{media} {kind}, {_PHRASE}").parquet(path)


def late_words(query: StreamingQuery) -> int:
    """How many words came after the watermark, by the progress that the query still knows."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def with_open_phrases(words: DataFrame, done: DataFrame, silence_ms: int = islands.PHRASE_SILENCE_MS, media: str = "media") -> DataFrame:
    """``done`` (what a stream has appended) and the phrases of a table of the same words that follow each medium's
    last one, which the stream still holds open. A phrase starts anew after another, so nothing before it matters."""
    last = done.groupBy(F.col(media).alias("_media")).agg(F.max(F.struct("phrase_id", "last_start", "last_pos")).alias("_last"))
    after = F.col("_last").isNull() | (F.struct("start_ms", "pos") > F.struct(F.col("_last.last_start").alias("start_ms"), F.col("_last.last_pos").alias("pos")))
    rest = words.join(last, F.col(media).eqNullSafe(F.col("_media")), "left").where(after).select(*words.columns)
    packed = islands.phrases(rest, silence_ms, media, ("start_ms", "pos")).join(last, F.col(media).eqNullSafe(F.col("_media")), "left")
    made = packed.withColumn("phrase_id", F.col("phrase_id") + F.coalesce("_last.phrase_id", F.lit(0)))
    columns = [media, "phrase_id", "speaker", "start_ms", "end_ms", "n_words", "text"]
    return done.select(*columns).unionByName(made.select(*columns))
