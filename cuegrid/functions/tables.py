"""Operators as table functions: phrases, captions and clauses from SQL.

``register`` makes them known to a session. Each says in ``analyze`` what it returns, from the columns that it is given,
and how its input is to be dealt, so a call only names the table:

    SELECT * FROM cue_phrases(TABLE(words), silence_ms => 500)
    SELECT * FROM cue_captions(TABLE(segments))
    SELECT * FROM cue_clauses(TABLE(windows))

Rows of a medium come in order, one at a time; a function keeps the open phrase and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from cuegrid.operators import folds, islands
from cuegrid.streaming.speakers import said

_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()


def _needs(table: AnalyzeArgument, *columns: str) -> T.StructType:
    if not isinstance(table.dataType, T.StructType):
        raise ValueError("the first argument must be a table")
    if missing := [c for c in columns if c not in table.dataType.names]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return table.dataType


def _schema(keys: list[T.StructField], **fields: T.DataType) -> T.StructType:
    return T.StructType([*keys, *(T.StructField(k, t) for k, t in fields.items())])


class Phrases:
    """Words (media, pos, word, speaker, start_ms, end_ms) as phrases, as ``islands.phrases`` packs them."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.open, self.number = None, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, silence_ms: AnalyzeArgument | None = None) -> AnalyzeResult:
        kind = _needs(table, "media", "pos", "word", "speaker", "start_ms", "end_ms")
        schema = _schema([kind["media"]], phrase_id=_LONG, speaker=_TEXT, start_ms=_LONG, end_ms=_LONG, n_words=_LONG, text=_TEXT)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("media")], orderBy=[OrderingColumn("pos")])

    def eval(self, row: T.Row, silence_ms: int = islands.PHRASE_SILENCE_MS) -> Iterator[tuple]:
        now = self.open
        if now is None or row.start_ms - now[4] >= silence_ms or now[2] is not None and row.speaker is not None and now[2] != row.speaker:
            yield from self.terminate()
            self.number += 1
            now = self.open = [row.media, self.number, None, row.start_ms, row.end_ms, 0, ""]
        now[2], now[4], now[5], now[6] = row.speaker if now[2] is None else now[2], row.end_ms, now[5] + 1, said(now[6], row.word)

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None and self.open[6]:
            yield tuple(self.open)
        self.open = None


class Captions:
    """Segments (keys, start_ms, end_ms, text, speaker, words) as caption blocks (keys, block, ...); the keys are all
    other columns. As ``folds.captions``."""

    OWN = ("start_ms", "end_ms", "text", "speaker", "words")

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        kind = _needs(table, *Captions.OWN)
        keys = [f for f in kind.fields if f.name not in Captions.OWN]
        return AnalyzeResult(_schema(keys, block=_INT, start_ms=_LONG, end_ms=_LONG, text=_TEXT, n_words=_INT, speaker=_TEXT))

    def eval(self, row: T.Row) -> Iterator[tuple]:
        given = row.asDict()
        keys = [v for k, v in given.items() if k not in self.OWN]
        words = [w.asDict() for w in row.words or []]
        for k, b in enumerate(folds.captions_of(words, row.text or "", row.start_ms, row.end_ms, row.speaker), 1):
            yield (*keys, k, b["start_ms"], b["end_ms"], b["text"], b["n_words"], b["speaker"])


class Clauses:
    """Translated windows (keys, start_ms, end_ms, translated_text) as blocks, as ``folds.translated_blocks``."""

    OWN = ("start_ms", "end_ms", "translated_text")

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        kind = _needs(table, *Clauses.OWN)
        return AnalyzeResult(_schema([f for f in kind.fields if f.name not in Clauses.OWN], block=_INT, start_ms=_LONG, end_ms=_LONG, text=_TEXT))

    def eval(self, row: T.Row) -> Iterator[tuple]:
        keys = [v for k, v in row.asDict().items() if k not in self.OWN]
        lines = [line for c in folds.clauses(row.translated_text or "") for line in folds.wrapped(c)]
        for k, text in enumerate(folds.long_enough(lines, row.end_ms - row.start_ms), 1):
            yield (*keys, k, row.start_ms, row.end_ms, text)


def register(spark: SparkSession) -> None:
    for name, kind in (("cue_phrases", Phrases), ("cue_captions", Captions), ("cue_clauses", Clauses)):
        spark.udtf.register(name, udtf(kind))
