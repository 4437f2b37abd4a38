"""Queries of stateful operators, loops and table functions, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid import jobs
from cuegrid.catalog import EVENTS_SQL, ORACLES, PHRASES_SQL, _event_words, _findings, _turn_segments, _windows, dealt, query, shared_folder, table, words
from cuegrid.functions import tables
from cuegrid.operators import signal
from cuegrid.plans import cards
from cuegrid.sources import named_files
from cuegrid.streaming import ingest, speakers

EVENT_SILENCE_MS = 1_800_000
#: Cards in a part.
CARDS = 16_384


def _streamed(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


@query(
    f"""WITH {EVENTS_SQL},
p1 AS (SELECT *, coalesce(CAST(start_ms - lag(end_ms) OVER w >= {EVENT_SILENCE_MS} AS INT), 0) AS silent FROM e WINDOW w AS (PARTITION BY media ORDER BY start_ms, pos)),
p2 AS (SELECT *, sum(silent) OVER (PARTITION BY media ORDER BY start_ms, pos) AS stretch FROM p1),
p3 AS (SELECT *, row_number() OVER w AS k, last_value(speaker IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p2 WINDOW w AS (PARTITION BY media, stretch ORDER BY start_ms, pos)),
p4 AS (SELECT *, sum(CASE WHEN k = 1 OR coalesce(prev <> speaker, false) THEN 1 ELSE 0 END) OVER (PARTITION BY media ORDER BY start_ms, pos) AS phrase_id FROM p3)
SELECT media, CAST(phrase_id AS BIGINT) AS phrase_id, arg_min(speaker, (start_ms, pos)) FILTER (WHERE speaker IS NOT NULL) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, pos)) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY start_ms, pos) AS text FROM p4 GROUP BY media, phrase_id"""
)
def stream_speaker_phrases(spark, sf_dir):
    """Events as a stream of words, packed by silence and speaker; the phrases that the run leaves open follow from the
    table."""
    given = _event_words(spark, sf_dir)
    live = _streamed(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    words = live.select(F.col("user_id").alias("media"), F.col("event_id").alias("pos"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("word"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("speaker"), ms.alias("start_ms"), (ms + 1000).alias("end_ms"), F.col("ts").cast("timestamp").alias("ts"))
    out = shared_folder(spark, "speakers")
    speakers.start(speakers.speaker_phrases(words, EVENT_SILENCE_MS), f"{out}/rows", f"{out}/state").awaitTermination()
    return speakers.with_open_phrases(given, speakers.finished(spark, f"{out}/rows"), EVENT_SILENCE_MS)


def _passes(spark, sf_dir, passes_at, most: int) -> DataFrame:
    """(media, finding, passed, details, ending, passes): ``_findings`` checked again; a finding passes from the pass
    on that ``passes_at`` says, and its details tell how often it was measured only where it changes."""

    def measure(failing: DataFrame, k: int) -> DataFrame:
        better = passes_at <= k
        return failing.withColumns({"passed": better, "severity": F.when(better, "info").otherwise("fail"), "details": F.concat(F.lit("m"), F.col("finding").cast("string"))})

    made, ending, n = signal.verified(_findings(spark, sf_dir), measure, jobs._kept(spark, shared_folder(spark, "verify")), most)
    return made.select("media", "finding", "passed", "details", F.lit(ending).alias("ending"), F.lit(n).alias("passes"))


def _passes_sql(at: str, ending: str, n: int) -> str:
    last = f"least({at}, {n})"
    return f"""WITH f AS (SELECT user_id AS media, event_id AS finding, event_id % 7 <> 0 AS passed, event_id % 7 = 0 AND event_id % 3 <> 0 AS failing FROM events)
SELECT media, finding, passed OR (failing AND {at} <= {n}) AS passed, CASE WHEN failing THEN '[retry ' || CAST({last} AS VARCHAR) || '] m' || CAST(finding AS VARCHAR) || CASE WHEN {at} > {n} THEN ' [unresolved after max passes]' ELSE '' END ELSE 'd' || CAST(finding AS VARCHAR) END AS details,
  '{ending}' AS ending, CAST({n} AS INT) AS passes FROM f"""


@query(_passes_sql("1 + finding % 2", "passed", 2))
def verify_until_passed(spark, sf_dir):
    """Everything passes at the second pass at the latest."""
    return _passes(spark, sf_dir, 1 + F.col("finding") % 2, 5)


@query(_passes_sql("1 + finding % 9", "limit", 3))
def verify_until_limit(spark, sf_dir):
    """Some pass at each pass, others only beyond the limit of three."""
    return _passes(spark, sf_dir, 1 + F.col("finding") % 9, 3)


@query(_passes_sql("CASE WHEN finding % 2 = 0 THEN 1 ELSE 99 END", "settled", 2))
def verify_until_settled(spark, sf_dir):
    """Half of them pass at once, the others never: the second pass changes nothing."""
    return _passes(spark, sf_dir, F.when(F.col("finding") % 2 == 0, 1).otherwise(99), 9)


def timed_words(path: str) -> dict:
    """A recogniser for text files: a word each half second. Texts whose name's number 11 divides can't be heard."""
    if int(path.rsplit("_", 1)[1].split(".")[0]) % 11 == 0:
        raise RuntimeError("no speech")
    fs, at = named_files.open_fs(path)
    with fs.open_input_stream(at) as f:
        said = f.read().decode().split()
    return {"segments": [{"start": 0.0, "end": 0.5 * len(said), "text": " ".join(said), "words": [{"word": " " * bool(k) + w, "start": 0.5 * k, "end": 0.5 * k + 0.4} for k, w in enumerate(said)]}]}


@query(
    r"""WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS said FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, len(list_filter(string_split(regexp_replace(said, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '), lambda x: x <> '')) AS n FROM t),
r AS (SELECT *, conv_id % 11 = 0 AS bad, conv_id % 5 = 0 AS changed FROM w)
SELECT 'said_' || CAST(conv_id AS VARCHAR) AS media, CAST(b AS BIGINT) AS batch, CASE WHEN b = 0 OR bad THEN 'process' WHEN b = 1 THEN 'skip' WHEN changed THEN 'overwrite' ELSE 'skip' END AS decision, CASE WHEN bad THEN 'RuntimeError: no speech' END AS error,
  CASE WHEN NOT bad AND (b = 0 OR (b = 2 AND changed)) THEN CAST(n + CASE WHEN b = 2 THEN 2 ELSE 0 END AS BIGINT) END AS n_words FROM r, (VALUES (0), (1), (2)) v(b)"""
)
def batch_transcripts(spark, sf_dir):
    """Conversations as media, in a manifest that comes three times: new, again, and after a fifth of them changed."""
    out = shared_folder(spark, "batch")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.alias("document"))
    media = said.select(F.concat(F.lit("said_"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("name"), "conv_id", "document")
    named_files.write_files(media, f"{out}/media")
    local = F.lit(re.sub("^file:/*", "/", f"{out}/media/"))
    for k in range(3):
        if k == 2:
            named_files.write_files(media.where("conv_id % 5 = 0").withColumn("document", F.concat("document", F.lit(" and more"))), f"{out}/media", exists="replace")
        # A manifest is one file, whose lines come as rows.
        lines = media.select(F.lit(f"{k}.lst").alias("name"), F.col("conv_id").alias("part"), F.concat(local, F.col("name"), F.lit("\n")).alias("document"))
        named_files.write_files(lines, f"{out}/manifests", part="part")
        ingest.transcribe(spark, f"{out}/manifests", out, timed_words, "text").awaitTermination()
    made = ingest.ledger(spark, out)
    return made.select("media", "batch", "decision", "error", F.size(F.from_json("transcript", "segments array<struct<words: array<struct<word: string>>>>")["segments"][0]["words"]).cast("long").alias("n_words"))


def _from_sql(spark, function: str, given: DataFrame) -> DataFrame:
    """A table function called from SQL over a table."""
    tables.register(spark)
    return spark.sql(f"SELECT * FROM {function}(TABLE({{given}}))", given=given)


@query(f"WITH {PHRASES_SQL} SELECT media, phrase_id, speaker, start_ms, end_ms, n_words, text FROM phrases")
def phrases_by_function(spark, sf_dir):
    return _from_sql(spark, "cue_phrases", words(spark, sf_dir).drop("turn"))


@query(ORACLES["captions_split"])
def captions_by_function(spark, sf_dir):
    return _from_sql(spark, "cue_captions", _turn_segments(spark, sf_dir))


@query(ORACLES["clauses_wrap"])
def clauses_by_function(spark, sf_dir):
    windows = _windows(spark, sf_dir).select("media", "window_id", "start_ms", "end_ms", F.col("source_text").alias("translated_text"))
    return _from_sql(spark, "cue_clauses", windows)


@query(
    """WITH RECURSIVE t AS (SELECT p_partkey AS card, 0 AS paragraph, 60 AS size, p_name || ' ' || p_type || ' ' || p_name || ' ' || p_brand AS t FROM part UNION ALL SELECT p_partkey, 1, 40, repeat(p_type || ' ' || p_name || ' ', 4) || p_brand FROM part),
w AS (SELECT card, paragraph, size, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM t),
v AS (SELECT *, list_transform(w, lambda x: CAST(list_sum(list_transform(string_split(x, ''), lambda c: 250 + ascii(c) * 37 % 400)) AS BIGINT) * size) AS v, (250 + 32 * 37 % 400) * size AS s FROM w),
f AS (SELECT card, paragraph, 2 AS i, w, v, s, [w[1]] AS lines, [v[1]] AS used FROM v
  UNION ALL SELECT card, paragraph, i + 1, w, v, s, CASE WHEN fits THEN list_append(lines[1:len(lines) - 1], lines[len(lines)] || ' ' || w[i]) ELSE list_append(lines, w[i]) END, CASE WHEN fits THEN list_append(used[1:len(used) - 1], used[len(used)] + s + v[i]) ELSE list_append(used, v[i]) END
  FROM (SELECT *, used[len(used)] + s + v[i] <= 1497000 AS fits FROM f WHERE i <= len(w))),
l AS (SELECT card, paragraph, unnest(range(0, len(lines))) AS line, unnest(lines) AS text, unnest(used) AS width FROM f WHERE i = len(w) + 1),
n AS (SELECT card, count(*) FILTER (paragraph = 0) AS a, count(*) FILTER (paragraph = 1) AS b FROM l GROUP BY card)
SELECT card, CAST(paragraph AS INT) AS paragraph, CAST(line AS INT) AS line, text, CAST(1920000 - width AS BIGINT) AS twice_x, CAST(1080 - (a * 60 + (a - 1) * 14 + 28 + b * 40 + (b - 1) * 14) + 2 * CASE WHEN paragraph = 0 THEN line * 74 ELSE a * 60 + (a - 1) * 14 + 28 + line * 54 END AS BIGINT) AS twice_y FROM l JOIN n USING (card)"""
)
def card_lines(spark, sf_dir):
    """Names and types of parts on cards, in a font whose glyphs follow a rule."""
    widths = spark.range(32, 127).select(F.chr("id").alias("char"), (250 + F.col("id") * 37 % 400).alias("width"))
    text = F.concat(F.concat_ws(" ", "p_name", "p_type", "p_name", "p_brand"), F.lit("\n\n"), F.repeat(F.concat("p_type", F.lit(" "), "p_name", F.lit(" ")), F.lit(4)), "p_brand")
    given = dealt(table(spark, sf_dir, "part"), "p_partkey", CARDS).select(F.col("p_partkey").alias("card"), text.alias("text"))
    made = cards.card_layout(given, widths, 60, 40)
    return made.select("card", "paragraph", "line", "text", F.rint(F.col("x") * 2000).cast("long").alias("twice_x"), F.rint(F.col("y") * 2).cast("long").alias("twice_y"))
