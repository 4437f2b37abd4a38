"""All queries over the driver's tables, with DuckDB SQL that must return the same rows.

The tables hold no word times, so ``words`` derives a timeline from ``conversations`` by a fixed rule in whole
milliseconds: a word lasts 120 + 40 for each character, and is followed by 700 after . ? !, by 300 after , ; :
and by 80 otherwise. Media are conversations, speakers are roles.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.operators import edl, folds, islands, signal
from cuegrid.plans import ffmpeg
from cuegrid.sources import readers, sinks
from cuegrid.streaming import phrases as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Turns of conversations in a part: some 350,000 words of the given tables.
TURNS = 4096


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Dealt by a key into parts of about so many rows, whose number grows with the table. Where rows are taken apart
    afterwards, parts sized by bytes before that (as adaptive execution joins them) would hold too much."""
    parts = max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media, turn, pos, word, speaker, start_ms, end_ms). Turns are summed up first, so that the window over a
    conversation sees a row for each turn, and the one over words sees one turn."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media"), "turn", F.col("role").alias("speaker"), "text")
    turns = dealt(given, "media", TURNS).select("media", "turn", "speaker", X.tokens(F.col("text")).alias("w"))
    lasts = lambda w: (120 + 40 * F.length(w)).cast("long")
    pause = lambda w: F.when(w.rlike("[.?!]$"), 700).when(w.rlike("[,;:]$"), 300).otherwise(80).cast("long")
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + lasts(w) + pause(w))
    before = W.partitionBy("media").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    placed = turns.withColumns({"t0": F.coalesce(F.sum(total).over(before), F.lit(0)), "p0": F.coalesce(F.sum(F.size("w")).over(before), F.lit(0))})
    rows = placed.select("media", "turn", "speaker", "t0", "p0", F.posexplode("w").alias("i", "word"))
    inside = W.partitionBy("media", "turn").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("t0") + F.coalesce(F.sum(lasts(F.col("word")) + pause(F.col("word"))).over(inside), F.lit(0))
    return rows.select("media", "turn", (F.col("p0") + F.col("i") + 1).cast("long").alias("pos"), "word", "speaker", start.alias("start_ms"), (start + lasts(F.col("word"))).alias("end_ms"))


def phrase_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.phrases(words(spark, sf_dir))


WORDS_SQL = r"""
t0 AS (SELECT conv_id AS media, turn, role AS speaker, string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ') AS a FROM conversations),
t1 AS (SELECT media, turn, speaker, unnest(range(len(a))) AS i, unnest(a) AS word FROM t0),
t2 AS (SELECT *, 120 + 40 * length(word) AS lasts, CASE WHEN regexp_matches(word, '[.?!]$') THEN 700 WHEN regexp_matches(word, '[,;:]$') THEN 300 ELSE 80 END AS pause FROM t1 WHERE word <> ''),
t3 AS (SELECT *, row_number() OVER w AS pos, sum(lasts + pause) OVER w - lasts - pause AS s FROM t2 WINDOW w AS (PARTITION BY media ORDER BY turn, i ROWS UNBOUNDED PRECEDING)),
words AS (SELECT media, turn, CAST(pos AS BIGINT) AS pos, word, speaker, CAST(s AS BIGINT) AS start_ms, CAST(s + lasts AS BIGINT) AS end_ms FROM t3)"""
PHRASES_SQL = (
    WORDS_SQL
    + r""",
p1 AS (SELECT *, coalesce(CAST(start_ms - lag(end_ms) OVER w >= 500 AS INT), 0) AS silent FROM words WINDOW w AS (PARTITION BY media ORDER BY pos)),
p2 AS (SELECT *, sum(silent) OVER (PARTITION BY media ORDER BY pos) AS stretch FROM p1),
p3 AS (SELECT *, row_number() OVER w AS k, last_value(speaker IGNORE NULLS) OVER (PARTITION BY media, stretch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p2 WINDOW w AS (PARTITION BY media, stretch ORDER BY pos)),
p4 AS (SELECT *, sum(CASE WHEN k = 1 OR coalesce(prev <> speaker, false) THEN 1 ELSE 0 END) OVER (PARTITION BY media ORDER BY pos) AS phrase_id FROM p3),
phrases AS (SELECT media, CAST(phrase_id AS BIGINT) AS phrase_id, arg_min(speaker, pos) FILTER (WHERE speaker IS NOT NULL) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words,
  regexp_replace(string_agg(word, ' ' ORDER BY pos), ' ([,.?!])', '\1', 'g') AS text FROM p4 GROUP BY media, phrase_id)"""
)


def _slice_sql(s: str, e: str, k: str, n: str) -> str:
    return f"CAST({s} + (2 * ({e} - {s}) * {k} + {n}) // (2 * {n}) AS BIGINT)"


def _code_sql(ms: str, point: str) -> str:
    return f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '{point}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


def _sec_sql(ms: str) -> str:
    return f"CAST({ms} // 1000 AS VARCHAR) || '.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


# --- timelines and islands ---


@query(f"WITH {WORDS_SQL} SELECT * FROM words")
def words_timeline(spark, sf_dir):
    return words(spark, sf_dir)


@query(f"WITH {PHRASES_SQL} SELECT media, phrase_id, speaker, start_ms, end_ms, n_words FROM phrases")
def phrases(spark, sf_dir):
    return phrase_cues(spark, sf_dir).drop("text")


@query(f"WITH {PHRASES_SQL} SELECT media, phrase_id, text FROM phrases")
def phrase_text(spark, sf_dir):
    return phrase_cues(spark, sf_dir).select("media", "phrase_id", "text")


@query(
    f"""WITH {WORDS_SQL}, r AS (SELECT media, min(start_ms) - 500 AS a, max(end_ms) + 500 AS z FROM words GROUP BY media),
x AS (SELECT media, a, z, start_ms, greatest(coalesce(max(end_ms) OVER (PARTITION BY media ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a), a) AS b FROM words JOIN r USING (media)),
y AS (SELECT media, b AS start_ms, greatest(a, start_ms) AS end_ms FROM x UNION ALL SELECT media, z - 500, z FROM r)
SELECT * FROM y WHERE end_ms - start_ms >= 400"""
)
def silences(spark, sf_dir):
    w = words(spark, sf_dir)
    ranges = w.groupBy("media").agg((F.min("start_ms") - 500).alias("range_start"), (F.max("end_ms") + 500).alias("range_end"))
    return islands.silences(w, ranges)


def _event_words(spark, sf_dir) -> DataFrame:
    """Events of each user as words: views have no speaker, others their type."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media"), F.col("event_id").alias("pos"), ms.alias("start_ms"), (ms + 1000).alias("end_ms"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("speaker"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("word"))


EVENTS_SQL = "e AS (SELECT user_id AS media, event_id AS pos, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 1000 AS end_ms, CASE WHEN event_type <> 'view' THEN event_type END AS speaker, 'e' || CAST(event_id AS VARCHAR) AS word FROM events)"


@query(
    f"""WITH {EVENTS_SQL},
f AS (SELECT *, coalesce(last_value(speaker IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(speaker IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS s FROM e WINDOW w AS (PARTITION BY media ORDER BY start_ms, pos)),
g AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(s) OVER w IS DISTINCT FROM s THEN 1 ELSE 0 END AS n FROM f WINDOW w AS (PARTITION BY media ORDER BY start_ms, pos)),
h AS (SELECT *, sum(n) OVER (PARTITION BY media ORDER BY start_ms, pos) AS segment_id FROM g)
SELECT media, CAST(segment_id AS BIGINT) AS segment_id, any_value(s) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, pos)) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY start_ms, pos) AS text FROM h GROUP BY media, segment_id"""
)
def speaker_segments(spark, sf_dir):
    return islands.speaker_segments(_event_words(spark, sf_dir), order=("start_ms", "pos"))


@query(
    f"""WITH {EVENTS_SQL},
g AS (SELECT *, CASE WHEN coalesce(start_ms - lag(end_ms) OVER w >= 1800000, true) THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY media ORDER BY start_ms, pos)),
h AS (SELECT *, sum(n) OVER (PARTITION BY media ORDER BY start_ms, pos) AS island FROM g)
SELECT media, CAST(island AS BIGINT) AS island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_cues, string_agg(word, ' ' ORDER BY start_ms, pos) AS text FROM h GROUP BY media, island"""
)
def merged_cues(spark, sf_dir):
    cues = _event_words(spark, sf_dir).withColumnRenamed("word", "text")
    return islands.merged_cues(cues, 1_800_000, order=("start_ms", "pos"))


CHUNK_SQL = "c1 AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[{breaks}]$') THEN 1 ELSE 0 END) OVER ({key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM {source}),\nc2 AS (SELECT *, CASE WHEN (row_number() OVER ({key}, run ORDER BY pos) - 1) % 2 = 0 THEN 1 ELSE 0 END AS n FROM c1),\nc3 AS (SELECT *, CAST(sum(n) OVER ({key} ORDER BY pos) AS BIGINT) AS chunk FROM c2)"


@query(f"WITH {WORDS_SQL}, {CHUNK_SQL.format(breaks='.,!?;:', key='PARTITION BY media, turn', source='words')} SELECT media, turn, chunk, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM c3 GROUP BY media, turn, chunk")
def two_word_chunks(spark, sf_dir):
    return islands.with_chunk(words(spark, sf_dir), ("media", "turn")).groupBy("media", "turn", "chunk").agg(F.count(F.lit(1)).alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(
    f"""WITH {PHRASES_SQL},
w0 AS (SELECT media, phrase_id, start_ms, end_ms, string_split(text, ' ') AS a FROM phrases),
w1 AS (SELECT media, phrase_id, start_ms, end_ms, unnest(range(len(a))) AS pos, unnest(a) AS word FROM w0),
{CHUNK_SQL.format(breaks='.!?。！？;:;,，、', key='PARTITION BY media, phrase_id', source='w1')},
g AS (SELECT media, phrase_id, chunk, any_value(start_ms) AS s, any_value(end_ms) AS e, string_agg(word, ' ' ORDER BY pos) AS t FROM c3 GROUP BY media, phrase_id, chunk),
h AS (SELECT *, count(*) OVER (PARTITION BY media, phrase_id) AS n FROM g)
SELECT media, phrase_id, chunk, {_slice_sql('s', 'e', '(chunk - 1)', 'n')} AS start_ms, {_slice_sql('s', 'e', 'chunk', 'n')} AS end_ms, upper(replace(regexp_replace(t, '[;:,，、]+$', ''), 'ß', 'SS')) AS text FROM h"""
)
def caption_even_timing(spark, sf_dir):
    return islands.bold_captions(phrase_cues(spark, sf_dir), ("media", "phrase_id"))


@query(
    f"""WITH RECURSIVE {PHRASES_SQL},
m1 AS (SELECT *, CASE WHEN coalesce(start_ms - lag(end_ms) OVER (PARTITION BY media ORDER BY phrase_id) >= 600, true) THEN 1 ELSE 0 END AS n FROM phrases),
m2 AS (SELECT *, sum(n) OVER (PARTITION BY media ORDER BY phrase_id) AS island FROM m1),
m3 AS (SELECT media, island, min(start_ms) AS s, max(end_ms) AS e, string_split(string_agg(text, ' ' ORDER BY phrase_id), ' ') AS w FROM m2 GROUP BY media, island),
f AS (SELECT media, island, 0 AS k, 0 AS n, CAST([] AS INT[]) AS sizes FROM m3
  UNION ALL SELECT f.media, f.island, k + 1,
    CASE WHEN n + 1 >= 7 OR regexp_matches(w[k + 1], '[.!?。！？]$') OR (n + 1 >= 4 AND regexp_matches(w[k + 1], '[;:,，、]$')) THEN 0 ELSE n + 1 END,
    CASE WHEN n + 1 >= 7 OR regexp_matches(w[k + 1], '[.!?。！？]$') OR (n + 1 >= 4 AND regexp_matches(w[k + 1], '[;:,，、]$')) THEN list_append(sizes, n + 1) ELSE sizes END
  FROM f JOIN m3 ON f.media = m3.media AND f.island = m3.island WHERE k < len(w)),
z AS (SELECT f.media, f.island, s, e, w, CASE WHEN n = 0 THEN sizes WHEN len(sizes) > 0 AND n < 4 AND sizes[len(sizes)] + n <= 7 THEN list_append(sizes[1:len(sizes) - 1], sizes[len(sizes)] + n) ELSE list_append(sizes, n) END AS sizes
  FROM f JOIN m3 ON f.media = m3.media AND f.island = m3.island WHERE k = len(w)),
y AS (SELECT *, unnest(range(1, len(sizes) + 1)) AS chunk FROM z)
SELECT media, CAST(island AS BIGINT) AS island, CAST(chunk AS BIGINT) AS chunk, {_slice_sql('s', 'e', '(chunk - 1)', 'len(sizes)')} AS start_ms, {_slice_sql('s', 'e', 'chunk', 'len(sizes)')} AS end_ms,
  CAST(sizes[chunk] AS BIGINT) AS n_words, array_to_string(w[list_sum(sizes[1:chunk]) - sizes[chunk] + 1:list_sum(sizes[1:chunk])], ' ') AS text FROM y"""
)
def natural_chunks(spark, sf_dir):
    merged = islands.merged_cues(phrase_cues(spark, sf_dir), 600, order=("phrase_id",))
    made = folds.natural_captions(merged, ("media", "island"))
    # The first letter's case is left out: phrases start with letters whose upper case engines differ on.
    source = merged.select("media", "island", X.tokens(F.col("text")).alias("w"))
    sized = made.withColumn("n_words", F.size(X.tokens(F.col("text"))).cast("long"))
    upto = F.sum("n_words").over(W.partitionBy("media", "island").orderBy("chunk"))
    return sized.withColumn("upto", upto).join(source, ["media", "island"]).select("media", "island", F.col("chunk").cast("long").alias("chunk"), "start_ms", "end_ms", "n_words", F.array_join(F.slice("w", (F.col("upto") - F.col("n_words") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("text"))


def _turn_segments(spark, sf_dir) -> DataFrame:
    """Each turn as one transcript segment with word times."""
    w = words(spark, sf_dir)
    spaced = F.concat(F.when(F.col("pos") == F.min("pos").over(W.partitionBy("media", "turn")), "").otherwise(" "), F.col("word"))
    one = w.withColumn("word", spaced).groupBy("media", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"), F.sort_array(F.collect_list(F.struct("pos", "word", "start_ms", "end_ms"))).alias("w"))
    return one.select("media", "turn", "start_ms", "end_ms", "speaker", F.array_join(F.transform("w", lambda x: x["word"]), "").alias("text"), F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))).alias("words"))


@query(
    f"""WITH RECURSIVE {WORDS_SQL},
seg AS (SELECT media, turn, any_value(speaker) AS speaker, list(word ORDER BY pos) AS w, list(start_ms ORDER BY pos) AS s, list(end_ms ORDER BY pos) AS e, count(*) AS n FROM words GROUP BY media, turn),
f AS (SELECT media, turn, CAST(1 AS BIGINT) AS b, CAST(1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS rem, CAST([] AS STRUCT(a BIGINT, z BIGINT)[]) AS blocks FROM seg
  UNION ALL SELECT media, turn, coalesce(z + 1, b), coalesce(z, i) + 1, CASE WHEN z IS NULL THEN r2 END, CASE WHEN z IS NULL THEN blocks ELSE list_append(blocks, {{'a': b, 'z': z}}) END FROM (
    SELECT *, CASE WHEN fits AND (i = n OR (good AND lasts >= 4000)) THEN i WHEN NOT fits THEN CASE WHEN coalesce(r2, greatest(b, i - 1)) = i AND i > b THEN i - 1 ELSE coalesce(r2, greatest(b, i - 1)) END END AS z FROM (
      SELECT *, CASE WHEN good THEN i ELSE rem END AS r2, lasts <= 5000 AND i - b + 1 <= 14 AND list_sum(list_transform(w[b:i], lambda x: length(x))) + i - b <= 84 AS fits FROM (
        SELECT f.*, seg.w, seg.n, i >= n OR regexp_matches(w[i], '[.?!;:,]$') OR s[i + 1] - e[i] >= 450 AS good, greatest(e[i] - s[b], 0) AS lasts FROM f JOIN seg ON seg.media = f.media AND seg.turn = f.turn WHERE b <= n)))),
bl AS (SELECT f.media, f.turn, unnest(range(1, len(blocks) + 1)) AS k, unnest(blocks) AS x FROM f JOIN seg ON seg.media = f.media AND seg.turn = f.turn WHERE b = n + 1),
c AS (SELECT bl.media, bl.turn, k, speaker, s[x.a] AS s, e[x.z] AS e, array_to_string(w[x.a:x.z], ' ') AS t, x.z - x.a + 1 AS n FROM bl JOIN seg ON seg.media = bl.media AND seg.turn = bl.turn),
g AS (SELECT media, turn, k, speaker, CAST(1 AS BIGINT) AS block, s, e, t, n FROM c WHERE k = 1
  UNION ALL SELECT c.media, c.turn, c.k, c.speaker, CASE WHEN tiny THEN block ELSE block + 1 END, CASE WHEN tiny THEN p.s ELSE c.s END, c.e, CASE WHEN tiny THEN p.t || ' ' || c.t ELSE c.t END, CASE WHEN tiny THEN p.n + c.n ELSE c.n END
  FROM c JOIN (SELECT g.*, g.k + 1 AS nxt FROM g) p ON p.media = c.media AND p.turn = c.turn AND c.k = p.nxt, LATERAL (SELECT c.e - c.s < 1000 AND length(p.t) + 1 + length(c.t) <= 84 AND c.e - p.s <= 5000 AND p.n + c.n <= 14 AS tiny))
SELECT media, turn, CAST(block AS INT) AS block, min(s) AS start_ms, max(e) AS end_ms, arg_max(t, k) AS text, CAST(arg_max(n, k) AS INT) AS n_words, any_value(speaker) AS speaker FROM g GROUP BY media, turn, block"""
)
def captions_split(spark, sf_dir):
    return folds.captions(_turn_segments(spark, sf_dir), ("media", "turn"))


@query(
    f"""WITH RECURSIVE {PHRASES_SQL},
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY media ORDER BY phrase_id) AS BIGINT) AS cue, regexp_matches(regexp_replace(text, '["'')\\]}}”’]+$', ''), '[.!?。！？]$') AS fin FROM phrases),
f AS (SELECT media, cue, start_ms, end_ms, text, 1 AS window_id, 1 AS n, start_ms AS first,
    CASE WHEN end_ms - start_ms >= 18000 THEN true WHEN end_ms - start_ms < 6000 THEN false ELSE fin OR end_ms - start_ms >= 12000 END AS closed FROM c WHERE cue = 1
  UNION ALL SELECT c.media, c.cue, c.start_ms, c.end_ms, c.text, CASE WHEN closed THEN window_id + 1 ELSE window_id END, CASE WHEN closed THEN 1 ELSE n + 1 END, CASE WHEN closed THEN c.start_ms ELSE first END,
    CASE WHEN c.end_ms - CASE WHEN closed THEN c.start_ms ELSE first END >= 18000 OR CASE WHEN closed THEN 1 ELSE n + 1 END >= 6 THEN true
      WHEN c.end_ms - CASE WHEN closed THEN c.start_ms ELSE first END < 6000 THEN false ELSE c.fin OR c.end_ms - CASE WHEN closed THEN c.start_ms ELSE first END >= 12000 END
  FROM f JOIN c ON c.media = f.media AND c.cue = f.cue + 1)
SELECT media, CAST(window_id AS BIGINT) AS window_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_cues, min(cue) AS cue_first, max(cue) AS cue_last, string_agg(text, ' ' ORDER BY cue) AS source_text FROM f GROUP BY media, window_id"""
)
def translation_windows(spark, sf_dir):
    return _windows(spark, sf_dir).withColumn("window_id", F.col("window_id").cast("long"))


def _windows(spark, sf_dir) -> DataFrame:
    cues = phrase_cues(spark, sf_dir).withColumn("cue", F.row_number().over(W.partitionBy("media").orderBy("phrase_id")))
    return folds.translation_windows(cues)


@query(
    ORACLES["translation_windows"].rsplit("\nSELECT media, CAST(window_id", 1)[0]
    + """,
win AS (SELECT media, window_id, min(start_ms) AS s, max(end_ms) AS e, string_agg(text, ' ' ORDER BY cue) AS t FROM f GROUP BY media, window_id),
h AS (SELECT media, window_id, 1 AS i, '' AS held, CAST([] AS VARCHAR[]) AS cl, t FROM win
  UNION ALL SELECT media, window_id, i + 1, CASE WHEN shut THEN '' ELSE now END, CASE WHEN shut THEN list_append(cl, trim(now)) ELSE cl END, t FROM (
    SELECT *, regexp_matches(t[i], '[.!?。！？]') OR (regexp_matches(t[i], '[;:,，、]') AND length(trim(now)) >= 24) AS shut FROM (SELECT *, held || t[i] AS now FROM h WHERE i <= length(t)))),
cl AS (SELECT media, window_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS c FROM (SELECT media, window_id, list_filter(list_append(cl, trim(held)), lambda y: y <> '') AS x FROM h WHERE i = length(t) + 1)),
cw AS (SELECT *, string_split(c, ' ') AS w FROM cl),
l AS (SELECT media, window_id, k, w, 2 AS i, [w[1]] AS lines FROM cw WHERE len(w) > 1 AND length(c) > 84
  UNION ALL SELECT media, window_id, k, w, i + 1, CASE WHEN length(lines[len(lines)]) + 1 + length(w[i]) > 84 THEN list_append(lines, w[i]) ELSE list_append(lines[1:len(lines) - 1], lines[len(lines)] || ' ' || w[i]) END FROM l WHERE i <= len(w)),
lines AS (SELECT media, window_id, k, lines FROM l WHERE i = len(w) + 1
  UNION ALL SELECT media, window_id, k, CASE WHEN len(w) > 1 OR length(c) <= 24 THEN [c] ELSE list_transform(range(0, (length(c) + 23) // 24), lambda j: c[j * 24 + 1:j * 24 + 24]) END FROM cw WHERE NOT (len(w) > 1 AND length(c) > 84)),
m0 AS (SELECT media, window_id, flatten(list(lines ORDER BY k)) AS b FROM lines GROUP BY media, window_id),
m AS (SELECT m0.media, m0.window_id, s, e, b, false AS done FROM m0 JOIN win USING (media, window_id)
  UNION ALL SELECT media, window_id, s, e, CASE WHEN stop THEN b ELSE list_concat(list_append(b[1:p - 1], b[p] || ' ' || b[p + 1]), b[p + 2:]) END, stop FROM (
    SELECT *, len(b) <= 1 OR (e - s) * least_w >= 1000 * list_sum(v) AS stop, CASE WHEN j > 1 AND (j = len(b) OR v[j - 1] <= v[j + 1]) THEN j - 1 ELSE j END AS p FROM (
      SELECT *, list_min(v) AS least_w, list_position(v, list_min(v)) AS j FROM (SELECT *, list_transform(b, lambda y: greatest(length(replace(y, ' ', '')), 1)) AS v FROM m WHERE NOT done))))
SELECT media, CAST(window_id AS BIGINT) AS window_id, CAST(unnest(range(1, len(b) + 1)) AS INT) AS block, s AS start_ms, e AS end_ms, unnest(b) AS text FROM m WHERE done"""
)
def clauses_wrap(spark, sf_dir):
    windows = _windows(spark, sf_dir).withColumnRenamed("source_text", "translated_text")
    return folds.translated_blocks(windows, ("media", "window_id"))


@query(
    f"""WITH {PHRASES_SQL},
b AS (SELECT media, phrase_id, speaker, start_ms, end_ms, greatest(length(replace(text, ' ', '')), 1) AS w, row_number() OVER (PARTITION BY media ORDER BY phrase_id) AS k FROM phrases),
g AS (SELECT *, (k - 1) // 4 AS win FROM b),
h AS (SELECT *, min(start_ms) OVER p AS s, max(end_ms) OVER p AS e, sum(w) OVER p AS total, sum(w) OVER (PARTITION BY media, win ORDER BY phrase_id ROWS UNBOUNDED PRECEDING) AS upto FROM g WINDOW p AS (PARTITION BY media, win))
SELECT media, CAST(win AS BIGINT) AS win, phrase_id, CAST(s + (2 * (e - s) * (upto - w) + total) // (2 * total) AS BIGINT) AS start_ms, CAST(s + (2 * (e - s) * upto + total) // (2 * total) AS BIGINT) AS end_ms FROM h"""
)
def window_allocation(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("media").orderBy("phrase_id"))
    b = phrase_cues(spark, sf_dir).withColumn("win", F.floor((k - 1) / 4).cast("long"))
    p = W.partitionBy("media", "win")
    blocks = b.select("media", "win", "phrase_id", "text", F.min("start_ms").over(p).alias("start_ms"), F.max("end_ms").over(p).alias("end_ms"))
    return islands.allocated(blocks, ("media", "win"), "phrase_id").drop("text")


# --- edit decision lists ---


class Edit:
    """An edit of each conversation: every phrase is a range, cut a little inside the phrase."""

    def __init__(self, spark, sf_dir):
        self.words = words(spark, sf_dir)

    @cached_property
    def ranges(self) -> DataFrame:
        p = islands.phrases(self.words)
        return p.select(F.col("media").alias("edl"), (F.col("phrase_id") - 1).alias("range_idx"), F.col("media").alias("source"), (F.col("start_ms") + 60).alias("start_ms"), F.greatest(F.col("end_ms") - 40, F.col("start_ms") + 61).alias("end_ms"))

    @cached_property
    def range_words(self) -> DataFrame:
        w = self.words.select(F.col("media").alias("source"), "pos", "word", F.col("start_ms").alias("word_start"), F.col("end_ms").alias("word_end"))
        return edl.ranges_with_words(self.ranges, w)

    @cached_property
    def bounds(self) -> DataFrame:
        lengths = self.words.groupBy(F.col("media").alias("source")).agg((F.max("end_ms") + 10).alias("duration_ms"))
        return edl.snapped_and_padded(self.range_words, lengths)


RANGES_SQL = (
    PHRASES_SQL
    + """,
ranges AS (SELECT media AS edl, phrase_id - 1 AS range_idx, media AS source, start_ms + 60 AS start_ms, greatest(end_ms - 40, start_ms + 61) AS end_ms FROM phrases),
joined AS (SELECT r.*, w.pos, w.word, w.start_ms AS word_start, w.end_ms AS word_end FROM ranges r LEFT JOIN words w ON w.media = r.source AND w.end_ms > r.start_ms AND w.start_ms < r.end_ms)"""
)
BOUNDS_SQL = (
    RANGES_SQL
    + """,
ends AS (SELECT media AS source, max(end_ms) + 10 AS duration_ms FROM words GROUP BY media),
snapped AS (SELECT edl, range_idx, any_value(source) AS source, any_value(start_ms) AS start_ms, any_value(end_ms) AS end_ms, least(any_value(start_ms), min(word_start)) AS s, greatest(any_value(end_ms), max(word_end)) AS e, count(pos) AS n_words FROM joined GROUP BY edl, range_idx),
bounds AS (SELECT edl, range_idx, source, start_ms, end_ms, greatest(s - 30, 0) AS cut_start, greatest(least(e + 30, duration_ms), greatest(s - 30, 0)) AS cut_end, n_words FROM snapped LEFT JOIN ends USING (source))"""
)


@query(f"WITH {RANGES_SQL} SELECT edl, range_idx, source, start_ms, end_ms, pos, word, word_start, word_end FROM joined")
def edl_range_words(spark, sf_dir):
    return Edit(spark, sf_dir).range_words


@query(f"WITH {BOUNDS_SQL} SELECT * FROM bounds")
def snap_and_pad(spark, sf_dir):
    return Edit(spark, sf_dir).bounds


@query(
    f"""WITH {BOUNDS_SQL},
placed AS (SELECT *, coalesce(sum(greatest(cut_end - cut_start, 0)) OVER (PARTITION BY edl ORDER BY range_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM bounds),
jw AS (SELECT * FROM joined WHERE pos IS NOT NULL),
{CHUNK_SQL.format(breaks='.,!?;:', key='PARTITION BY edl, range_idx', source='jw')},
g AS (SELECT edl, range_idx, chunk, min(word_start) AS ws, max(word_end) AS we, string_agg(word, ' ' ORDER BY pos) AS t FROM c3 GROUP BY edl, range_idx, chunk),
h AS (SELECT g.*, greatest(ws - cut_start, 0) + off AS b, least(we, cut_end) - cut_start + off AS z FROM g JOIN placed USING (edl, range_idx) WHERE cut_end > cut_start)
SELECT edl, CAST(row_number() OVER (PARTITION BY edl ORDER BY b, range_idx, chunk) AS BIGINT) AS cue, range_idx, chunk, CAST(b AS BIGINT) AS start_ms, CAST(CASE WHEN z <= b THEN b + 400 ELSE z END AS BIGINT) AS end_ms,
  {_code_sql('CAST(b AS BIGINT)', ',')} AS srt_start FROM h"""
)
def master_srt(spark, sf_dir):
    edit = Edit(spark, sf_dir)
    cues = edl.master_cues(edit.bounds, edit.range_words)
    return cues.select("edl", F.col("cue").cast("long").alias("cue"), "range_idx", "chunk", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), X.srt_time(F.col("start_ms")).alias("srt_start"))


@query(
    f"""WITH {WORDS_SQL}, r AS (SELECT media + 1 AS edl, 'A' AS source, media AS medium, max(end_ms) // 2 AS cut FROM words GROUP BY media UNION ALL SELECT media, 'B', media, max(end_ms) // 3 FROM words GROUP BY media),
j AS (SELECT edl, r.source, medium, cut, w.pos, w.start_ms AS ws, w.end_ms AS we FROM r LEFT JOIN words w ON w.media = r.medium AND w.end_ms > cut AND w.start_ms < cut + 5000)
SELECT edl, source, count(pos) AS n_words, CAST(greatest(least(any_value(cut), min(ws)) - 30, 0) AS BIGINT) AS cut_start, CAST(greatest(any_value(cut) + 5000, max(we)) + 30 AS BIGINT) AS cut_end FROM j GROUP BY edl, source"""
)
def shared_source_names(spark, sf_dir):
    """Every edit calls its own conversation B and its neighbour's A: a name says nothing outside its edit."""
    w = words(spark, sf_dir)
    ends = w.groupBy(F.col("media").alias("medium")).agg(F.max("end_ms").alias("z"))
    cut = lambda edit, name, idx, part: ends.select(edit.alias("edl"), F.lit(idx).alias("range_idx"), F.lit(name).alias("source"), "medium", F.floor(F.col("z") / part).cast("long").alias("start_ms"))
    ranges = cut(F.col("medium") + 1, "A", 0, 2).unionByName(cut(F.col("medium"), "B", 1, 3)).withColumn("end_ms", F.col("start_ms") + 5000)
    timed = w.select(F.col("media").alias("medium"), "pos", "word", F.col("start_ms").alias("word_start"), F.col("end_ms").alias("word_end"))
    bounds = edl.snapped_and_padded(edl.ranges_with_words(ranges, timed, source="medium"), source="medium")
    return bounds.join(ranges.select("edl", "range_idx", "source"), ["edl", "range_idx"]).select("edl", "source", "n_words", "cut_start", "cut_end")


@query(f"WITH {RANGES_SQL}, x AS (SELECT edl, range_idx, sum(end_ms - start_ms) OVER w AS boundary_ms, lead(range_idx) OVER w AS nxt FROM ranges WINDOW w AS (PARTITION BY edl ORDER BY range_idx)) SELECT edl, range_idx, CAST(boundary_ms AS BIGINT) AS boundary_ms FROM x WHERE nxt IS NOT NULL")
def cut_boundaries(spark, sf_dir):
    return islands.cut_boundaries(Edit(spark, sf_dir).ranges)


@query(f"SELECT o_orderkey AS k, {_code_sql('(o_orderkey * 7919 % 400000000)', ',')} AS srt, CAST(o_orderkey * 7919 % 400000000 AS BIGINT) AS back_ms FROM orders")
def srt_roundtrip(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), X.srt_time(F.col("o_orderkey") * 7919 % 400_000_000).alias("srt"))
    return made.withColumn("back_ms", X.parse_srt_time(F.col("srt")))


@query(
    """WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '12:x' ELSE CAST(o_orderkey % 7 AS VARCHAR) || ':' || CAST(o_orderkey % 60 AS VARCHAR) || ':' || CAST(o_custkey % 60 AS VARCHAR) END AS t, o_custkey % 60 AS s, o_orderkey % 60 AS m, o_orderkey % 7 AS h FROM orders)
SELECT k, t, CAST(CASE WHEN k % 5 >= 2 THEN (h * 3600 + m * 60 + s) * 1000 END AS BIGINT) AS ms FROM p"""
)
def time_parse(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = F.when(k % 5 == 0, "x").when(k % 5 == 1, "12:x").otherwise(F.concat_ws(":", (k % 7).cast("string"), (k % 60).cast("string"), (c % 60).cast("string")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), t.alias("t")).withColumn("ms", F.rint(X.parse_time(F.col("t")) * 1000).cast("long"))


def _edl_specs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits made of orders (a list), their lines (ranges) and their parts (sources), some of them broken."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    edls = o.select(k.alias("edl"), F.when(k % 97 != 0, F.when(k % 89 == 0, 2).otherwise(1)).alias("version"), F.when(k % 83 == 0, "loud").otherwise("auto").alias("grade"))
    lines = li.select(F.col("l_orderkey").alias("edl"), F.col("l_linenumber").alias("range_idx"), F.col("l_partkey").cast("string").alias("source"), F.when(F.col("l_partkey") % 71 != 0, F.col("l_quantity")).alias("start"), (F.col("l_quantity") + F.col("l_suppkey") % 10 - 1).alias("end"), F.when(F.col("l_partkey") % 7 == 0, F.col("l_returnflag")).otherwise("subtle").alias("grade"))
    sources = li.where("l_suppkey % 11 <> 0").select(F.col("l_orderkey").alias("edl"), F.col("l_partkey").cast("string").alias("source"))
    return edls, lines, sources


@query(
    """WITH r AS (SELECT l_orderkey AS edl, l_linenumber AS range_idx, CAST(l_partkey AS VARCHAR) AS source, CASE WHEN l_partkey % 71 <> 0 THEN l_quantity END AS s, l_quantity + l_suppkey % 10 - 1 AS e, CASE WHEN l_partkey % 7 = 0 THEN l_returnflag ELSE 'subtle' END AS grade FROM lineitem),
src AS (SELECT l_orderkey AS edl, CAST(l_partkey AS VARCHAR) AS source, count(*) AS n FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY 1, 2),
o AS (SELECT o_orderkey AS edl, CASE WHEN o_orderkey % 97 <> 0 THEN CASE WHEN o_orderkey % 89 = 0 THEN 2 ELSE 1 END END AS version, CASE WHEN o_orderkey % 83 = 0 THEN 'loud' ELSE 'auto' END AS grade FROM orders),
v AS (
  SELECT edl, -1 AS range_idx, 1 AS rule FROM o WHERE version IS NULL UNION ALL SELECT edl, -1, 2 FROM o WHERE version <> 1
  UNION ALL SELECT DISTINCT edl, -1, 3 FROM src JOIN o USING (edl) WHERE n > 1
  UNION ALL SELECT edl, -1, 4 FROM o WHERE edl NOT IN (SELECT edl FROM r) UNION ALL SELECT edl, -1, 20 FROM o WHERE grade = 'loud'
  UNION ALL SELECT edl, range_idx, 10 FROM r WHERE s IS NULL UNION ALL SELECT r.edl, range_idx, 11 FROM r LEFT JOIN src USING (edl, source) WHERE src.n IS NULL
  UNION ALL SELECT edl, range_idx, 13 FROM r WHERE e <= s UNION ALL SELECT edl, range_idx, 14 FROM r WHERE grade NOT IN ('auto', 'subtle', 'neutral_punch', 'warm_cinematic', 'none'))
SELECT edl, CAST(range_idx AS INT) AS range_idx, CAST(rule AS INT) AS rule FROM v"""
)
def edl_violations(spark, sf_dir):
    edls, ranges, sources = _edl_specs(spark, sf_dir)
    return edl.range_violations(edls, ranges, sources).drop("message")


def _overlays(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    null = lambda c, every: F.when(k % every != 0, c)
    return p.select(
        (k % 100).alias("edl"), k.alias("overlay_idx"), F.when(k % 3 == 0, F.concat(F.lit("/o/"), k.cast("string"), F.when(k % 2 == 0, ".png").otherwise(".mov"))).alias("source"),
        F.when((k % 3 != 0) | (k % 31 == 0), F.when(k % 13 == 0, "image").when(k % 2 == 0, "text").otherwise("counter")).alias("card_type"), null(F.col("p_name"), 10).alias("card_text"), null(F.col("p_size").cast("double"), 9).alias("counter_start"), F.col("p_size").cast("double").alias("counter_end"),
        F.when(k % 17 == 0, -1.0).otherwise(640.0).alias("width"), F.lit(360.0).alias("height"), F.when(k % 19 == 0, 0.0).otherwise(48.0).alias("font_size"), null((F.col("p_size") - 2).cast("double"), 23).alias("start"), (F.col("p_size") + k % 20 - 4).cast("double").alias("end"), F.when(k % 4 == 0, "sync").when(k % 4 == 1, "beat").when(k % 29 == 0, "loop").alias("duration_type"),
    )


@query(
    """WITH o AS (SELECT p_partkey AS k, p_partkey % 100 AS edl, p_partkey % 3 = 0 AS has_source,
  CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 31 = 0 THEN CASE WHEN p_partkey % 13 = 0 THEN 'image' WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'counter' END END AS ct, p_partkey % 10 <> 0 AS has_text, p_partkey % 9 <> 0 AS has_count,
  CASE WHEN p_partkey % 23 <> 0 THEN p_size - 2 END AS s, p_size + p_partkey % 20 - 4 AS e, CASE WHEN p_partkey % 4 = 0 THEN 'sync' WHEN p_partkey % 4 = 1 THEN 'beat' WHEN p_partkey % 29 = 0 THEN 'loop' END AS d FROM part),
v AS (SELECT edl, k, 1 AS rule FROM o WHERE NOT has_source AND ct IS NULL UNION ALL SELECT edl, k, 2 FROM o WHERE has_source AND ct IS NOT NULL UNION ALL SELECT edl, k, 3 FROM o WHERE ct = 'image'
  UNION ALL SELECT edl, k, 4 FROM o WHERE ct = 'text' AND NOT has_text UNION ALL SELECT edl, k, 5 FROM o WHERE ct = 'counter' AND NOT has_count UNION ALL SELECT edl, k, 6 FROM o WHERE k % 17 = 0
  UNION ALL SELECT edl, k, 7 FROM o WHERE k % 19 = 0 UNION ALL SELECT edl, k, 8 FROM o WHERE s IS NULL UNION ALL SELECT edl, k, 10 FROM o WHERE s < 0 UNION ALL SELECT edl, k, 11 FROM o WHERE e <= s
  UNION ALL SELECT edl, k, 12 FROM o WHERE d = 'loop' UNION ALL SELECT edl, k, 13 FROM o WHERE d = 'sync' AND (e - s < 3 OR e - s > 14) UNION ALL SELECT edl, k, 14 FROM o WHERE d = 'beat' AND (e - s < 0.5 OR e - s > 2))
SELECT edl, k AS overlay_idx, CAST(rule AS INT) AS rule FROM v"""
)
def overlay_violations(spark, sf_dir):
    return edl.overlay_violations(_overlays(spark, sf_dir)).drop("message")


@query(
    f"""WITH {BOUNDS_SQL}, d AS (SELECT *, cut_end - cut_start AS n FROM bounds)
SELECT edl, range_idx, 'ffmpeg|-y|-ss|' || {_sec_sql('cut_start')} || '|-i|/media/' || CAST(source AS VARCHAR) || '.mov|-t|' || {_sec_sql('n')} || '|-vf|scale=1920:-2' || CASE WHEN edl % 3 = 0 THEN ',eq=contrast=1.03:saturation=0.98' ELSE '' END
  || CASE WHEN edl % 2 = 0 THEN CASE WHEN n >= 60 THEN '|-af|afade=t=in:st=0:d=0.03,afade=t=out:st=' || {_sec_sql('(n - 30)')} || ':d=0.03' ELSE '' END || '|-c:a|aac|-b:a|192k|-ar|48000' ELSE '|-an' END
  || '|-c:v|libx264|-preset|fast|-crf|20|-pix_fmt|yuv420p|-movflags|+faststart|/clips/seg_' || CASE WHEN range_idx < 100 THEN lpad(CAST(range_idx AS VARCHAR), 2, '0') ELSE CAST(range_idx AS VARCHAR) END || '_' || CAST(source AS VARCHAR) || '.mp4' AS plan FROM d"""
)
def segment_plan(spark, sf_dir):
    b = Edit(spark, sf_dir).bounds
    source = F.concat(F.lit("/media/"), F.col("source").cast("string"), F.lit(".mov"))
    grade = ffmpeg.resolved_grade(F.when(F.col("edl") % 3 == 0, "subtle"), F.lit(None).cast("string"))
    plan = ffmpeg.extract_segment(source, F.col("cut_start"), F.col("cut_end") - F.col("cut_start"), grade, F.concat(F.lit("/clips/"), ffmpeg.segment_name(F.col("range_idx"), source)), F.col("edl") % 2 == 0)
    return b.select("edl", "range_idx", F.array_join(plan, "|").alias("plan"))


@query(
    f"""WITH {BOUNDS_SQL} SELECT edl, string_agg('file ''/clips/' || CAST(range_idx AS VARCHAR) || '''\\''''.mp4''', chr(10) ORDER BY range_idx) || chr(10) AS document FROM bounds GROUP BY edl"""
)
def concat_manifest(spark, sf_dir):
    paths = Edit(spark, sf_dir).bounds.select("edl", "range_idx", F.concat(F.lit("/clips/"), F.col("range_idx").cast("string"), F.lit("'.mp4")).alias("path"))
    return sinks.concat_manifest(paths, "edl", "range_idx")


@query(
    f"""WITH o AS (SELECT p_partkey % 100 AS edl, p_partkey // 100 AS idx, CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '.mov' END AS ext, CAST(p_size * 1000 AS BIGINT) AS s, CAST(p_size * 1000 + 1500 AS BIGINT) AS e, p_size % 4 AS z FROM part),
r AS (SELECT *, row_number() OVER w AS rank, lag(idx) OVER w AS below FROM o WINDOW w AS (PARTITION BY edl ORDER BY z, idx))
SELECT edl, idx, rank, '[' || CAST(idx AS VARCHAR) || ':v]' || CASE WHEN ext = '.png' THEN 'fps=30,' ELSE '' END || 'scale=1920:-2,format=yuva420p,setpts=PTS-STARTPTS+' || {_sec_sql('s')} || '/TB[a' || CAST(idx AS VARCHAR) || ']' AS prepare,
  coalesce('[v' || CAST(below AS VARCHAR) || ']', '[0:v]') || '[a' || CAST(idx AS VARCHAR) || ']overlay=enable=''between(t,' || {_sec_sql('s')} || ',' || {_sec_sql('e')} || ')'':eof_action=pass:x=' || CAST(z * 10 AS VARCHAR) || ':y=0[v' || CAST(idx AS VARCHAR) || ']' AS compose FROM r"""
)
def overlay_chain(spark, sf_dir):
    k = F.col("p_partkey")
    o = table(spark, sf_dir, "part").select((k % 100).alias("edl"), F.floor(k / 100).cast("long").alias("idx"), F.concat(F.lit("/o/"), k.cast("string"), F.when(k % 2 == 0, ".png").otherwise(".mov")).alias("path"), (F.col("p_size") * 1000).alias("start_ms"), (F.col("p_size") * 1000 + 1500).alias("end_ms"), (F.col("p_size") % 4 * 10).alias("x"), F.lit(0).alias("y"), (F.col("p_size") % 4).cast("double").alias("z_order"))
    return ffmpeg.overlay_parts(o, base_width=1921).withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'scale=1,subtitles=a.srt' WHEN 1 THEN 'class=x' WHEN 2 THEN 'ass=a.ass' WHEN 3 THEN 'a;overlay=0:0' WHEN 4 THEN 'hue=s setpts=PTS' ELSE 'bass=g' END AS t FROM part)
SELECT k, t, CASE WHEN regexp_matches(t, '(^|[ ,;])subtitles=') THEN 'subtitles' WHEN regexp_matches(t, '(^|[ ,;])ass=') THEN 'ass' WHEN regexp_matches(t, '(^|[ ,;])overlay=') THEN 'overlay' WHEN regexp_matches(t, '(^|[ ,;])setpts=') THEN 'setpts' END AS early FROM f"""
)
def subtitle_guard(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 6 == 0, "scale=1,subtitles=a.srt").when(k % 6 == 1, "class=x").when(k % 6 == 2, "ass=a.ass").when(k % 6 == 3, "a;overlay=0:0").when(k % 6 == 4, "hue=s setpts=PTS").otherwise("bass=g")
    return table(spark, sf_dir, "part").select(k.alias("k"), t.alias("t")).withColumn("early", ffmpeg.early_filter(F.col("t")))


# --- signals and checks ---


@query(
    """WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n FROM embeddings),
b AS (SELECT vec_id, i // greatest(n // 16, 1) AS bin, sqrt(sum(x * x) / greatest(any_value(n) // 16, 1)) AS rms FROM s GROUP BY vec_id, i // greatest(n // 16, 1)),
p AS (SELECT *, max(rms) OVER (PARTITION BY vec_id) AS peak FROM b WHERE bin < 16)
SELECT vec_id, CAST(bin AS INT) AS bin, CAST(round_even(rms / peak * 100000, 0) AS BIGINT) AS level, CAST(round_even(peak * 100000, 0) AS BIGINT) AS raw_peak FROM p"""
)
def windowed_rms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", signal.envelope(F.col("embedding"), 16).alias("e"))
    return e.select("vec_id", F.posexplode("e.bins").alias("bin", "x"), F.rint(F.col("e.raw_peak") * 100_000).cast("long").alias("raw_peak")).select("vec_id", "bin", F.rint(F.col("x") * 100_000).cast("long").alias("level"), "raw_peak")


@query(
    """WITH a AS (SELECT vec_id, label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
d AS (SELECT vec_id, unnest(embedding) AS x, unnest(nxt) AS y FROM a WHERE nxt IS NOT NULL)
SELECT vec_id, CAST(round_even(avg(abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))) * 100000, 0) AS BIGINT) AS delta FROM d GROUP BY vec_id"""
)
def frame_delta(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return signal.with_next(vectors, "label", "vec_id", "embedding", 10_000, "nxt").where("nxt IS NOT NULL").select("vec_id", F.rint(signal.frame_delta(F.col("embedding"), F.col("nxt")) * 100_000).cast("long").alias("delta"))


@query(
    """WITH f AS (SELECT user_id AS clip, avg(CASE WHEN event_id % 4 = 0 THEN event_id % 256 END) AS a, avg(CASE WHEN event_id % 4 = 1 THEN event_id % 64 END) AS l, avg(CASE WHEN event_id % 4 = 2 THEN 200 + event_id % 56 END) AS h, avg(CASE WHEN event_id % 4 = 3 THEN event_id % 128 END) AS s FROM events GROUP BY user_id),
g AS (SELECT clip, CASE WHEN a IS NULL THEN 0.5 ELSE a / 255 END AS y, CASE WHEN a IS NULL THEN 0.7 ELSE (h - l) / 255 END AS r, CASE WHEN a IS NULL THEN 0.25 ELSE coalesce(s, 0) / 255 END AS s FROM f),
k AS (SELECT clip, y, r, s, CASE WHEN r < 0.65 THEN 1.08 - 0.08 * least(greatest((r - 0.40) / 0.25, 0), 1) ELSE 1 END AS c,
  CASE WHEN y < 0.42 THEN 1.08 - 0.08 * least(greatest((y - 0.30) / 0.12, 0), 1) WHEN y > 0.60 THEN 1 - 0.08 * least(greatest((y - 0.60) / 0.20, 0), 1) ELSE 1 END AS g,
  CASE WHEN s < 0.15 THEN 1.08 - 0.08 * least(greatest((s - 0.05) / 0.10, 0), 1) WHEN s > 0.40 THEN 1 - 0.08 * least(greatest((s - 0.40) / 0.15, 0), 1) ELSE 1 END AS t FROM g)
SELECT clip, CAST(round_even(y * 1e6, 0) AS BIGINT) AS y_mean, CAST(round_even(r * 1e6, 0) AS BIGINT) AS y_range, CAST(round_even(s * 1e6, 0) AS BIGINT) AS sat_mean,
  CAST(round_even(c * 1e6, 0) AS BIGINT) AS contrast, CAST(round_even(g * 1e6, 0) AS BIGINT) AS gamma, CAST(round_even(t * 1e6, 0) AS BIGINT) AS saturation FROM k"""
)
def auto_grade(spark, sf_dir):
    e = F.col("event_id")
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), e.alias("line_no"), F.concat(F.lit("lavfi.signalstats."), F.element_at(F.array(*(F.lit(k) for k in ("YAVG", "YMIN", "YMAX", "SATAVG"))), (e % 4 + 1).cast("int")), F.lit("="), F.when(e % 4 == 0, e % 256).when(e % 4 == 1, e % 64).when(e % 4 == 2, 200 + e % 56).otherwise(e % 128).cast("string")).alias("line"))
    stats = signal.signal_stats(readers.frame_stats(lines))
    millionth = lambda c: F.rint(c * 1e6).cast("long")
    found = signal.grade_factors(F.col("y_mean"), F.col("y_range"), F.col("sat_mean"))
    return stats.select("clip", *(millionth(F.col(c)).alias(c) for c in ("y_mean", "y_range", "sat_mean")), *(millionth(v).alias(k) for k, v in found.items()))


@query(
    """WITH s AS (SELECT o_custkey AS media, o_orderkey AS sample, (o_orderkey * 37 % 101) / 500.0 AS x FROM orders),
p AS (SELECT a.media, a.sample AS i, b.sample AS j, abs(a.x - b.x) AS d FROM s a JOIN s b ON a.media = b.media AND a.sample < b.sample),
m AS (SELECT media, max(d) AS d FROM p GROUP BY media),
f AS (SELECT p.media, min((i, j)) AS ij FROM p JOIN m ON p.media = m.media AND abs(p.d - m.d) < 1e-9 WHERE m.d > 0 GROUP BY p.media),
a AS (SELECT media, max(x) - min(x) AS d FROM s GROUP BY media)
SELECT a.media, CAST(round_even(a.d * 1000, 0) AS BIGINT) AS max_delta, struct_extract(ij, 1) AS first, struct_extract(ij, 2) AS second, round_even(a.d * 1000, 0) <= 150 AS passed FROM a LEFT JOIN f USING (media)"""
)
def grade_consistency(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("media"), k.alias("sample"), (k * 37 % 101 * 2).alias("luminance"))
    made = signal.grade_consistency(s, limit=150)
    return made.withColumn("max_delta", F.col("max_delta").cast("long"))


@query(
    """WITH s AS (SELECT vec_id, embedding[25:40] AS near, embedding AS e FROM embeddings),
m AS (SELECT vec_id, list_max(list_transform(e, lambda x: abs(CAST(x AS DOUBLE)))) AS peak, list_max(list_transform(near, lambda x: abs(CAST(x AS DOUBLE)))) AS loud FROM s)
SELECT vec_id, CASE WHEN peak < 0.05 THEN true ELSE loud / peak <= 0.8 END AS passed, CASE WHEN peak < 0.05 OR loud / peak <= 0.8 THEN 'info' ELSE 'fail' END AS severity FROM m"""
)
def audio_pop(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", signal.envelope(F.col("embedding"), 64).alias("e"))
    check = signal.pop_check(F.col("e.bins"), F.col("e.raw_peak"), F.lit(2.5), bins=64, around=1.0, near=0.25)
    return e.select("vec_id", check.alias("c")).select("vec_id", "c.passed", "c.severity")


def _findings(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("duration", "visual", "audio_pop", "grade"))), (e % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media"), e.alias("finding"), kind.alias("check"), F.when(e % 4 != 0, (e % 300) / 10.0).alias("cut_time"), (e % 7 != 0).alias("passed"), F.when(e % 7 != 0, "info").when(e % 3 == 0, "warning").otherwise("fail").alias("severity"), F.concat(F.lit("d"), e.cast("string")).alias("details"))


@query(
    """SELECT user_id AS media, count(*) FILTER (WHERE event_id % 7 <> 0) AS n_passed, count(*) FILTER (WHERE event_id % 7 = 0 AND event_id % 3 <> 0) AS n_failed, count(*) FILTER (WHERE event_id % 21 = 0) AS n_warnings,
  count(*) FILTER (WHERE event_id % 7 = 0 AND event_id % 3 <> 0) = 0 AS passed FROM events GROUP BY user_id"""
)
def verify_report(spark, sf_dir):
    return signal.report(_findings(spark, sf_dir))


@query(
    """WITH f AS (SELECT user_id AS media, event_id AS finding, event_id % 4 AS chk, CASE WHEN event_id % 4 <> 0 THEN event_id % 300 END AS cut, event_id % 7 <> 0 AS passed, CASE WHEN event_id % 7 <> 0 THEN 'info' WHEN event_id % 3 = 0 THEN 'warning' ELSE 'fail' END AS severity FROM events),
old AS (SELECT *, row_number() OVER (PARTITION BY media, chk, cut ORDER BY finding) AS k FROM f WHERE severity = 'fail'),
again AS (SELECT *, row_number() OVER (PARTITION BY media, chk, cut ORDER BY finding) AS k FROM f WHERE finding % 2 = 0),
n AS (SELECT a.media, a.finding, b.finding AS hit FROM old a JOIN again b ON a.media = b.media AND a.chk = b.chk AND a.k = b.k AND a.cut IS NOT DISTINCT FROM b.cut)
SELECT f.media, f.finding, coalesce(hit % 14 = 0, f.passed) AS passed, CASE WHEN hit IS NOT NULL THEN CASE WHEN hit % 14 = 0 THEN 'info' ELSE 'fail' END ELSE severity END AS severity,
  CASE WHEN hit IS NOT NULL THEN '[retry 1] r' || CAST(hit AS VARCHAR) ELSE 'd' || CAST(f.finding AS VARCHAR) END || CASE WHEN severity = 'fail' AND (hit IS NULL OR hit % 14 <> 0) THEN ' [unresolved after max passes]' ELSE '' END AS details FROM f LEFT JOIN n USING (media, finding)"""
)
def recheck_findings(spark, sf_dir):
    f = _findings(spark, sf_dir)
    better = F.col("finding") % 14 == 0
    again = f.where("finding % 2 = 0").withColumns({"passed": better, "severity": F.when(better, "info").otherwise("fail"), "details": F.concat(F.lit("r"), F.col("finding").cast("string"))})
    return signal.rechecked(f, again).select("media", "finding", "passed", "severity", "details")


@query(
    """SELECT o_orderkey AS media, CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 50 = 0 THEN NULL WHEN o_custkey % 20 = 0 THEN 'missing-or-invalid-segment-end' WHEN o_custkey % 5 = 0 THEN 'ratio-close-to-1' WHEN o_custkey % 5 = 1 THEN 'ratio-not-close-enough-to-integer' WHEN o_custkey % 5 = 2 THEN 'ratio-does-not-match-observed-mlx-compression' ELSE 'media-duration-matched-observed-mlx-ten-x-compression' END AS reason,
  CAST(CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 50 = 0 OR o_custkey % 20 = 0 OR o_custkey % 5 < 3 THEN 1.0 ELSE 10.0 END AS DOUBLE) AS factor FROM orders"""
)
def timestamp_correction(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    end = F.when(c % 20 == 0, 0).otherwise(60_000)
    length = F.when(c % 50 != 0, F.when(c % 5 == 0, 60_000).when(c % 5 == 1, 150_000).when(c % 5 == 2, 120_000).otherwise(600_000))
    m = table(spark, sf_dir, "orders").select(k.alias("media"), F.when(k % 3 == 0, "faster-whisper").otherwise("mlx").alias("backend"), F.lit(3).alias("n_segments"), end.alias("last_end_ms"), length.alias("duration_ms"))
    return edl.timestamp_correction(m).select("media", "reason", "factor")


# --- files, caches and batches ---


@query(
    """WITH i AS (SELECT doc_id AS media, CASE WHEN doc_id % 2 = 0 THEN 'mlx' ELSE 'cloud' END AS backend, md5(source) AS h FROM documents),
c AS (SELECT doc_id AS media, CASE WHEN quality = 1 THEN 'mlx' ELSE 'cloud' END AS b, CASE WHEN l.toxic = 1 THEN 'stale' WHEN doc_id % 5 <> 0 THEN md5(d.source) END AS g FROM labels l JOIN documents d USING (doc_id))
SELECT media, coalesce(b = backend AND (g IS NULL OR g = h), false) AS fresh FROM i LEFT JOIN c USING (media)"""
)
def cache_misses(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    inputs = d.select(F.col("doc_id").alias("media"), F.when(F.col("doc_id") % 2 == 0, "mlx").otherwise("cloud").alias("backend"), F.md5(F.col("source").cast("binary")).alias("source_hash"))
    cached = n.join(inputs.withColumnRenamed("media", "doc_id"), "doc_id").select(F.col("doc_id").alias("media"), F.when(F.col("quality") == 1, "mlx").otherwise("cloud").alias("backend"), F.when(F.col("toxic") == 1, "stale").when(F.col("doc_id") % 5 != 0, F.col("source_hash")).alias("source_hash"))
    return sinks.cache_state(inputs, cached).select("media", "fresh")


@query(
    """SELECT d.doc_id AS output, CASE WHEN l.doc_id IS NOT NULL THEN 'fail' ELSE 'process' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def output_guard(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return sinks.output_decision(d.select(F.col("doc_id").alias("output")), n.select(F.col("doc_id").alias("output")))


@query(
    """SELECT page_id, lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS suffix, CASE WHEN lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) IN ('.mp4', '.mov') THEN 'video' ELSE 'other' END AS kind FROM pages"""
)
def media_classify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.suffix(F.col("url")).alias("suffix"), X.media_kind(F.col("url")).alias("kind"))


@query(
    """WITH v AS (SELECT p_partkey AS k, '/v/' || CAST(p_partkey AS VARCHAR) || '.mp4' AS video FROM part), s AS (SELECT p_partkey AS k, '/s/' || CAST(p_partkey AS VARCHAR) || '.srt' AS srt FROM part WHERE p_size % 3 <> 0)
SELECT video, srt, CASE WHEN srt IS NULL THEN 'no captions for ' || CAST(v.k AS VARCHAR) END AS error FROM v LEFT JOIN s USING (k)"""
)
def subtitle_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    v = p.select(F.concat(F.lit("/v/"), k, F.lit(".mp4")).alias("video")).withColumn("stem", X.stem(F.col("video")))
    s = p.where("p_size % 3 <> 0").select(F.concat(F.lit("/s/"), k, F.lit(".srt")).alias("srt")).withColumn("stem", X.stem(F.col("srt")))
    return v.join(s, "stem", "left").select("video", "srt", F.when(F.col("srt").isNull(), F.concat(F.lit("no captions for "), F.col("stem"))).alias("error"))


@query(
    """WITH l AS (SELECT o_orderkey AS n, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '# c' WHEN 2 THEN ' clips/' || CAST(o_orderkey AS VARCHAR) || '.mov ' WHEN 3 THEN '/abs/' || CAST(o_orderkey AS VARCHAR) || '.mov' ELSE '~/h.mov' END AS t FROM orders)
SELECT n AS line_no, CASE n % 5 WHEN 2 THEN '/data/lists/' || trim(t) WHEN 3 THEN t ELSE '/root/h.mov' END AS path FROM l WHERE n % 5 >= 2"""
)
def manifest_inputs(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.when(k % 5 == 0, "").when(k % 5 == 1, "# c").when(k % 5 == 2, F.concat(F.lit(" clips/"), k.cast("string"), F.lit(".mov "))).when(k % 5 == 3, F.concat(F.lit("/abs/"), k.cast("string"), F.lit(".mov"))).otherwise("~/h.mov")
    lines = table(spark, sf_dir, "orders").select(F.lit("/data/lists/all.txt").alias("manifest"), k.alias("line_no"), t.alias("line"))
    return readers.manifest_inputs(lines).select("line_no", "path")


@query(f"WITH {PHRASES_SQL} SELECT media, string_agg('[' || {_sec_sql('start_ms')} || '-' || {_sec_sql('end_ms')} || '] S' || speaker || ' ' || text, chr(10) ORDER BY phrase_id) AS document FROM phrases GROUP BY media")
def packed_markdown(spark, sf_dir):
    return sinks.packed_markdown(phrase_cues(spark, sf_dir))


@query(f"WITH {PHRASES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY phrase_id) AS k FROM phrases) SELECT media, string_agg(CAST(k AS VARCHAR) || chr(10) || {_code_sql('start_ms', ',')} || ' --> ' || {_code_sql('end_ms', ',')} || chr(10) || '[' || speaker || '] ' || text || chr(10), chr(10) ORDER BY k) AS document FROM c GROUP BY media")
def srt_documents(spark, sf_dir):
    return sinks.srt_documents(phrase_cues(spark, sf_dir), order=("phrase_id",), speaker="speaker")


@query(f"WITH {PHRASES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY phrase_id) AS k FROM phrases) SELECT media, CAST(k AS INT) AS cue, start_ms, end_ms, '[' || speaker || '] ' || text AS text, CAST(NULL AS VARCHAR) AS error FROM c")
def srt_parse(spark, sf_dir):
    made = sinks.srt_documents(phrase_cues(spark, sf_dir), order=("phrase_id",), speaker="speaker").withColumnRenamed("document", "value")
    return readers.parse_srt(made).drop("block")


@query(f"WITH {PHRASES_SQL} SELECT media, string_agg('[' || {_code_sql('start_ms', '.')} || ' --> ' || {_code_sql('end_ms', '.')} || '] [' || speaker || '] ' || text, chr(10) ORDER BY phrase_id) || chr(10) AS document FROM phrases GROUP BY media")
def txt_documents(spark, sf_dir):
    return sinks.txt_documents(phrase_cues(spark, sf_dir), order="phrase_id")


@query(f"WITH {WORDS_SQL} SELECT media, CAST(pos - 1 AS INT) AS pos, word, start_ms, end_ms, speaker FROM words")
def transcript_words(spark, sf_dir):
    """Words written as a transcript's JSON and read again."""
    one = F.struct(F.col("pos").alias("p"), F.struct("word", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker").alias("w"))
    made = words(spark, sf_dir).groupBy("media").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["w"]).alias("words"))).alias("json"))
    read = made.select("media", F.from_json("json", readers.TRANSCRIPT).alias("t")).select("media", "t.*")
    return readers.transcript_words(read).drop("type")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share: ``spark.checkpoint.dir``, or a folder of this machine where
    all is on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: this query needs a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/cuegrid-{name}-{uuid.uuid4().hex}"


@query()
def stream_phrases(spark, sf_dir):
    """Events as a stream, packed into sessions; written by one run over all there is, and read again. The sessions
    that the run leaves open follow from the table."""
    out = shared_folder(spark, "stream")
    given = table(spark, sf_dir, "events")
    source = spark.readStream.schema(given.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    events = lambda df: df.select(F.col("user_id").alias("media"), F.col("ts").cast("timestamp").alias("ts"))
    stream.start(stream.phrase_sessions(events(source)), f"{out}/rows", f"{out}/state").awaitTermination()
    finished = spark.read.schema("media long, start timestamp, end timestamp, n_words long").parquet(f"{out}/rows")
    return finished.unionByName(stream.still_open(events(given), finished))


# --- plans and checks beside the main path ---


@query(
    """SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'ffmpeg|-y|-loop|1|-t|' || CAST(p_size AS VARCHAR) || '|-i|/i/' || CAST(p_partkey AS VARCHAR) || '.png|-f|lavfi|-t|' || CAST(p_size AS VARCHAR) || '|-i|anullsrc=channel_layout=stereo:sample_rate=48000|-vf|scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2:black,fps=30|-c:v|libx264|-preset|veryfast|-crf|20|-pix_fmt|yuv420p|-c:a|aac|-ar|48000|-ac|2|-shortest|-movflags|+faststart|/o/' || CAST(p_partkey AS VARCHAR) || '.mp4' END AS image_plan,
  CASE p_partkey % 3 WHEN 1 THEN p_brand || chr(10) || chr(10) || p_type WHEN 2 THEN p_brand END AS card FROM part"""
)
def rough_cut_plan(spark, sf_dir):
    k = F.col("p_partkey")
    image = ffmpeg.image_segment(F.concat(F.lit("/i/"), k.cast("string"), F.lit(".png")), F.col("p_size").cast("string"), F.concat(F.lit("/o/"), k.cast("string"), F.lit(".mp4")))
    card = ffmpeg.card_text(F.col("p_brand"), F.lit("  "), F.when(k % 3 == 1, F.col("p_type")))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 3 == 0, F.array_join(image, "|")).alias("image_plan"), F.when(k % 3 != 0, card).alias("card"))


@query(
    """SELECT p_partkey AS k, 'ffmpeg|-y|-hide_banner|-nostats|-i|/a/' || CAST(p_partkey AS VARCHAR) || '.mov' || CASE WHEN p_size % 2 = 0 THEN '|-c:v|copy' ELSE '' END || '|-af|loudnorm=I=-14:TP=-1:LRA=11'
  || CASE WHEN p_size % 3 <> 0 THEN ':measured_I=-' || CAST(p_size AS VARCHAR) || ':measured_TP=-2:measured_LRA=7:measured_thresh=-30:offset=0.1:linear=true' ELSE '' END || '|-c:a|aac|-b:a|192k|-ar|48000' || CASE WHEN p_partkey % 2 = 0 THEN '|-movflags|+faststart|/b/o.mp4' ELSE '|/b/o.MKV' END AS plan FROM part"""
)
def loudness_plan(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    report = F.concat(F.lit('log {"input_i": "-'), n.cast("string"), F.lit('", "input_tp": "-2", "input_lra": "7", "input_thresh": "-30"'), F.when(n % 3 != 0, ', "target_offset": "0.1"').otherwise(""), F.lit("} end"))
    p = table(spark, sf_dir, "part").select(k.alias("k"), n.alias("n"), readers.loudness(report).alias("m"))
    plan = ffmpeg.loudnorm(F.concat(F.lit("/a/"), F.col("k").cast("string"), F.lit(".mov")), F.when(F.col("k") % 2 == 0, "/b/o.mp4").otherwise("/b/o.MKV"), F.col("m"), F.col("n") % 2 == 0)
    return p.select("k", F.array_join(plan, "|").alias("plan"))


@query(
    """SELECT p_partkey AS k, printf('fps=%.8f,scale=320:-1,tile=4x3', 12.0 / p_size) AS sheet, CAST(least(12, greatest(1, 1920 // 14)) AS INT) AS frames, CAST(round_even(least(1.0, 0.1 * p_size) * 1000, 0) AS BIGINT) AS first_ms, CAST(round_even(greatest(p_size - 1, 0.9 * p_size) * 1000, 0) AS BIGINT) AS last_ms,
  CAST(round_even(greatest(0.5, least(10.0 / p_size, 10.0)) * 1000, 0) AS BIGINT) AS fps FROM part"""
)
def sampling_plan(spark, sf_dir):
    d = F.col("p_size").cast("double")
    times = signal.grade_sample_times(d)
    sheet = F.element_at(ffmpeg.contact_sheet(F.lit("/a"), F.lit("/b"), d, 4, 3, 320), 6)
    milli = lambda c: F.rint(c * 1000).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), sheet.alias("sheet"), ffmpeg.capped_frames(F.lit(12)).alias("frames"), milli(times[0]).alias("first_ms"), milli(times[4]).alias("last_ms"), milli(signal.sampling_fps(d)).alias("fps"))


@query(
    f"""WITH {PHRASES_SQL}, w AS (SELECT media, phrase_id // 4 AS window_id, min(start_ms) AS s, max(end_ms) AS e, string_agg(text, ' ' ORDER BY phrase_id) AS t FROM phrases GROUP BY 1, 2)
SELECT media, CAST(window_id AS BIGINT) AS window_id, CAST(rule AS INT) AS rule FROM (SELECT media, window_id, unnest(list_filter([CASE WHEN window_id % 7 = 3 THEN 1 END, CASE WHEN window_id % 7 = 4 THEN 3 END, CASE WHEN window_id % 5 = 2 AND window_id % 7 <> 3 THEN 4 END, CASE WHEN window_id % 3 = 1 AND window_id % 7 <> 3 THEN 5 END], lambda x: x IS NOT NULL)) AS rule FROM w)"""
)
def payload_violations(spark, sf_dir):
    p = phrase_cues(spark, sf_dir).withColumn("window_id", F.floor(F.col("phrase_id") / 4).cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("phrase_id", "text"))), lambda x: x["text"]), " ")
    want = p.groupBy("media", "window_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("source_text"))
    k = F.col("window_id")
    got = want.where(k % 7 != 3).select("media", "window_id", "start_ms", (F.col("end_ms") + F.when(k % 7 == 4, 1).otherwise(0)).alias("end_ms"), F.concat("source_text", F.when(k % 5 == 2, "!").otherwise("")).alias("source_text"), F.when(k % 3 != 1, "x").otherwise(" ").alias("translated_text"))
    return edl.payload_violations(want, got).drop("message")


@query(
    """SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'warning' WHEN abs(p_partkey % 4 * 0.25) <= 0.5 THEN 'info' ELSE 'fail' END AS duration, CASE WHEN p_size % 6 = 0 THEN 'warning' WHEN p_partkey % 3 * 0.2 <= 0.25 THEN 'info' ELSE 'fail' END AS visual FROM part"""
)
def threshold_checks(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    expected = F.when(n % 5 != 0, n.cast("double"))
    delta = F.when(n % 6 != 0, k % 3 * 0.2)
    return table(spark, sf_dir, "part").select(k.alias("k"), signal.duration_check(n + k % 4 * 0.25, expected)["severity"].alias("duration"), signal.visual_check(delta)["severity"].alias("visual"))


@query(
    """WITH f AS (SELECT user_id AS media, event_id AS finding, event_id % 300 AS cut FROM events WHERE event_id % 4 <> 0), p AS (SELECT user_id AS media, event_id AS picture_no, event_id % 300 AS cut FROM events WHERE event_id % 3 = 0)
SELECT f.media, f.finding, '/t/' || CAST(min(picture_no) AS VARCHAR) || '.png' AS timeline_png FROM f LEFT JOIN p ON p.media = f.media AND p.cut = f.cut GROUP BY 1, 2"""
)
def finding_pictures(spark, sf_dir):
    f = _findings(spark, sf_dir).where("cut_time IS NOT NULL").select("media", "finding", "cut_time")
    e = F.col("event_id")
    p = table(spark, sf_dir, "events").where(e % 3 == 0).select(F.col("user_id").alias("media"), e.alias("picture_no"), (e % 300 / 10.0).alias("cut_time"), F.concat(F.lit("/t/"), e.cast("string"), F.lit(".png")).alias("path"))
    return signal.nearest_picture(f, p).drop("cut_time")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 9 <> 0) AS n_ok, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS n_failed, 1 AS exit_code FROM orders")
def batch_result(spark, sf_dir):
    """All orders as one batch; ``batch_results`` has one for each priority."""
    return sinks.batch_result(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, "failed").alias("error")))


@query("SELECT o_orderpriority AS batch, count(*) FILTER (WHERE o_orderkey % 9 <> 0) AS n_ok, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS n_failed FROM orders GROUP BY 1")
def batch_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), F.when(F.col("o_orderkey") % 9 == 0, "failed").alias("error"))
    return sinks.batch_result(o, by=("batch",)).drop("exit_code")


# --- parsing, text and times ---


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), F.col("p_name").alias("name"))


@query(f"WITH {PHRASES_SQL} SELECT media, '# Packed transcript' || chr(10) || chr(10) || 'Phrase-level, grouped on silences ≥ 0.5s or speaker change.' || chr(10) || 'Use `[start-end]` ranges to address cuts in the EDL.' || chr(10) || chr(10) || string_agg('[' || {_sec_sql('start_ms')} || '-' || {_sec_sql('end_ms')} || '] S' || speaker || ' ' || text, chr(10) ORDER BY phrase_id) || chr(10) AS document FROM phrases GROUP BY media")
def packed_files(spark, sf_dir):
    return sinks.packed_file(sinks.packed_markdown(phrase_cues(spark, sf_dir)))


@query(f"WITH {PHRASES_SQL} SELECT media, string_agg(text, ' ' ORDER BY phrase_id) AS text FROM phrases GROUP BY media")
def full_texts(spark, sf_dir):
    return readers.full_text(phrase_cues(spark, sf_dir), order="phrase_id")


@query(f"WITH {WORDS_SQL} SELECT media, CAST(pos - 1 AS INT) AS pos, word, CAST(CASE WHEN pos % 11 = 0 THEN 0 ELSE start_ms END AS BIGINT) AS start_ms, CAST(CASE WHEN pos % 7 = 0 THEN CASE WHEN pos % 11 = 0 THEN 0 ELSE start_ms END ELSE end_ms END AS BIGINT) AS end_ms FROM words WHERE CASE WHEN pos % 7 = 0 THEN CASE WHEN pos % 11 = 0 THEN 0 ELSE start_ms END ELSE end_ms END > 2000 AND CASE WHEN pos % 11 = 0 THEN 0 ELSE start_ms END < 9000")
def words_of_a_span(spark, sf_dir):
    """Some words have no start or no end."""
    k = F.col("pos")
    one = F.struct(k.alias("p"), F.struct("word", F.when(k % 11 != 0, F.col("start_ms") / 1000).alias("start"), F.when(k % 7 != 0, F.col("end_ms") / 1000).alias("end")).alias("w"))
    made = words(spark, sf_dir).groupBy("media").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["w"]).alias("words"))).alias("json"))
    return readers.words_between(made.select("media", F.from_json("json", readers.TRANSCRIPT).alias("t")).select("media", "t.*"), 2000, 9000)


@query(f"WITH {WORDS_SQL} SELECT media, CAST(pos AS BIGINT) AS pos, word FROM words WHERE pos % 5 IN (0, 1, 4)")
def spoken_words(spark, sf_dir):
    """Typed entries: every fifth each is a word, an audio event, a gap; two have no type."""
    k = F.col("pos") % 5
    return readers.spoken(words(spark, sf_dir).withColumn("type", F.when(k == 2, "spacing").when(k == 3, "audio_event").when(k == 1, "word"))).select("media", "pos", "word")


@query(
    """SELECT p_partkey AS k, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS duration, CASE WHEN p_size % 5 <> 0 THEN 640 END AS width, CASE WHEN p_size % 3 <> 0 THEN CAST(round_even(p_size * 1000 / 1001.0, 0) AS INT) END AS fps,
  p_partkey % 2 = 0 AS has_audio, true AS has_video FROM part"""
)
def probe_fields(spark, sf_dir):
    n = F.col("n").cast("string")
    sound = F.when(F.col("k") % 2 == 0, ',{"codec_type": "audio"}').otherwise("")
    length = F.when(F.col("n") % 4 != 0, F.concat(F.lit('"duration": "'), n, F.lit('.0"'))).otherwise('"size": "1"')
    rate = F.when(F.col("n") % 3 != 0, F.concat(n, F.lit("000/1001"))).otherwise("0/0")
    text = F.concat(F.lit('{"format": {'), length, F.lit('}, "streams": [{"codec_type": "video", "width": '), F.when(F.col("n") % 5 != 0, "640").otherwise("0"), F.lit(', "height": 360, "avg_frame_rate": "'), rate, F.lit('"}'), sound, F.lit("]}"))
    return _part(spark, sf_dir).select("k", readers.probe(text).alias("p")).select("k", "p.duration", "p.width", "p.fps", "p.has_audio", "p.has_video")


@query(
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN least(CAST(p_size * 2 AS DOUBLE), 60.0) WHEN 1 THEN least(CAST(p_size AS DOUBLE), 60.0) ELSE 2.0 ^ (p_partkey % 3 + 1) END AS wait,
  (p_size % 2 = 0 OR p_size % 3 = 0) AND p_partkey % 3 < 2 AS again FROM part"""
)
def retry_plan(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    asked = F.when(k % 4 == 0, (n * 2).cast("string")).when(k % 4 == 1, F.concat(F.lit("Wed, 21 Oct 2015 07:28:"), F.lpad(n.cast("string"), 2, "0"), F.lit(" GMT")))
    now = F.try_to_timestamp(F.lit("2015-10-21 07:28:00"))
    status = F.when(n % 2 == 0, 429).when(n % 3 == 0, 503).otherwise(404)
    return _part(spark, sf_dir).select("k", readers.retry_wait((k % 3).cast("int"), asked, now).alias("wait"), readers.retries(status, (k % 3).cast("int")).alias("again"))


@query(
    """SELECT p_partkey AS k, '/' || CASE p_partkey % 4 WHEN 0 THEN 'a/' || CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'a/b/' || CAST(p_size AS VARCHAR) ELSE 'c' END AS path FROM part"""
)
def normal_paths(spark, sf_dir):
    k, n = F.col("k"), F.col("n").cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("/a/./b/../"), n)).when(k % 4 == 1, F.concat(F.lit("/a/b/../../"), n)).when(k % 4 == 2, F.concat(F.lit("//a//b/"), n, F.lit("/"))).otherwise("/../a/../../c")
    return _part(spark, sf_dir).select("k", X.normal_path(raw).alias("path"))


@query(
    """SELECT p_partkey AS k, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS cased, position(' ' IN p_name) > 0 AS spaced, CAST(greatest(length(replace(p_name, ' ', '')), 1) AS INT) AS weight, CAST(len(string_split(p_name, ' ')) AS INT) AS n_words,
  CASE WHEN p_partkey % 10 = 0 THEN '00:00:60,000' ELSE '00:00:' || lpad(CAST(p_size + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN ',000' ELSE ',250' END END AS uncarried,
  CASE WHEN p_partkey % 10 = 0 THEN '00:01:00,000' ELSE '00:00:' || lpad(CAST(p_size + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN ',000' ELSE ',250' END END AS carried,
  '/a' || chr(92) || ':b' || chr(92) || ',c' || chr(92) || '[' || CAST(p_partkey AS VARCHAR) || chr(92) || ']' AS escaped FROM part"""
)
def text_functions(spark, sf_dir):
    name = F.col("name")
    # At 59.9996 s the two formats differ: one carries into the minute.
    seconds = F.when(F.col("k") % 10 == 0, 59.9996).otherwise(F.col("n") + F.when(F.col("k") % 2 == 0, 0.9996).otherwise(0.25))
    path = F.concat(F.lit("/a:b,c["), F.col("k").cast("string"), F.lit("]"))
    return _part(spark, sf_dir).select("k", X.sentence_case(name).alias("cased"), X.uses_spaces(name).alias("spaced"), X.block_weight(name).cast("int").alias("weight"), X.count_spoken(X.tokens(name)).alias("n_words"), X.srt_time_uncarried(seconds).alias("uncarried"), X.srt_time_seconds(seconds).alias("carried"), X.ass_escape(path).alias("escaped"))


@query(
    """SELECT l_orderkey AS media, CAST(l_linenumber AS INT) AS segment, CAST(CASE WHEN o_custkey % 3 = 0 THEN l_partkey * 10 ELSE l_partkey END AS BIGINT) AS start_ms, CAST(CASE WHEN o_custkey % 3 = 0 THEN (l_partkey + 500) * 10 ELSE l_partkey + 500 END AS BIGINT) AS end_ms,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN (l_partkey + 100) * 10 ELSE l_partkey + 100 END AS BIGINT) AS word_end FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def corrected_segments(spark, sf_dir):
    """Times of the media whose correction applies, times ten."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media"), F.lit("mlx").alias("backend"), F.lit(1).alias("n_segments"), F.lit(60_000).alias("last_end_ms"), F.when(F.col("o_custkey") % 3 == 0, 600_000).otherwise(60_000).alias("duration_ms"))
    p = F.col("l_partkey")
    word = F.struct(F.lit("w").alias("word"), p.alias("start_ms"), (p + 100).alias("end_ms"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media"), F.col("l_linenumber").cast("int").alias("segment"), p.alias("start_ms"), (p + 500).alias("end_ms"), F.array(word).alias("words"))
    return edl.corrected_times(s, edl.timestamp_correction(o)).select("media", "segment", "start_ms", "end_ms", F.col("words")[0]["end_ms"].alias("word_end"))


@query(
    """WITH e AS (SELECT user_id AS media, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w >= 1800000000, true) THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY media ORDER BY t)),
h AS (SELECT *, sum(n) OVER (PARTITION BY media ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT media, min(t) // 1000 AS start_ms, max(t) // 1000 AS end_ms, count(*) AS n_words FROM h GROUP BY media, s"""
)
def stream_sessions(spark, sf_dir):
    """``stream_phrases`` with times in milliseconds."""
    return stream_phrases(spark, sf_dir).select("media", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n_words")


# --- pictures and reports ---


@query("SELECT vec_id, CAST(round_even(list_sum(list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS DOUBLE))) / len(embedding) / 255 * 1e9, 0) AS BIGINT) AS luminance FROM embeddings")
def frame_luminance(spark, sf_dir):
    pixels = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.rint(signal.luminance(pixels) * 1e9).cast("long").alias("luminance"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS BIGINT)) AS p FROM embeddings) SELECT vec_id, CAST(round_even((list_sum(list_transform(range(1, 7), lambda i: CAST(abs(p[i] - p[i + 8]) AS DOUBLE))) + list_sum(list_transform(range(1, 7), lambda i: CAST(abs(p[i + 9] - p[i + 14]) AS DOUBLE)))) / 12 / 255 * 1e9, 0) AS BIGINT) AS delta FROM v")
def cropped_deltas(spark, sf_dir):
    """Frames of 3 x 2 and 2 x 3 pixels, cut from a vector."""
    p = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100))
    frame = lambda w, h, at: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"), F.slice(p, at, w * h * 3).alias("pixels"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.rint(signal.cropped_frame_delta(frame(3, 2, 1), frame(2, 3, 9)) * 1e9).cast("long").alias("delta"))


@query(
    """WITH s AS (SELECT o_custkey AS media, o_orderkey AS sample, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey * 37 % 101) / 256.0 END AS x FROM orders), a AS (SELECT media, count(x) AS n, max(x) - min(x) AS d FROM s GROUP BY media)
SELECT c_custkey AS media, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 7 >= 4 AND coalesce(n, 0) >= 2 THEN d <= 0.15 ELSE false END AS passed, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 7 >= 4 AND coalesce(n, 0) >= 2 THEN CASE WHEN d <= 0.15 THEN 'info' ELSE 'fail' END ELSE 'warning' END AS severity
FROM customer LEFT JOIN a ON media = c_custkey"""
)
def grade_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    samples = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("media"), k.alias("sample"), F.when(k % 5 != 0, k * 37 % 101 / 256.0).alias("luminance"))
    lengths = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("media"), F.when(F.col("c_custkey") % 6 != 0, (F.col("c_custkey") % 7).cast("double")).alias("duration"))
    return signal.grade_check(samples, lengths).select("media", "passed", "severity")


@query(
    """WITH f AS (SELECT user_id AS media, event_id AS finding, ['duration', 'visual', 'audio_pop', 'grade'][event_id % 4 + 1] AS c, event_id % 7 <> 0 AS passed, CASE WHEN event_id % 7 <> 0 THEN 'info' WHEN event_id % 3 = 0 THEN 'warning' ELSE 'fail' END AS severity FROM events),
r AS (SELECT media, count(*) FILTER (WHERE passed) AS p, count(*) FILTER (WHERE severity = 'fail') AS f, count(*) FILTER (WHERE severity = 'warning') AS w,
  string_agg('  ' || CASE WHEN passed THEN '✓' ELSE '✗' END || ' [' || c || ']' || CASE WHEN severity <> 'info' THEN ' (' || severity || ')' ELSE '' END || CASE WHEN severity = 'warning' THEN ' [non-blocking]' ELSE '' END || ' d' || CAST(finding AS VARCHAR), chr(10) ORDER BY finding) AS lines FROM f GROUP BY media)
SELECT media, concat_ws(chr(10), repeat('=', 60), '  Verify Report: ' || CASE WHEN f = 0 THEN 'PASS' ELSE 'FAIL' END, '  Video: ' || CAST(media AS VARCHAR), repeat('=', 60), lines, repeat('-', 60), '  Total: ' || concat_ws(', ', CAST(p AS VARCHAR) || ' passed', CASE WHEN f > 0 THEN CAST(f AS VARCHAR) || ' failed' END, CASE WHEN w > 0 THEN CAST(w AS VARCHAR) || ' warning(s)' END), repeat('=', 60)) AS text FROM r"""
)
def report_texts(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return sinks.report_documents(f, signal.report(f)).select("media", "text")


@query(
    """SELECT p_partkey AS k, CAST(50 + floor(1820.0 * p_size / 60) AS INT) AS x, CASE WHEN p_size % 5 = 0 THEN 'columns and rows must be positive' WHEN p_partkey % 7 = 0 THEN 'width must be positive' END AS sheet,
  CASE WHEN p_partkey % 10 = 0 THEN 'start must not be negative' WHEN p_size <= p_partkey % 10 THEN 'end must be greater than start' WHEN p_partkey % 10 >= 5 THEN 'start is beyond the medium''s end' END AS span,
  CAST(50 + p_size + 20 + 100 + 2 + 64 AS INT) AS canvas_height, printf('%.2fs', p_size * 2.0) AS tick FROM part"""
)
def timeline_parts(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    start = F.when(k % 10 == 0, -1).otherwise(k % 10).cast("double")
    return _part(spark, sf_dir).select(
        "k", ffmpeg.time_to_x(n.cast("double"), F.lit(0.0), F.lit(60.0)).alias("x"), ffmpeg.sheet_violation(F.when(n % 5 == 0, 0).otherwise(4), F.lit(3), (k % 7).cast("int")).alias("sheet"), ffmpeg.span_violation(start, n.cast("double"), F.lit(5.0)).alias("span"),
        ffmpeg.timeline_layout(n.cast("int"), F.lit(100))["canvas_height"].cast("int").alias("canvas_height"), ffmpeg.ruler(F.lit(0.0), n * 12.0)[1]["label"].alias("tick"),
    )


@query(
    f"""WITH {WORDS_SQL}, s AS (SELECT media, max(end_ms) AS z FROM words GROUP BY media),
w AS (SELECT media, pos, (CAST(50 + floor(start_ms * 1820.0 / z) AS BIGINT) + CAST(50 + floor(end_ms * 1820.0 / z) AS BIGINT)) // 2 AS x, row_number() OVER (PARTITION BY media ORDER BY pos) AS k FROM words JOIN s USING (media) WHERE end_ms - start_ms >= 50),
f AS (SELECT media, k, x AS last, true AS kept FROM w WHERE k = 1 UNION ALL SELECT w.media, w.k, CASE WHEN w.x - last < 28 THEN last ELSE w.x END, w.x - last >= 28 FROM f JOIN w ON w.media = f.media AND w.k = f.k + 1)
SELECT media, count(*) AS n, CAST(sum(last) AS BIGINT) AS places FROM f WHERE kept GROUP BY media""".replace("WITH ", "WITH RECURSIVE ", 1)
)
def word_labels(spark, sf_dir):
    """How many word labels fit over a conversation's waveform, and the sum of their places."""
    w = words(spark, sf_dir)
    spans = w.groupBy("media").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return ffmpeg.word_labels(w.select("media", "pos", "word", "start_ms", "end_ms"), spans).select("media", F.size("labels").cast("long").alias("n"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x["x"]).alias("places"))


# --- argument lists ---


@query(
    """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, p_size AS n FROM part)
SELECT k, 'ffmpeg|' || CASE WHEN n % 2 = 0 THEN '-y' ELSE '-n' END || '|-i|/v/' || s || '.mov|-vn|' || CASE WHEN n % 2 = 0 THEN '-c:a|aac|-b:a|192k' ELSE '-c:a|copy' END || '|/a.m4a' AS audio, 'ffmpeg|-y|-i|/v/' || s || '.mov|-vn|-ac|1|-ar|16000|-c:a|pcm_s16le|/a.wav' AS pcm,
  'ffmpeg|-y|-i|/v/' || s || '.mov|' || CASE WHEN n % 3 = 0 THEN '-c|copy' ELSE '-vf|eq=contrast=1.03:saturation=0.98|-c:v|libx264|-preset|fast|-crf|18|-pix_fmt|yuv420p|-c:a|copy' END || '|-movflags|+faststart|/g.mp4' AS graded,
  'ffmpeg|-i|/v/' || s || '.mov|-vf|' || CASE WHEN n % 2 = 0 THEN 'hue=s=0,' ELSE '' END || 'subtitles=''/c/' || s || '.srt'':force_style=''Bold=1''|-c:v|libx264|-preset|veryfast|-crf|20|-pix_fmt|yuv420p|-c:a|copy|-movflags|+faststart|/b.mp4' AS burnt,
  'ffmpeg|-y|-ss|' || CAST(n AS VARCHAR) || '.500|-i|/v/' || s || '.mov|-frames:v|1|-q:v|4|-vf|scale=320:-2|/f.jpg' AS frame, CASE WHEN n % 4 <> 0 THEN 'ffmpeg|-y|-i|/v/' || s || '.mov|-c|copy|-movflags|+faststart|/x.mp4' END AS copied FROM p"""
)
def media_plans(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    source = F.concat(F.lit("/v/"), k.cast("string"), F.lit(".mov"))
    line = lambda c: F.array_join(c, "|")
    audio = F.when(n % 2 == 0, ffmpeg.extract_audio(source, F.lit("/a.m4a"), True, True)).otherwise(ffmpeg.extract_audio(source, F.lit("/a.m4a")))
    chain = ffmpeg.subtitle_filter(F.concat(F.lit("/c/"), k.cast("string"), F.lit(".srt")), F.lit("Bold=1"), F.when(n % 2 == 0, "hue=s=0"))
    grade = ffmpeg.grade(source, F.lit("/g.mp4"), ffmpeg.resolved_grade(F.when(n % 3 == 0, "none"), F.lit("subtle")))
    output = F.when(n % 4 == 0, source).otherwise("/x.mp4")
    return _part(spark, sf_dir).select("k", line(audio).alias("audio"), line(ffmpeg.extract_pcm(source, F.lit("/a.wav"))).alias("pcm"), line(grade).alias("graded"), line(ffmpeg.burn_in(source, F.lit("/b.mp4"), chain)).alias("burnt"), line(ffmpeg.frame_picture(source, n + 0.5, F.lit("/f.jpg"))).alias("frame"), line(ffmpeg.copied(source, output)).alias("copied"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS n, CAST(p_partkey AS VARCHAR) AS s FROM part),
c AS (SELECT *, '-c:v|libx264|-preset|veryfast|-crf|20|-pix_fmt|yuv420p|-c:a|aac|-ar|48000|-ac|2' AS enc, 'scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2:black,fps=30' AS pic FROM p)
SELECT k, CASE k % 4 WHEN 0 THEN 'ffmpeg|-y|-loop|1|-t|5|-i|/t/' || s || '.png|-f|lavfi|-t|5|-i|anullsrc=channel_layout=stereo:sample_rate=48000|-vf|fps=30,format=yuv420p|' || enc || '|-shortest|/o.mp4'
  WHEN 1 THEN 'ffmpeg|-y|-loop|1|-t|5|-i|/i|-f|lavfi|-t|5|-i|anullsrc=channel_layout=stereo:sample_rate=48000|-vf|' || pic || '|' || enc || '|-shortest|-movflags|+faststart|/o.mp4'
  WHEN 2 THEN 'ffmpeg|-y|-ss|0:10|-to|0:' || CAST(10 + n AS VARCHAR) || '|-i|/i' || CASE WHEN n % 2 = 0 THEN '' ELSE '|-f|lavfi|-i|anullsrc=channel_layout=stereo:sample_rate=48000' END || '|-vf|' || pic || CASE WHEN n % 2 = 0 THEN '|-af|afade=t=in:st=0:d=0.03,afade=t=out:st=' || CAST(n - 1 AS VARCHAR) || '.97:d=0.03' ELSE '' END || '|' || enc || '|-movflags|+faststart' || CASE WHEN n % 2 = 0 THEN '' ELSE '|-shortest' END || '|/o.mp4' END AS plan FROM c"""
)
def rough_cut_segments(spark, sf_dir):
    """Cards, stills, clips, and a type that is not known."""
    k, n = F.col("k"), F.col("n")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("card", "image", "clip", "film"))), (k % 4 + 1).cast("int"))
    plan = ffmpeg.rough_cut_segment(kind, F.lit("/i"), F.concat(F.lit("/t/"), k.cast("string"), F.lit(".png")), F.lit("0:10"), F.concat(F.lit("0:"), (n + 10).cast("string")), F.lit("5"), F.lit("/o.mp4"), n % 2 == 0)
    return _part(spark, sf_dir).select("k", F.array_join(plan, "|").alias("plan"))


@query(
    """WITH o AS (SELECT p_partkey % 100 AS edl, p_partkey // 100 AS idx, CASE WHEN p_partkey % 2 = 0 THEN '-loop|1|-i|/o/' || CAST(p_partkey AS VARCHAR) || '.png' ELSE '-i|/o/' || CAST(p_partkey AS VARCHAR) || '.mov' END AS a FROM part WHERE p_partkey % 100 < 60),
i AS (SELECT edl, string_agg(a, '|' ORDER BY idx) AS a FROM o GROUP BY edl), e AS (SELECT DISTINCT p_partkey % 100 AS edl FROM part)
SELECT edl, CASE WHEN a IS NOT NULL THEN 'ffmpeg|-y|-i|/b.mp4|' || a || '|-filter_complex|G|-map|[outv]|-map|0:a?|' || CASE WHEN edl % 3 = 0 THEN '-shortest' ELSE '-t|' || CAST(edl AS VARCHAR) || '.250' END || '|-c:v|libx264|-preset|veryfast|-crf|20|-pix_fmt|yuv420p|-c:a|copy|-movflags|+faststart|/f.mp4'
  WHEN edl % 2 = 0 THEN 'ffmpeg|-y|-i|/b.mp4|-vf|S|-c:v|libx264|-preset|veryfast|-crf|20|-pix_fmt|yuv420p|-c:a|copy|-movflags|+faststart|/f.mp4' ELSE 'ffmpeg|-y|-i|/b.mp4|-c|copy|-movflags|+faststart|/f.mp4' END AS plan FROM e LEFT JOIN i USING (edl)"""
)
def final_passes(spark, sf_dir):
    """Edits with overlays, with captions alone, and with neither."""
    k = F.col("k")
    parts = _part(spark, sf_dir).select((k % 100).alias("edl"), F.floor(k / 100).cast("long").alias("idx"), F.concat(F.lit("/o/"), k.cast("string"), F.when(k % 2 == 0, ".png").otherwise(".mov")).alias("path"))
    both = parts.select("edl").distinct().join(ffmpeg.overlay_inputs(parts.where("edl < 60")), "edl", "left")
    plan = ffmpeg.final_pass(F.lit("/b.mp4"), F.col("inputs"), F.lit("G"), F.when(F.col("edl") % 2 == 0, "S"), F.when(F.col("edl") % 3 != 0, F.col("edl") + 0.25), F.lit("/f.mp4"))
    return both.select("edl", F.array_join(plan, "|").alias("plan"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), v AS (SELECT k, unnest(list_filter([CASE WHEN k % 7 = 0 THEN 3 END, CASE WHEN k % 11 = 0 THEN 20 END, CASE WHEN n % 6 = 1 THEN 21 END, CASE WHEN n % 6 = 2 THEN 22 END, CASE WHEN n % 6 = 3 THEN 24 END, CASE WHEN n % 6 = 4 THEN 25 END, CASE WHEN k % 5 = 0 THEN 26 END], lambda x: x IS NOT NULL)) AS rule FROM p)
SELECT k AS edl, CAST(rule AS INT) AS rule FROM v"""
)
def edl_head_violations(spark, sf_dir):
    """Rules for the fields of a whole list, as JSON."""
    k, n = F.col("k"), F.col("n")
    captions = F.when(n % 6 == 0, "/c.srt").when(n % 6 == 1, '{"style": "bold", "size": "1"}').when(n % 6 == 2, '{"path": 5}').when(n % 6 == 3, '{"path": "x", "force_style": ["b"]}').when(n % 6 == 4, "12.5").otherwise('{"path": "a,b: c", "style": "x"}')
    sources = F.when(k % 14 == 0, '{"a": 1}').when(k % 7 == 0, '["a", 2]').when(k % 2 == 0, '["a.mov", "b, \\"c\\".mov"]').otherwise('{"a": "x:y", "b": "z"}')
    heads = _part(spark, sf_dir).select(k.alias("edl"), F.lit(1).alias("version"), F.when(k % 11 == 0, "loud").alias("grade"), sources.alias("sources"), captions.alias("subtitles"), F.when(k % 5 == 0, '{"a": 1}').when(k % 3 == 0, "[]").alias("overlays"))
    ranges = heads.select("edl", F.lit(0).alias("range_idx"), F.lit("a").alias("source"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(None).cast("string").alias("grade"))
    return edl.range_violations(heads, ranges, ranges.select("edl", "source")).select("edl", "rule")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), v AS (SELECT k, unnest(list_filter([CASE WHEN n % 4 = 0 THEN 1 END, CASE WHEN n % 5 = 0 THEN 2 END, CASE WHEN n % 3 = 0 THEN 3 END], lambda x: x IS NOT NULL)) AS rule FROM p)
SELECT k AS media, CAST(rule AS INT) AS rule FROM v"""
)
def payload_heads(spark, sf_dir):
    """Languages and window counts of payloads."""
    p = _part(spark, sf_dir)
    k, n = F.col("k").alias("media"), F.col("n")
    asked = p.select(k, F.lit("en").alias("source_language"), F.lit("de").alias("target_language"))
    got = p.select(k, F.when(n % 4 != 0, "en").alias("source_language"), F.when(n % 5 == 0, "fr").otherwise("de").alias("target_language"))
    windows = p.select(k, F.explode(F.sequence(F.lit(1), F.when(n % 3 == 0, 2).otherwise(3))))
    return edl.payload_language_violations(asked, got).unionByName(edl.payload_count_violations(p.select(k, F.explode(F.sequence(F.lit(1), F.lit(3)))), windows)).select("media", "rule")


@query("SELECT d.doc_id AS media, CASE WHEN n >= 3 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'skip' ELSE 'overwrite' END ELSE 'process' END AS decision FROM documents d LEFT JOIN (SELECT doc_id, doc_id % 5 AS n FROM documents) USING (doc_id)")
def skip_decisions(spark, sf_dir):
    """Outputs that are there (none to four of each), with a fresh cache for every second medium."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media"), F.lit("mlx").alias("backend"), F.lit("h").alias("source_hash"))
    there = d.select("media", F.explode(F.sequence(F.lit(1), (F.col("media") % 5).cast("int"))).alias("output")).where("output <= media % 5")
    return sinks.skip_decision(d, there.where("media % 5 > 0"), d.withColumn("source_hash", F.when(F.col("media") % 2 == 0, "h").otherwise("old"))).select("media", "decision")


@query(
    """WITH o AS (SELECT p_partkey % 100 AS edl, p_partkey AS overlay_idx, '/o/' || CAST(p_partkey % 50 AS VARCHAR) AS source FROM part WHERE p_size % 3 <> 0) SELECT edl, overlay_idx, source FROM o WHERE CAST(substr(source, 4) AS INT) % 4 <> 0"""
)
def missing_overlays(spark, sf_dir):
    k = F.col("k")
    o = _part(spark, sf_dir).select((k % 100).alias("edl"), k.alias("overlay_idx"), F.when(F.col("n") % 3 != 0, F.concat(F.lit("/o/"), (k % 50).cast("string"))).alias("source"))
    return edl.missing_overlays(o, spark.range(0, 52, 4).select(F.concat(F.lit("/o/"), F.col("id").cast("string")).alias("path")))


# Queries in modules of their own register themselves here.
from cuegrid import catalog_jobs, catalog_sources, catalog_stateful  # noqa: E402, F401
