"""Queries over files that Spark writes from the given tables and reads again, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.catalog import WORDS_SQL, query, shared_folder, table, words
from cuegrid.functions import text as X
from cuegrid.sources import named_files, readers, wav

BINS = 500


@query(
    f"""WITH v AS (SELECT label, vec_id, unnest(range(len(embedding))) AS i, CAST(round_even(CAST(unnest(embedding) AS DOUBLE) * 32767, 0) AS BIGINT) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM v),
b AS (SELECT label, k // greatest(n // {BINS}, 1) AS bin, sqrt(sum(x * x) / any_value(greatest(n // {BINS}, 1))) / 32768 AS rms FROM s WHERE k // greatest(n // {BINS}, 1) < {BINS} GROUP BY label, k // greatest(n // {BINS}, 1)),
p AS (SELECT *, max(rms) OVER (PARTITION BY label) AS peak FROM b)
SELECT label AS clip, CAST(bin AS BIGINT) AS bin, CAST(round_even(rms / peak * 100000, 0) AS BIGINT) AS level, CAST(round_even(peak * 100000, 0) AS BIGINT) AS raw_peak FROM p"""
)
def pcm_envelope(spark, sf_dir):
    """The vectors of a label as one sound: a WAV file for each, written by rows and read in pieces of 16 KB."""
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    sound = e.select(F.concat(F.lit("clip_"), F.col("label").cast("string"), F.lit(".wav")).alias("name"), "vec_id", F.transform("embedding", lambda x: F.rint(x.cast("double") * 32767)).alias("values"))
    folder = shared_folder(spark, "clips")
    named_files.write_files(wav.wav_parts(sound, "name", "vec_id", "values"), folder, content="content", part="part")
    made = wav.envelopes(wav.read_wav(spark, folder, 1 << 14), BINS)
    hundred_thousandth = lambda c: F.rint(F.col(c) * 100_000).cast("long")
    clip = F.regexp_extract(X.stem(F.col("path")), r"clip_(-?\d+)$", 1).cast("int")
    return made.select(clip.alias("clip"), "bin", hundred_thousandth("level").alias("level"), hundred_thousandth("raw_peak").alias("raw_peak"))


def _transcript_documents(spark, sf_dir):
    """(media, value): every conversation as a transcript, in one of five layouts: flat words with audio events;
    segments with words, their numbers as text; segments as lists; a file that is cut off; a segment that is a number."""
    w = words(spark, sf_dir).withColumn("w", F.row_number().over(W.partitionBy("media", "turn").orderBy("pos")))
    second = lambda c: F.col(c) / 1000
    turns = w.groupBy("media", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"), F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct("word", second("start_ms").cast("string").alias("start"), second("end_ms").cast("string").alias("end")).alias("w")))), lambda x: x["w"]).alias("words"))
    flat = F.struct("pos", F.struct(F.col("word").alias("text"), second("start_ms").alias("start"), second("end_ms").alias("end"), F.col("speaker").alias("speaker_id"), F.when(F.col("pos") % 9 == 0, "audio_event").otherwise("word").alias("type")).alias("w"))
    first = w.where("media % 5 = 0").groupBy("media").agg(F.to_json(F.struct(F.lit("en").alias("language_code"), F.transform(F.sort_array(F.collect_list(flat)), lambda x: x["w"]).alias("words"), F.array(F.struct(F.lit("(door)").alias("text"), F.lit(0.25).alias("start"), F.lit(1.5).alias("end"))).alias("audio_events"))).alias("value"))
    objects = F.struct("turn", F.struct(second("start_ms").cast("string").alias("start"), second("end_ms").alias("end"), "text", F.col("speaker").alias("speaker_id"), "words").alias("s"))
    in_order = lambda one: F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"])
    listed = F.struct("turn", F.concat(F.lit("["), F.col("start_ms"), F.lit(","), F.col("end_ms"), F.lit(","), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("]")).alias("s"))
    second_kind = turns.where("media % 5 = 1").groupBy("media").agg(F.to_json(F.struct(F.lit("de").alias("language"), in_order(objects).alias("segments"))).alias("value"))
    third_kind = turns.where("media % 5 = 2").groupBy("media").agg(F.concat(F.lit('{"segments": ['), F.array_join(in_order(listed), ","), F.lit("]}")).alias("value"))
    broken = turns.where("media % 5 >= 3").groupBy("media").agg(F.when(F.col("media") % 5 == 3, F.lit('{"segments": [{"start": 0, "te')).otherwise('{"segments": [{}, 7]}').alias("value"))
    return first.unionByName(second_kind).unionByName(third_kind).unionByName(broken)


@query(
    f"""WITH {WORDS_SQL}, t AS (SELECT media, turn, row_number() OVER (PARTITION BY media ORDER BY turn) - 1 AS k, min(start_ms) AS s, max(end_ms) AS e, any_value(speaker) AS speaker, string_agg(word, ' ' ORDER BY pos) AS text FROM words GROUP BY media, turn)
SELECT media, 'word' AS kind, CAST(pos - 1 AS INT) AS place, word AS text, start_ms, end_ms, CASE WHEN media % 5 = 0 THEN speaker END AS speaker, CASE WHEN media % 5 = 0 THEN 'en' ELSE 'de' END AS language FROM words WHERE media % 5 <= 1
UNION ALL SELECT media, 'segment', CAST(k AS INT), text, s, e, CASE WHEN media % 5 = 1 THEN speaker END, CASE WHEN media % 5 = 1 THEN 'de' END FROM t WHERE media % 5 IN (1, 2)
UNION ALL SELECT DISTINCT media, 'event', 0, '(door)', 250, 1500, NULL, 'en' FROM words WHERE media % 5 = 0
UNION ALL SELECT media, 'event', CAST(row_number() OVER (PARTITION BY media ORDER BY pos) AS INT), word, start_ms, end_ms, NULL, 'en' FROM words WHERE media % 5 = 0 AND pos % 9 = 0
UNION ALL SELECT DISTINCT media, 'reject', NULL, CASE WHEN media % 5 = 3 THEN 'not JSON' ELSE 'segment 1 is neither an object nor a list of three' END, NULL, NULL, NULL, NULL FROM words WHERE media % 5 >= 3"""
)
def transcript_layouts(spark, sf_dir):
    """Words, segments, audio events and rejects of transcripts in five layouts, through one reader."""
    documents = _transcript_documents(spark, sf_dir)
    read = readers.parse_transcripts(documents)
    languages = read.select("media", "language")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind, place, speaker: df.select("media", F.lit(kind).alias("kind"), place.cast("int").alias("place"), "text", "start_ms", "end_ms", speaker.alias("speaker"))
    said = row(readers.transcript_words(read).withColumnRenamed("word", "text"), "word", F.col("pos"), F.col("speaker"))
    parts = row(readers.transcript_segments(read), "segment", F.col("segment"), F.col("speaker"))
    heard = row(readers.audio_events(read), "event", F.col("event"), none("string"))
    found = said.unionByName(parts).unionByName(heard).join(languages, "media", "left")
    wrong = readers.rejected(documents).select("media", F.lit("reject").alias("kind"), none("int").alias("place"), F.col("error").alias("text"), none("long").alias("start_ms"), none("long").alias("end_ms"), none("string").alias("speaker"), none("string").alias("language"))
    return found.unionByName(wrong)
