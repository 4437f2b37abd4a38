"""Whole jobs over files that Spark writes from the given tables, with their SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid import jobs
from cuegrid.catalog import BOUNDS_SQL, CHUNK_SQL, ORACLES, Edit, _code_sql, _findings, _part, _slice_sql, _turn_segments, phrase_cues, query, shared_folder, table, words
from cuegrid.functions import text as X
from cuegrid.operators import folds, signal
from cuegrid.plans import runner
from cuegrid.sources import readers, sinks


def _written(spark, documents: DataFrame, name: str, ending: str, media: str = "media") -> str:
    """Documents as one file each, in a fresh folder."""
    folder = shared_folder(spark, name)
    sinks.write_documents(documents.select(F.col(media).alias("media"), "document"), folder, ending=ending)
    return folder


def _keep(spark) -> Callable[[DataFrame, str], DataFrame]:
    """Writes tables to a fresh folder and reads them back."""
    return jobs._kept(spark, shared_folder(spark, "kept"))


def _numbered(df: DataFrame, media: str = "media") -> DataFrame:
    """Media that are paths again as the numbers in their names."""
    return df.withColumn(media, X.stem(F.col(media)).cast("long"))


def _transcript_files(spark, sf_dir: str) -> str:
    return _written(spark, sinks.transcript_documents(words(spark, sf_dir)), "transcripts", ".json")


@query(ORACLES["packed_files"])
def job_pack(spark, sf_dir):
    """Words written as transcripts, read and packed."""
    return _numbered(jobs.pack(spark, _transcript_files(spark, sf_dir)))


def _edit_files(spark, sf_dir: str) -> tuple[str, str, str]:
    """Folders of edit lists (each calls its conversation A), transcripts and probes."""
    edit, keep = Edit(spark, sf_dir), _keep(spark)
    edit.words = keep(edit.words, "words")
    second = lambda c: F.col(c) / 1000
    one = F.struct("range_idx", F.struct(F.lit("A").alias("source"), second("start_ms").alias("start"), second("end_ms").alias("end")).alias("r"))
    listed = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["r"])
    body = F.struct(F.lit(1).alias("version"), F.create_map(F.lit("A"), F.concat(F.lit("/m/"), F.col("edl").cast("string"), F.lit(".mov"))).alias("sources"), listed.alias("ranges"))
    lists = edit.ranges.groupBy("edl").agg(F.to_json(body).alias("document"))
    ends = edit.words.groupBy("media").agg(((F.max("end_ms") + 10) / 1000).alias("d"))
    probes = ends.select("media", F.to_json(F.struct(F.struct(F.col("d").cast("string").alias("duration")).alias("format"), F.array(F.struct(F.when(F.col("media") % 2 == 0, "audio").otherwise("video").alias("codec_type"))).alias("streams"))).alias("document"))
    return _written(spark, lists, "edits", ".json", "edl"), _written(spark, sinks.transcript_documents(edit.words), "transcripts", ".json"), _written(spark, probes, "probes", ".json")


@query(f"WITH {BOUNDS_SQL} SELECT edl, CAST(range_idx AS INT) AS range_idx, cut_start, cut_end, edl % 2 = 0 AS sound FROM bounds")
def job_edit_segments(spark, sf_dir):
    """Edit lists read with transcripts and probes, and cut: all call their source A."""
    lists, transcripts, probes = _edit_files(spark, sf_dir)
    _, segments, _ = jobs.edit_plan(spark, lists, transcripts, probed=probes, keep=_keep(spark))
    return _numbered(segments, "edl").select("edl", "range_idx", "cut_start", "cut_end", (~F.array_contains("argv", "-an")).alias("sound"))


@query(
    f"""WITH {BOUNDS_SQL},
placed AS (SELECT *, coalesce(sum(greatest(cut_end - cut_start, 0)) OVER (PARTITION BY edl ORDER BY range_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM bounds),
jw AS (SELECT * FROM joined WHERE pos IS NOT NULL),
{CHUNK_SQL.format(breaks='.,!?;:', key='PARTITION BY edl, range_idx', source='jw')},
g AS (SELECT edl, range_idx, chunk, min(word_start) AS ws, max(word_end) AS we, string_agg(word, ' ' ORDER BY pos) AS t FROM c3 GROUP BY edl, range_idx, chunk),
h AS (SELECT g.*, CAST(greatest(ws - cut_start, 0) + off AS BIGINT) AS b, CAST(least(we, cut_end) - cut_start + off AS BIGINT) AS z FROM g JOIN placed USING (edl, range_idx) WHERE cut_end > cut_start),
n AS (SELECT *, row_number() OVER (PARTITION BY edl ORDER BY b, range_idx, chunk) AS cue, CASE WHEN z <= b THEN b + 400 ELSE z END AS e FROM h)
SELECT edl, string_agg(CAST(cue AS VARCHAR) || chr(10) || {_code_sql('b', ',')} || ' --> ' || {_code_sql('e', ',')} || chr(10) || upper(replace(regexp_replace(t, '[,;:]+$', ''), 'ß', 'SS')) || chr(10), chr(10) ORDER BY cue) AS document FROM n GROUP BY edl"""
)
def job_edit_captions(spark, sf_dir):
    lists, transcripts, probes = _edit_files(spark, sf_dir)
    _, _, captions = jobs.edit_plan(spark, lists, transcripts, probed=probes, keep=_keep(spark))
    return _numbered(captions, "edl")


def _srt_files(spark, sf_dir: str) -> str:
    return _written(spark, sinks.srt_documents(phrase_cues(spark, sf_dir), order=("phrase_id",)), "srt", ".srt")


@query(ORACLES["translation_windows"].rsplit("\nSELECT media", 1)[0] + "\nSELECT media, CAST(window_id AS BIGINT) AS window_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(count(*) AS INT) AS n_cues, string_agg(text, ' ' ORDER BY cue) AS source_text, '' AS translated_text FROM f GROUP BY media, window_id")
def job_translation_template(spark, sf_dir):
    """SRT files to templates for a translator, and these read again."""
    made = jobs.translation_template(spark, _srt_files(spark, sf_dir), "en", "de")
    read = _numbered(made).select("media", F.explode(F.from_json("document", readers.TRANSLATION)["windows"]).alias("w"))
    return read.select("media", F.col("w.id").cast("long").alias("window_id"), readers.ms(F.col("w.start")).alias("start_ms"), readers.ms(F.col("w.end")).alias("end_ms"), F.size("w.source_cue_indices").alias("n_cues"), "w.source_text", "w.translated_text")


@query(
    ORACLES["clauses_wrap"].rsplit("\nSELECT media, CAST(window_id", 1)[0]
    + f""",
bl AS (SELECT media, window_id, unnest(range(1, len(b) + 1)) AS block, s, e, unnest(b) AS text FROM m WHERE done),
bw AS (SELECT *, greatest(length(replace(text, ' ', '')), 1) AS w FROM bl),
bs AS (SELECT *, sum(w) OVER (PARTITION BY media, window_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY media, window_id) AS total FROM bw),
bt AS (SELECT *, CAST(s + (2 * (e - s) * (upto - w) + total) // (2 * total) AS BIGINT) AS b, CAST(s + (2 * (e - s) * upto + total) // (2 * total) AS BIGINT) AS z, row_number() OVER (PARTITION BY media ORDER BY window_id, block) AS cue FROM bs)
SELECT media, string_agg(CAST(cue AS VARCHAR) || chr(10) || {_code_sql('b', ',')} || ' --> ' || {_code_sql('z', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY cue) AS document FROM bt GROUP BY media"""
)
def job_translated_subtitles(spark, sf_dir):
    """Templates filled in with the source's own text, as subtitles again."""
    made = jobs.translation_template(spark, _srt_files(spark, sf_dir), "en", "de")
    payload = F.from_json("document", readers.TRANSLATION)
    filled = made.select("media", F.to_json(payload.withField("windows", F.transform(payload["windows"], lambda w: w.withField("translated_text", w["source_text"])))).alias("document"))
    return _numbered(jobs.translated_subtitles(spark, _written(spark, filled, "payloads", ".json")))


@query(
    ORACLES["caption_even_timing"].rsplit("\nSELECT media", 1)[0]
    + f""", k AS (SELECT *, {_slice_sql('s', 'e', '(chunk - 1)', 'n')} AS b, {_slice_sql('s', 'e', 'chunk', 'n')} AS z, upper(replace(regexp_replace(t, '[;:,，、]+$', ''), 'ß', 'SS')) AS text, row_number() OVER (PARTITION BY media ORDER BY phrase_id, chunk) AS cue FROM h)
SELECT media, string_agg(CAST(cue AS VARCHAR) || chr(10) || {_code_sql('b', ',')} || ' --> ' || {_code_sql('z', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY cue) AS document FROM k GROUP BY media"""
)
def job_styled_captions(spark, sf_dir):
    return _numbered(jobs.styled_captions(spark, _srt_files(spark, sf_dir)))


@query(
    """WITH p AS (SELECT p_size AS spec, p_partkey AS k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS i FROM part)
SELECT spec, CAST(i AS INT) AS segment_idx, 'unsupported segment type: film' AS error, NULL AS document FROM p WHERE k % 4 = 3
UNION ALL SELECT spec, NULL, NULL, string_agg('file ''/g/s' || CAST(k AS VARCHAR) || '.mp4''', chr(10) ORDER BY k) || chr(10) FROM p GROUP BY spec"""
)
def job_rough_cuts(spark, sf_dir):
    """Specs of parts of one size: errors by segment, and each spec's manifest."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("card", "image", "clip", "film"))), (k % 4 + 1).cast("int"))
    one = F.struct(k.alias("k"), F.struct(F.concat(F.lit("s"), k.cast("string")).alias("name"), kind.alias("type"), F.lit("/m/x.mov").alias("input"), F.lit("0:01").alias("start"), F.lit("0:03").alias("end"), F.lit("5").alias("duration"), F.col("p_name").alias("header")).alias("s"))
    body = F.struct(F.lit("/g").alias("generated_clips_dir"), F.lit("/t").alias("text_dir"), F.lit("/g/list.txt").alias("manifest_path"), F.lit("/g/all.mp4").alias("assembly_path"), F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
    specs = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("media")).agg(F.to_json(body).alias("document"))
    errors, _, joins = jobs.rough_cuts(spark, _written(spark, specs, "specs", ".json"))
    none = lambda kind: F.lit(None).cast(kind)
    both = errors.select("spec", "segment_idx", "error", none("string").alias("document")).unionByName(joins.select("spec", none("int").alias("segment_idx"), none("string").alias("error"), "document"))
    return both.withColumn("spec", X.stem(F.col("spec")).cast("int"))


@query("SELECT conv_id AS media, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS source_hash FROM conversations GROUP BY conv_id")
def source_hashes(spark, sf_dir):
    """Conversations as files, and the hashes of their bytes."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    folder = _written(spark, table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("media")).agg(said.alias("document")), "hashed", ".txt")
    read = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("media"), readers.content_hash(F.col("content")).alias("source_hash"))
    return _numbered(read)


@query(
    ORACLES["captions_split"].rsplit("\nSELECT media, turn, CAST(block", 1)[0]
    + """, q AS (SELECT media, count(*) AS n FROM (SELECT DISTINCT media, turn, block FROM g) GROUP BY media)
SELECT media, count(*) AS source_segment_count, CAST(any_value(q.n) AS BIGINT) AS segment_count, true AS used_word_timestamps, CAST(4.0 AS DOUBLE) AS target_duration_seconds, CAST(14 AS INT) AS max_words FROM seg JOIN q USING (media) GROUP BY media"""
)
def segmentation_metadata(spark, sf_dir):
    segments = _turn_segments(spark, sf_dir)
    made = folds.segmentation_metadata(segments, folds.captions(segments, ("media", "turn")))
    return made.select("media", "source_segment_count", "segment_count", "used_word_timestamps", "target_duration_seconds", "max_words")


@query("SELECT p_partkey AS k, unnest(range(0, 5)) AS place, unnest(list_transform(range(0, 5), lambda j: CAST(round_even((p_size + (p_partkey % 9) * j / 4.0) * 1000, 0) AS BIGINT))) AS at_ms, CAST(round_even((p_size + (p_partkey % 9) / 2.0) * 1000, 0) AS BIGINT) AS middle_ms FROM part")
def frame_times(spark, sf_dir):
    begin = F.col("n").cast("double")
    times = lambda n: signal.frame_times(begin, begin + F.col("k") % 9, n)
    made = _part(spark, sf_dir).select("k", F.posexplode(times(5)).alias("place", "t"), times(1)[0].alias("m"))
    return made.select("k", F.col("place").cast("long").alias("place"), F.rint(F.col("t") * 1000).cast("long").alias("at_ms"), F.rint(F.col("m") * 1000).cast("long").alias("middle_ms"))


@query(
    """WITH p AS (SELECT p_partkey AS k, ['auto', 'whisper', 'mlx', 'faster-whisper', 'elevenlabs', 'other'][p_partkey % 6 + 1] AS r, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b, p_size % 5 = 0 AS c FROM part),
q AS (SELECT *, CASE WHEN r IN ('auto', 'whisper') THEN CASE WHEN a THEN 'mlx' WHEN b THEN 'faster-whisper' END WHEN r = 'mlx' AND a THEN r WHEN r = 'faster-whisper' AND b THEN r WHEN r = 'elevenlabs' AND c THEN r END AS backend FROM p)
SELECT k, backend, CASE WHEN backend IS NULL THEN CASE WHEN r IN ('auto', 'whisper') THEN 'no backend is available' WHEN r = 'elevenlabs' THEN 'no key for elevenlabs' WHEN r = 'other' THEN 'unsupported backend: other' ELSE r || ' is not available' END END AS error, CASE WHEN backend = 'elevenlabs' THEN 'scribe_v1' ELSE 'small' END AS model FROM q"""
)
def backend_choices(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    asked = F.element_at(F.array(*(F.lit(x) for x in ("auto", "whisper", "mlx", "faster-whisper", "elevenlabs", "other"))), (k % 6 + 1).cast("int"))
    made = _part(spark, sf_dir).select("k", runner.backend_choice(asked, n % 2 == 0, n % 3 == 0, n % 5 == 0).alias("c")).select("k", "c.*")
    return made.withColumn("model", runner.model_name(F.col("backend"), F.lit("small")))


@query(
    """WITH f AS (SELECT user_id AS media, event_id AS finding, CASE WHEN event_id % 4 <> 0 THEN event_id % 300 END AS cut FROM events), c AS (SELECT DISTINCT media, cut FROM f WHERE cut IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY cut) - 1 AS i FROM c), n AS (SELECT media, count(*) AS n, count(*) FILTER (i % 5 <> 4) AS ok FROM p GROUP BY media)
SELECT media, 'timeline_pngs' AS kind, ok = n AS passed, 'Generated ' || CAST(ok AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ' timeline PNG(s)' AS details FROM n
UNION ALL SELECT media, 'timeline_png_generation', false, 'Timeline PNG failed at boundary ' || CAST(i AS VARCHAR) || ' (' || printf('%.2f', cut / 10.0) || 's): no frame' FROM p WHERE i % 5 = 4
UNION ALL SELECT f.media, 'visual_discontinuity', NULL, CASE WHEN i % 5 <> 4 THEN '/t/' || CAST(f.media AS VARCHAR) || '/boundary_' || lpad(CAST(i AS VARCHAR), 3, '0') || '_' || printf('%.2f', f.cut / 10.0) || 's.png' END FROM f JOIN p ON p.media = f.media AND p.cut = f.cut WHERE f.finding % 4 = 1"""
)
def boundary_pictures(spark, sf_dir):
    """Pictures of the cuts of all findings, every fifth of which fails, attached to the visual checks."""
    found = _findings(spark, sf_dir).withColumn("check", F.when(F.col("check") == "visual", "visual_discontinuity").otherwise(F.col("check")))
    spans = signal.boundary_spans(found.where("cut_time IS NOT NULL").select("media", "cut_time").distinct(), "/t")
    pictures = spans.withColumn("error", F.when(F.col("picture_no") % 5 == 4, "no frame"))
    made = signal.with_pictures(found, pictures)
    new = made.where(F.col("check").startswith("timeline")).select("media", F.col("check").alias("kind"), "passed", "details")
    return new.unionByName(made.where("check = 'visual_discontinuity'").select("media", F.col("check").alias("kind"), F.lit(None).cast("boolean").alias("passed"), F.col("timeline_png").alias("details")))
