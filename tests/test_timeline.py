"""Exact cases for the interval operators."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.operators import edl, folds, islands, signal
from cuegrid.plans import ffmpeg
from cuegrid.sources import readers, sinks

WORDS = "media long, pos int, word string, start_ms long, end_ms long, speaker string"


def made(spark, rows, schema=WORDS):
    return spark.createDataFrame(rows, schema)


def value(spark, column, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "words,texts,speakers",
    [
        ([("Hello", 0, 1000, None), ("world", 1200, 2000, None), ("this", 2200, 3000, None)], ["Hello world this"], [None]),
        ([("Hello", 0, 1000, None), ("world", 1200, 2000, None), ("Goodbye", 2700, 3500, None)], ["Hello world", "Goodbye"], [None, None]),
        ([("Hello", 0, 1000, "A"), ("there", 1100, 2000, "A"), ("Hi", 2100, 3000, "B")], ["Hello there", "Hi"], ["A", "B"]),
        ([("One", 0, 1000, None), ("Two", 1500, 2000, None)], ["One", "Two"], [None, None]),
        ([("Hello", 0, 1000, "A"), ("world", 1100, 2000, None)], ["Hello world"], ["A"]),
        ([("Hello", 0, 1000, None), ("there", 1100, 2000, "A"), ("Hi", 2100, 3000, "B")], ["Hello there", "Hi"], ["A", "B"]),
        ([("Hello", 0, 100, None), (" ,", 100, 200, None), ("world", 200, 300, None), (" .", 300, 400, None)], ["Hello, world."], [None]),
        ([("12", 0, 100, None), (" :", 100, 200, None), ("30", 200, 300, None)], ["12 : 30"], [None]),
        ([("  ", 0, 100, None)], [], []),
    ],
)
def test_phrases(spark, words, texts, speakers):
    rows = [(1, k, *w) for k, w in enumerate(words)]
    got = islands.phrases(made(spark, rows)).orderBy("phrase_id").collect()
    assert [r.text for r in got] == texts and [r.speaker for r in got] == speakers


def test_phrases_equal_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], []
    for m in range(60):
        t, held = 0, None
        for k in range(rng.randint(1, 12)):
            t += rng.choice([0, 100, 499, 500, 900])
            s = rng.choice([None, "A", "B"])
            rows.append((m, k, f"w{k}", t, t + 50, s))
            new = held is None or t - held[1] >= 500 or (s and held[2] and s != held[2])
            if new:
                want.append([m, 0])
                held = [None, 0, None]
            want[-1][1] += 1
            held = [None, t + 50, held[2] or s]
            t += 50
    got = islands.phrases(made(spark, rows)).orderBy("media", "phrase_id").collect()
    assert [[r.media, r.n_words] for r in got] == want


@pytest.mark.parametrize(
    "words,span,gaps",
    [
        ([], (0, 5000), []),
        ([(0, 500), (500, 1000)], (0, 1000), []),
        ([(0, 500), (1500, 2000)], (0, 2000), [(500, 1500)]),
        ([(0, 500)], (0, 3000), [(500, 3000)]),
        ([(0, 300), (699, 1000)], (0, 1000), []),
        ([(2000, 2500), (0, 500)], (0, 2500), [(500, 2000)]),
    ],
)
def test_silences(spark, words, span, gaps):
    w = made(spark, [(1, k, "x", a, b, None) for k, (a, b) in enumerate(words)])
    r = made(spark, [(1, *span)], "media long, range_start long, range_end long")
    assert sorted((x.start_ms, x.end_ms) for x in islands.silences(w, r).collect()) == gaps


@pytest.mark.parametrize(
    "speakers,texts,names",
    [
        (["s0", "s0"], ["w0 w1"], ["s0"]),
        (["s0", "s1", "s1", "s1"], ["w0", "w1 w2 w3"], ["s0", "s1"]),
        (["s0", None, "s1"], ["w0 w1", "w2"], ["s0", "s1"]),
        ([None, "s0", "s0"], ["w0 w1 w2"], ["s0"]),
        ([None, None], ["w0 w1"], [None]),
    ],
)
def test_speaker_segments(spark, speakers, texts, names):
    rows = [(1, k, f"w{k}", k * 100, k * 100 + 50, s) for k, s in enumerate(speakers)]
    got = islands.speaker_segments(made(spark, rows)).orderBy("segment_id").collect()
    assert [r.text for r in got] == texts and [r.speaker for r in got] == names


def test_bold_captions(spark):
    cues = made(spark, [(1, 0, 3000, "one two three four five six"), (2, 0, 3000, ""), (3, 0, 2000, "Hello, world this is a test;")], "media long, start_ms long, end_ms long, text string")
    got = islands.bold_captions(cues, ("media",)).orderBy("media", "chunk").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got if r.media == 1] == [(0, 1000, "ONE TWO"), (1000, 2000, "THREE FOUR"), (2000, 3000, "FIVE SIX")]
    assert [r.text for r in got if r.media == 3] == ["HELLO", "WORLD THIS", "IS A", "TEST"] and not [r for r in got if r.media == 2]


@pytest.mark.parametrize("n,sizes", [(12, [7, 5]), (9, [7, 2]), (8, [7, 1]), (3, [3]), (0, []), (10, [7, 3])])
def test_natural_sizes(spark, n, sizes):
    words = F.array(*(F.lit(f"w{k}") for k in range(n))) if n else F.expr("CAST(ARRAY() AS ARRAY<STRING>)")
    assert spark.range(1).select(folds.natural_chunk_sizes(words).alias("v")).first()["v"] == sizes


def test_natural_tail_joins(spark):
    words = F.split(F.lit("a b c d, e f"), " ")
    assert spark.range(1).select(folds.natural_chunk_sizes(words).alias("v")).first()["v"] == [6]


def test_sentence_case(spark):
    assert value(spark, X.sentence_case(F.col("t")), t="the API response") == "The API response"


def test_caption_split():
    text = "Hello everyone, thanks for joining. Today we talk about captions and why they have to be split well."
    words, t = [], 0
    for k, w in enumerate(text.split()):
        words.append({"word": (" " if k else "") + w, "start_ms": t, "end_ms": t + 600})
        t += 650
    blocks = folds.captions_of(words, text, 0, t, "A")
    assert len(blocks) > 1 and all(b["end_ms"] - b["start_ms"] <= 5000 for b in blocks)
    assert " ".join(b["text"] for b in blocks) == text


def test_pseudo_words():
    words = folds.pseudo_words("a b c", 0, 1000)
    assert [w["start_ms"] for w in words] == [0, 333, 667] and words[-1]["end_ms"] == 1000


def test_overflow_at_a_break_goes_back_one_word():
    # The overflowing word is a preferred break itself: the earlier comma is forgotten.
    words = [{"word": w, "start_ms": s, "end_ms": e} for w, s, e in [("a,", 0, 500), (" b", 500, 3000), (" c", 3000, 3900), (" d.", 3900, 5600), (" e", 5600, 6000)]]
    assert [len(b) for b in folds.split_caption(words)] == [3, 2]


def test_tiny_blocks_join_same_speaker_only():
    b = lambda s, e, who: {"start_ms": s, "end_ms": e, "text": "x", "n_words": 1, "speaker": who}
    assert len(folds.merge_tiny([b(0, 2000, "A"), b(2000, 2500, "A")])) == 1
    assert len(folds.merge_tiny([b(0, 2000, "A"), b(2000, 2500, "B")])) == 2
    assert len(folds.merge_tiny([b(0, 2000, "A"), b(2000, 3000, "A")])) == 2


def test_translation_windows(spark):
    cues = made(spark, [(1, 1, 0, 3000, "Planning happens in one"), (1, 2, 3000, 6000, "place, execution in another."), (1, 3, 6000, 9000, "Review happens later.")], "media long, cue int, start_ms long, end_ms long, text string")
    got = folds.translation_windows(cues).orderBy("window_id").collect()
    assert [(r.cue_first, r.cue_last) for r in got] == [(1, 2), (3, 3)]
    assert got[0].source_text == "Planning happens in one place, execution in another."


def test_clauses_and_wrapping():
    assert folds.clauses("Wait... no") == ["Wait.", ".", ".", "no"]
    assert folds.clauses("short, and a rather longer part, end") == ["short, and a rather longer part,", "end"]
    assert folds.wrapped("字" * 50) == ["字" * 24, "字" * 24, "字" * 2]
    assert all(len(x) <= 84 for x in folds.wrapped("word " * 60))
    assert folds.wrapped("x" * 20) == ["x" * 20]
    assert folds.long_enough(["aaaa", "b", "cccc"], 9000) == ["aaaa", "b", "cccc"]
    assert folds.long_enough(["aaaa", "b", "cccc"], 3000) == ["aaaa b", "cccc"]


def test_allocation(spark):
    b = made(spark, [(1, 1, 0, 8000, "字字字"), (1, 2, 0, 8000, "字")], "media long, block int, start_ms long, end_ms long, text string")
    got = islands.allocated(b, ("media",)).orderBy("block").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 6000), (6000, 8000)]


RANGE = "edl long, range_idx int, source string, start_ms long, end_ms long"
SOURCE_WORD = "source string, pos int, word string, word_start long, word_end long"


@pytest.mark.parametrize(
    "span,words,length,want",
    [
        ((10_000, 20_000), [], None, (9970, 20_030)),
        ((10, 5000), [], None, (0, 5030)),
        ((10_000, 59_980), [], 60_000, (9970, 60_000)),
        ((40, 50), [], 5, (10, 10)),
        ((9900, 11_000), [("a", 9800, 10_500), ("b", 10_600, 11_000)], None, (9770, 11_030)),
        ((10_000, 11_100), [("a", 10_000, 10_500), ("b", 10_600, 11_200)], None, (9970, 11_230)),
        ((10_000, 20_000), [("a", 1000, 2000), ("b", 30_000, 31_000)], None, (9970, 20_030)),
        ((9900, 20_100), [("a", 9800, 10_500), ("b", 19_600, 20_200)], None, (9770, 20_230)),
    ],
)
def test_snap_and_pad(spark, span, words, length, want):
    r = made(spark, [(1, 0, "s", *span)], RANGE)
    w = made(spark, [("s", k, *x) for k, x in enumerate(words)], SOURCE_WORD)
    d = made(spark, [("s", length)], "source string, duration_ms long") if length else None
    got = edl.snapped_and_padded(edl.ranges_with_words(r, w), d).first()
    assert (got.cut_start, got.cut_end) == want


def test_bucketed_join_equals_nested_loop(spark):
    rng = random.Random(1)
    ranges = [(1, k, "s", a := rng.randrange(400_000), a + rng.randrange(1, 200_000)) for k in range(40)]
    words = [("s", k, "w", a := rng.randrange(600_000), a + rng.randrange(1, 90_000)) for k in range(60)]
    got = {(r.range_idx, r.pos) for r in edl.ranges_with_words(made(spark, ranges, RANGE), made(spark, words, SOURCE_WORD)).where("pos IS NOT NULL").collect()}
    assert got == {(r[1], w[1]) for r in ranges for w in words if w[4] > r[3] and w[3] < r[4]}


def _master(spark, ranges, words):
    r = made(spark, ranges, RANGE)
    joined = edl.ranges_with_words(r, made(spark, words, SOURCE_WORD))
    return edl.master_cues(edl.snapped_and_padded(joined), joined).orderBy("cue").collect()


def test_master_cues(spark):
    got = _master(spark, [(1, 0, "a", 5000, 6000), (1, 1, "b", 10_000, 11_000)], [("a", 0, "Hi.", 5000, 5500), ("b", 0, "yo", 10_000, 10_500)])
    assert [(r.start_ms, r.text) for r in got] == [(30, "HI."), (1090, "YO")]
    got = _master(spark, [(1, k, "s", k * 10_000, k * 10_000 + 1000) for k in range(3)], [("s", k, "w", k * 10_000, k * 10_000 + 500) for k in range(3)])
    assert got[-1].start_ms == 2120


@pytest.mark.parametrize("spans,want", [([(0, 10), (20, 30), (40, 50)], [10, 20]), ([(0, 3), (0, 10), (0, 0.5)], [3, 13])])
def test_boundaries(spark, spans, want):
    r = made(spark, [(1, k, "s", int(a * 1000), int(b * 1000)) for k, (a, b) in enumerate(spans)], RANGE)
    assert [x.boundary_ms for x in islands.cut_boundaries(r).orderBy("range_idx").collect()] == [x * 1000 for x in want]


@pytest.mark.parametrize("s,want", [(0.0, "00:00:00,000"), (5.5, "00:00:05,500"), (90.0, "00:01:30,000"), (3723.5, "01:02:03,500"), (59.9996, "00:01:00,000")])
def test_srt_time(spark, s, want):
    assert value(spark, X.srt_time_seconds(F.col("s")), s=s) == want


def test_srt_time_uncarried(spark):
    assert value(spark, X.srt_time_uncarried(F.col("s")), s=59.9996) == "00:00:60,000"


@pytest.mark.parametrize("ms,want", [(10_000, "afade=t=in:st=0:d=0.03,afade=t=out:st=9.970:d=0.03"), (59, ""), (60, "afade=t=in:st=0:d=0.03,afade=t=out:st=0.030:d=0.03")])
def test_fades(spark, ms, want):
    assert value(spark, ffmpeg.audio_fades(F.col("ms")), ms=ms) == want


def test_overlays(spark):
    rows = [(1, 1, "/a.mov", 5000, 10_000, 50.0, 100.0, 2.0), (1, 2, "/b.png", 0, 1000, 0.0, 0.0, None), (1, 3, "/c.mov", 0, 1000, 0.0, 0.0, -1.0)]
    parts = ffmpeg.overlay_parts(made(spark, rows, "edl long, idx int, path string, start_ms long, end_ms long, x double, y double, z_order double"))
    got = parts.orderBy("rank").collect()
    assert [r.idx for r in got] == [3, 2, 1]
    assert got[2].compose == "[v2][a1]overlay=enable='between(t,5.000,10.000)':eof_action=pass:x=50:y=100[v1]"
    assert got[1].prepare.startswith("[2:v]fps=30,scale='trunc(iw/2)*2:trunc(ih/2)*2',format=yuva420p,setpts=PTS-STARTPTS+0.000/TB[a2]")
    assert ffmpeg.overlay_graph(parts).first().filter_complex.endswith(";[v1]null[outv]")


@pytest.mark.parametrize("chain,found", [("subtitles=x", "subtitles"), ("scale=1,ass=x", "ass"), ("a;overlay=0", "overlay"), ("class=x", None), ("bass=g", None)])
def test_early_filters(spark, chain, found):
    assert value(spark, ffmpeg.early_filter(F.col("c")), c=chain) == found


def test_plans(spark):
    d = spark.range(1).select(F.lit("/a b.mov").alias("s"), F.lit("/o.mp4").alias("o"), F.lit(True).alias("yes"))
    run = lambda c: d.select(c.alias("v")).first()["v"]
    assert run(ffmpeg.grade(F.col("s"), F.col("o"), F.lit(""))) == ["ffmpeg", "-y", "-i", "/a b.mov", "-c", "copy", "-movflags", "+faststart", "/o.mp4"]
    assert "fps=0.90000000,scale=320:-1,tile=3x3" in run(ffmpeg.contact_sheet(F.col("s"), F.col("o"), F.lit(10.0), 3, 3, 320))
    assert run(ffmpeg.misused_concat(ffmpeg.concat(F.col("s"), F.col("o")))) is False
    assert run(ffmpeg.misused_concat(ffmpeg.argv("ffmpeg", "-lavfi", "x"))) is True
    assert run(ffmpeg.subtitle_filter(F.lit("/a:b'c.srt"), F.lit("F='x'"), F.lit("hue=s"))) == "hue=s,subtitles='/a\\:b\\'c.srt':force_style='F=\\'x\\''"
    assert run(ffmpeg.card_text(F.lit("H"), F.lit(" "), F.lit("B"))) == "H\n\nB"
    assert run(ffmpeg.loudnorm(F.col("s"), F.col("o"), None, F.col("yes")))[4:8] == ["-i", "/a b.mov", "-c:v", "copy"]
    assert run(X.quote_concat_path(F.lit("a'b"))) == "'a'\\''b'"


@pytest.mark.parametrize("text,want", [("90.5", 90.5), ("1:30", 90.0), ("01:01:30.5", 3690.5), ("1:2:3:4", None), ("x", None)])
def test_parse_time(spark, text, want):
    assert value(spark, X.parse_time(F.col("t")), t=text) == want


def test_signal(spark):
    ones = F.array_repeat(F.lit(1.0), 1600)
    assert value(spark, signal.windowed_rms(ones, 100)) == [1.0] * 100
    assert len(value(spark, signal.windowed_rms(F.array_repeat(F.lit(1.0), 2999), 2000))) == 2000
    assert value(spark, signal.frame_delta(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(9.0)))) == 0.5
    assert value(spark, signal.frame_times(F.lit(10.0), F.lit(20.0), 1)) == [15.0]
    assert value(spark, signal.frame_times(F.lit(0.0), F.lit(9.0), 10)) == [float(k) for k in range(10)]
    assert value(spark, signal.grade_filter(F.lit(0.48), F.lit(0.72), F.lit(0.25))) == ""
    assert value(spark, signal.grade_filter(F.lit(0.70), F.lit(0.72), F.lit(0.25))) == "eq=gamma=0.960"
    assert value(spark, signal.grade_filter(F.lit(0.10), F.lit(0.20), F.lit(0.05))) == "eq=contrast=1.080:gamma=1.080:saturation=1.080"


@pytest.mark.parametrize("depth,want", [(8, (128 / 255, 219 / 255, 64 / 255)), (10, (128 / 1023, 219 / 1023, 64 / 1023)), (0, (128.0, 219.0, 64.0))])
def test_signal_stats(spark, depth, want):
    lines = [f"lavfi.signalstats.{k}={v}" for k, v in (("YBITDEPTH", depth), ("YAVG", 128), ("YMIN", 16), ("YMAX", 235), ("SATAVG", 64))] + ["frame:0", "lavfi.signalstats.YAVG=x"]
    df = made(spark, [(1, k, x) for k, x in enumerate(lines)], "clip long, line_no int, line string")
    got = signal.signal_stats(readers.frame_stats(df)).first()
    assert (got.y_mean, got.y_range, got.sat_mean) == pytest.approx(want)


def test_grade_consistency_finds_the_first_pair(spark):
    rng = random.Random(2)
    rows = [(m, k, rng.choice([1, 2, 3, 9]) / 10) for m in range(80) for k in range(5)]
    got = {r.media: r for r in signal.grade_consistency(made(spark, rows, "media long, sample int, luminance double")).collect()}
    for m in range(80):
        x = [v for a, _, v in rows if a == m]
        best, pair = 0.0, (None, None)
        for i in range(5):
            for j in range(i + 1, 5):
                if abs(x[i] - x[j]) > best:
                    best, pair = abs(x[i] - x[j]), (i, j)
        assert (got[m].first, got[m].second) == pair and got[m].max_delta == best and got[m].passed == (best <= 0.15)


@pytest.mark.parametrize(
    "backend,end,length,reason",
    [("mlx", 286_853, 2_868_552, edl.MATCHED), ("faster-whisper", 286_853, 2_868_552, None), ("mlx", 60_000, 60_004, "ratio-close-to-1"), ("mlx", 30_000, 60_000, "ratio-does-not-match-observed-mlx-compression"), ("mlx", 0, 60_000, "missing-or-invalid-segment-end")],
)
def test_timestamp_correction(spark, backend, end, length, reason):
    got = edl.timestamp_correction(made(spark, [(backend, 2, end, length)], "backend string, n_segments int, last_end_ms long, duration_ms long")).first()
    assert got.reason == reason and (got.factor == 1.0) == (reason != edl.MATCHED)


def test_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# c\n\n  a.mov \n/b.mov\n")
    assert [r.path for r in readers.read_manifest(spark, str(tmp_path / "m.txt")).orderBy("line_no").collect()] == [f"{tmp_path}/a.mov", "/b.mov"]
    (tmp_path / "t.json").write_text('{"segments": [{"start": 0, "end": 1, "text": " hi ", "speaker_id": "s", "words": [{"word": "hi", "start": 0, "end": 0.5}, {"word": "x", "start": null, "end": 1}]}]}')
    t = readers.read_json(spark, str(tmp_path / "t.json"), readers.TRANSCRIPT)
    assert [(r.word, r.end_ms) for r in readers.transcript_words(t).collect()] == [("hi", 500)]
    assert readers.transcript_segments(t).first().text == "hi"
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\nx\n00:00:01,000 --> 00:00:02,500\nbad\n\n2\nshort\n")
    got = readers.read_srt(spark, str(tmp_path / "c.srt")).orderBy("block").collect()
    assert (got[0].start_ms, got[0].end_ms, got[0].text, got[0].error) == (1000, 2500, "Hello there", None) and all(r.error for r in got[1:])
    probe = '{"format": {"duration": "12.5"}, "streams": [{"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001"}]}'
    p = value(spark, readers.probe(F.col("j")), j=probe)
    assert (p.duration, p.width, p.fps, p.has_audio, p.has_video) == (12.5, 1920, 30, False, True)
    good = 'x {"input_i": "-20", "input_tp": "-1", "input_lra": "3", "input_thresh": "-30", "target_offset": "0.1"} y'
    assert value(spark, readers.loudness(F.col("j")), j=good).input_i == "-20" and value(spark, readers.loudness(F.col("j")), j="{}") is None
    assert value(spark, readers.retry_wait(F.lit(1), F.lit(None))) == 4.0 and value(spark, readers.retry_wait(F.lit(1), F.lit(500))) == 60.0


def test_edl_sources(spark):
    e = made(spark, [(1, '["/x/a.mov", "b.mov"]'), (2, '{"k": "/y.mov"}')], "edl long, sources string")
    assert sorted((r.edl, r.source, r.path) for r in readers.edl_sources(e).collect()) == [(1, "a.mov", "/x/a.mov"), (1, "b.mov", "b.mov"), (2, "k", "/y.mov")]


def test_silent_media(spark):
    docs = sinks.packed_markdown(made(spark, [(1, 1, "speaker_0", 0, 1500, "Hello")], "media long, phrase_id long, speaker string, start_ms long, end_ms long, text string"))
    got = {r.media: r.document for r in sinks.with_silent_media(docs, made(spark, [(1,), (2,)], "media long")).collect()}
    assert got == {1: "[0.000-1.500] S0 Hello", 2: sinks.NO_SPEECH}


def test_payload_violations(spark):
    schema = "media long, window_id int, start_ms long, end_ms long, source_text string, translated_text string"
    e = made(spark, [(1, 1, 0, 1, "a", None), (1, 2, 1, 2, "b", None)], schema)
    a = made(spark, [(1, 1, 0, 1, "A", "x"), (1, 3, 2, 3, "c", "")], schema)
    assert sorted((r.window_id, r.rule) for r in edl.payload_violations(e, a).collect()) == [(1, 4), (2, 1), (3, 2), (3, 5)]


def test_payload_language_violations(spark):
    schema = "media long, source_language string, target_language string"
    e = made(spark, [(k, "en", "de") for k in range(4)], schema)
    a = made(spark, [(0, "en", "de"), (1, "fr", "de"), (2, "en", None), (3, "de", "en")], schema)
    assert sorted((r.media, r.rule) for r in edl.payload_language_violations(e, a).collect()) == [(1, 1), (2, 2), (3, 1), (3, 2)]


def test_registered_functions(spark):
    X.register(spark)
    assert spark.sql("SELECT cue_srt_time(3723500L) AS a, cue_overlaps(0L, 5L, 5L, 9L) AS b").first() == ("01:02:03,500", False)


def test_runner(spark):
    from cuegrid.plans import runner

    plans = made(spark, [(1, ["a"]), (2, ["b"]), (3, ["c"])], "k long, argv array<string>")

    def call(argv):
        if argv == ["c"]:
            raise OSError("gone")
        return (0, "fine") if argv == ["a"] else (1, "bad input")

    assert sorted(map(tuple, runner.run(plans, "k", call=call).collect())) == [(1, 0, None), (2, 1, "bad input"), (3, -1, "OSError: gone")]
    heard = runner.transcribe(made(spark, [(1, "/a.wav"), (2, "/b.wav")], "media long, path string"), lambda p: {"words": [{"word": p, "start": 0, "end": 1}]} if p == "/a.wav" else 1 / 0)
    rows = {r.media: r for r in heard.collect()}
    assert rows[2].error.startswith("ZeroDivisionError")
    read = heard.where("error IS NULL").select("media", F.from_json("transcript", readers.TRANSCRIPT).alias("t")).select("media", "t.*")
    assert readers.transcript_words(read).first().word == "/a.wav"


def test_a_new_result_serves_one_finding(spark):
    cols = "media long, finding long, check string, cut_time double, passed boolean, severity string, details string"
    old = spark.createDataFrame([(1, 1, "v", 1.0, False, "fail", "a"), (1, 2, "v", 1.0, False, "fail", "b"), (1, 3, "v", None, False, "fail", "c"), (1, 4, "v", 1.005, False, "fail", "d"), (1, 5, "w", 1.0, False, "warning", "e")], cols)
    new = spark.createDataFrame([(1, 7, "v", 1.002, True, "info", "x"), (1, 8, "v", 1.008, False, "fail", "y"), (1, 9, "w", 1.0, True, "info", "z"), (1, 10, "v", 5.0, True, "info", "q")], cols)
    got = {r.finding: (r.passed, r.details) for r in signal.rechecked(old, new).collect()}
    open_still = " [unresolved after max passes]"
    assert got == {1: (True, "[retry 1] x"), 2: (False, "[retry 1] y" + open_still), 3: (False, "c" + open_still), 4: (False, "d" + open_still), 5: (False, "e")}


def test_documents_read_back(spark):
    w = spark.createDataFrame([("m", k, f"w{k}", 500 * k, 500 * k + 300, "s") for k in range(3)], "media string, pos int, word string, start_ms long, end_ms long, speaker string")
    (r,) = sinks.transcript_documents(w).collect()
    read = spark.createDataFrame([("m", r.document)], "media string, t string").select("media", F.from_json("t", readers.TRANSCRIPT).alias("t")).select("media", "t.*")
    assert sorted(map(tuple, readers.transcript_words(read).drop("type").collect())) == sorted(map(tuple, w.collect()))
    cues = spark.createDataFrame([("m", 1, 1, 0, 1500, "a"), ("m", 1, 2, 1500, 2000, "b")], "media string, window_id int, block int, start_ms long, end_ms long, text string")
    (r,) = sinks.translated_metadata(cues, cues.where("block = 1"), "en", "de").collect()
    import json

    assert json.loads(r.document) == {"source_srt": "m", "source_language": "en", "target_language": "de", "window_count": 1, "segment_count": 2, "segments": [{"start": 0.0, "end": 1.5, "text": "a"}, {"start": 1.5, "end": 2.0, "text": "b"}]}


def test_corrected_times(spark):
    media = edl.timestamp_correction(made(spark, [("a", "mlx", 2, 286_853, 2_868_552), ("b", "mlx", 1, 60_000, 60_004)], "media string, backend string, n_segments int, last_end_ms long, duration_ms long"))
    segments = made(spark, [("a", 1000, 2000, [("hi", 1100, 1234, "s")], "x"), ("b", 1000, 2000, [], "y")], "media string, start_ms long, end_ms long, words array<struct<word: string, start_ms: long, end_ms: long, speaker: string>>, speaker_id string")
    a, b = edl.corrected_times(segments, media).orderBy("media").collect()
    assert (a.start_ms, a.end_ms, tuple(a.words[0]), a.speaker_id) == (10_000, 20_000, ("hi", 11_000, 12_340, "s"), "x") and (b.start_ms, b.end_ms) == (1000, 2000)


def test_overlay_numbers(spark):
    rows = [("e", 0, "/o/a.png", None, None, None, None, None, None, None, 1.0, 2.0, None, "1.5", "x", "top"), ("e", 1, "/o/a.png", None, None, None, None, None, None, None, 1.0, 2.0, None, None, "7", None)]
    schema = "edl string, overlay_idx int, source string, card_type string, card_text string, counter_start double, counter_end double, width double, height double, font_size double, start double, end double, duration_type string, x string, y string, z_order string"
    assert sorted((r.overlay_idx, r.rule) for r in edl.overlay_violations(made(spark, rows, schema)).collect()) == [(0, 15), (0, 16)]


def test_next_of_a_key(spark):
    rng = random.Random(3)
    rows = sorted({(rng.choice(["a", "b", None]), rng.randrange(500)) for _ in range(200)}, key=str)
    got = {(r.k, r.n): r.next for r in signal.with_next(made(spark, [(k, n, None if n % 7 == 0 else n) for k, n in rows], "k string, n long, v long"), "k", "n", "v", 40).collect()}
    for k, n in rows:
        later = sorted(m for j, m in rows if j == k and m > n)
        assert got[k, n] == (None if not later or later[0] % 7 == 0 else later[0])


def test_output_paths(spark):
    run = lambda p, folder=None: value(spark, X.output_paths(F.lit(p), F.lit(folder) if folder else None))
    assert tuple(run("/m/a.b.MOV")) == ("/m/a.b.m4a", "/m/a.b.txt", "/m/a.b.srt", "/m/a.b.json")
    assert tuple(run("/m/a.wav", "/o")) == ("/m/a.wav", "/o/a.txt", "/o/a.srt", "/o/a.json") and run("/m/a.png") is None
