"""Jobs over files, end to end."""

import json

import pytest

from cuegrid import jobs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    words = [{"word": w, "start": k * 0.5, "end": k * 0.5 + 0.4, "speaker": "speaker_1"} for k, w in enumerate("So this is what we said. And then we stopped.".split())]
    (d / "a.json").write_text(json.dumps({"words": words, "segments": [{"start": 0, "end": 5, "text": "So this is what we said.", "speaker_id": "x"}]}))
    (d / "none.json").write_text(json.dumps({"segments": []}))
    (d / "c.srt").write_text("1\n00:00:00,000 --> 00:00:04,000\nPlanning happens in one\n\n2\n00:00:04,000 --> 00:00:08,000\nplace, here.\n")
    (d / "tr.json").write_text(json.dumps({"windows": [{"id": 1, "start": 0.0, "end": 8.0, "source_text": "x", "translated_text": "Planung an einem Ort. Ausführung anderswo."}]}))
    (d / "e.json").write_text(json.dumps({"version": 1, "sources": ["/m/a.mov"], "grade": "subtle", "ranges": [{"source": "a.mov", "start": 0.45, "end": 2.1}, {"source": "b.mov", "start": 3, "end": 2}]}))
    return d


def test_pack(spark, folder):
    got = {r.media.rsplit("/", 1)[1]: r.document for r in jobs.pack(spark, f"{folder}/{{a,none}}.json").collect()}
    head = "# Packed transcript\n\nPhrase-level, grouped on silences ≥ 0.5s or speaker change.\nUse `[start-end]` ranges to address cuts in the EDL.\n\n"
    assert got["none.json"] == head + "_no speech detected_\n" and got["a.json"].startswith(head + "[0.000-") and " S1 So this is" in got["a.json"] and got["a.json"].endswith("\n")


def test_subtitles(spark, folder):
    (r,) = jobs.subtitles(spark, f"{folder}/a.json").collect()
    assert r.srt.startswith("1\n00:00:00,000 --> ") and "[x] So this is what we said." in r.txt


def test_translation(spark, folder):
    (r,) = jobs.translation_template(spark, f"{folder}/c.srt", "en", "de").collect()
    payload = json.loads(r.document)
    assert payload["window_count"] == 1 and payload["windows"][0]["source_text"] == "Planning happens in one place, here." and payload["windows"][0]["source_cue_indices"] == [1, 2]
    (r,) = jobs.translated_subtitles(spark, f"{folder}/tr.json").collect()
    assert r.document.count("-->") == 2 and r.document.splitlines()[1].startswith("00:00:00,000") and r.document.strip().splitlines()[-2].endswith("00:00:08,000")


def test_styles(spark, folder):
    (bold,) = jobs.styled_captions(spark, f"{folder}/c.srt").collect()
    assert "PLANNING HAPPENS" in bold.document
    (natural,) = jobs.styled_captions(spark, f"{folder}/c.srt", "natural").collect()
    assert "Planning happens in one place,\n" in natural.document and "Here." in natural.document


def test_edit_plan(spark, folder):
    bad, segments, captions = jobs.edit_plan(spark, f"{folder}/e.json", f"{folder}/a.json")
    assert sorted((r.range_idx, r.rule) for r in bad.collect()) == [(1, 11), (1, 13)]
    (s,) = segments.collect()
    assert (s.cut_start, s.cut_end) == (420, 2430) and "scale=1920:-2,eq=contrast=1.03:saturation=0.98" in s.argv and s.argv[-1] == "seg_00_a.mp4"
    assert "THIS IS" in captions.first().document


@pytest.fixture(scope="module")
def media(tmp_path_factory):
    d = tmp_path_factory.mktemp("media")
    for name in ("probes", "words", "srt", "edl", "payload", "cut", "reports"):
        (d / name).mkdir()
    probe = lambda n, *kinds: json.dumps({"format": {"duration": str(n)}, "streams": [{"codec_type": k, "width": 640, "height": 360, "avg_frame_rate": "25/1"} for k in kinds]})
    (d / "probes" / "a.json").write_text(probe(4.0, "video"))
    (d / "probes" / "b.json").write_text(probe(30, "video", "audio"))
    (d / "probes" / "e.json").write_text(probe(5.4, "video", "audio"))
    entries = [("Hello", 1.0, 1.5, "word"), (" ", 1.5, 1.6, "spacing"), ("(bang)", 1.6, 2.2, "audio_event"), ("there.", 3.8, 4.3, "word"), ("later", 8.0, 8.4, "word")]
    (d / "words" / "a.json").write_text(json.dumps({"words": [{"text": t, "start": s, "end": e, "type": k} for t, s, e, k in entries]}))
    (d / "srt" / "a.srt").write_text("1\n00:00:00,000 --> 00:00:04,000\nPlanning happens in one\n\n2\n00:00:04,000 --> 00:00:08,000\nplace, here.\n")
    overlays = [{"source": "/o/x.png", "start": 1, "end": 2, "z_order": 1}, {"card": {"type": "film"}, "start": 2, "end": 1}, {"source": "/o/y.mov", "start": 0, "end": 3}]
    (d / "edl" / "e.json").write_text(json.dumps({"version": 1, "total_duration_s": 5.0, "sources": {"a": "/m/a.mov"}, "grade": "none", "ranges": [{"source": "a", "start": 1.2, "end": 3.9}, {"source": "a", "start": 1.0, "end": 3.7}], "overlays": overlays, "subtitles": {"style": "bold", "size": "1"}}))
    (d / "edl" / "plain.json").write_text(json.dumps({"version": 1, "sources": {"a": "/m/a.mov"}, "ranges": [{"source": "a", "start": 0, "end": 1}]}))
    window = {"id": 1, "start": 0.0, "end": 8.0, "source_text": "Planning  happens in one place, here.", "translated_text": " "}
    (d / "payload" / "p.json").write_text(json.dumps({"source_srt": "/s/a.srt", "source_language": "en", "target_language": "fr", "windows": [window]}))
    segments = [{"name": "t", "type": "card", "duration": "5", "header": " Title ", "body": "Text"}, {"name": "i", "type": "image", "input": "/m/i.png", "duration": "2"}, {"name": "c", "type": "clip", "input": "/m/a.mov", "start": "0:01", "end": "0:03"}, {"name": "x", "type": "film"}]
    (d / "cut" / "s.json").write_text(json.dumps({"generated_clips_dir": "/g", "text_dir": "/t", "manifest_path": "/g/list.txt", "assembly_path": "/g/all.mp4", "segments": segments}))
    (d / "reports" / "b.txt").write_text('x {"input_i": "-20", "input_tp": "-2", "input_lra": "7", "input_thresh": "-30", "target_offset": "0.1"} y')
    (d / "list.txt").write_text("# media\n/m/a.mov\n/m/x/../b.mov\n/m/none.mov\n")
    return d


def test_edit_plan_reads_words_ends_and_sound(spark, media):
    bad, segments, captions = jobs.edit_plan(spark, f"{media}/edl/e.json", f"{media}/words", probed=f"{media}/probes")
    assert sorted((str(r.range_idx), str(r.overlay_idx), r.rule) for r in bad.collect()) == [("-1", "None", 21), ("None", "1", 3), ("None", "1", 11)]
    rows = {r.range_idx: r for r in segments.collect()}
    assert (rows[0].cut_start, rows[0].cut_end) == (970, 4000), "to the edges of the words, and not past the source's end"
    assert "-an" in rows[0].argv and "-af" not in rows[0].argv
    text = captions.first().document
    assert "HELLO" in text and "BANG" not in text


def test_final_passes(spark, media):
    got = {r.edl.rsplit("/", 1)[1]: r.argv for r in jobs.final_passes(spark, f"{media}/edl", "/base", "/out", f"{media}/probes").collect()}
    e = got["e.json"]
    assert e[:11] == ["ffmpeg", "-y", "-i", "/base/e.mp4", "-loop", "1", "-i", "/o/x.png", "-i", "/o/y.mov", "-filter_complex"]
    graph = e[11]
    assert graph.startswith("[1:v]fps=30,") and "[0:v][a3]overlay=" in graph and "[v3][a1]overlay=" in graph and "[v1]subtitles='/base/e.srt':force_style='FontName" in graph and graph.endswith("[outv]")
    assert e[e.index("-t") + 1] == "5.400" and e[-1] == "/out/e.mp4"
    assert got["plain.json"] == ["ffmpeg", "-y", "-i", "/base/plain.mp4", "-c", "copy", "-movflags", "+faststart", "/out/plain.mp4"]


def test_translation_errors(spark, media):
    got = sorted((r.rule, r.message) for r in jobs.translation_errors(spark, f"{media}/payload", f"{media}/srt", "en", "de").collect())
    assert got == [(2, "target language differs"), (15, "no translation")]


def test_rough_cuts(spark, media):
    errors, segments, joins = jobs.rough_cuts(spark, f"{media}/cut", f"{media}/probes")
    assert [r.error for r in errors.collect()] == ["unsupported segment type: film"]
    rows = {r.name: r for r in segments.collect()}
    assert rows["t"].card == "Title\n\nText\n" and rows["t"].argv[6:8] == ["-i", "/t/t.png"]
    assert rows["c"].argv[-2:] == ["-shortest", "/g/c.mp4"] and "-map" not in rows["c"].argv and rows["i"].argv[5] == "2"
    (j,) = joins.collect()
    assert j.document.splitlines()[:2] == ["file '/g/t.mp4'", "file '/g/i.mp4'"] and j.argv[-1] == "/g/all.mp4" and "+genpts" in j.argv


def test_sheets_views_grades_and_loudness(spark, media):
    rows = {r.path: r for r in jobs.contact_sheets(spark, f"{media}/list.txt", "/o", f"{media}/probes").collect()}
    assert set(rows) == {"/m/a.mov", "/m/b.mov", "/m/none.mov"} and rows["/m/none.mov"].error == "no duration" and rows["/m/none.mov"].argv is None
    assert rows["/m/a.mov"].argv[5] == "fps=4.00000000,scale=320:-1,tile=4x4" and rows["/m/a.mov"].argv[-1] == "/o/a_contact_sheet.jpg"
    there = spark.createDataFrame([("/o/a_contact_sheet.jpg",)], "path string")
    skipped = {r.path: (r.decision, r.argv is None) for r in jobs.contact_sheets(spark, f"{media}/list.txt", "/o", f"{media}/probes", existing=there, skip=True).collect()}
    assert skipped["/m/a.mov"] == ("skip", True) and skipped["/m/b.mov"] == ("process", False)
    views = {r.path: r for r in jobs.timeline_views(spark, f"{media}/list.txt", "/o", f"{media}/probes", f"{media}/words", start=0.5, end=9.0, frames=3).collect()}
    a = views["/m/a.mov"]
    assert [x[3] for x in a.frame_argv] == ["0.500", "2.250", "4.000"] and a.ruler[6].label == "4.00s" and a.ruler[6].x == 1870 and a.layout.canvas_height == 536
    assert [x.word for x in a.labels] == ["Hello", "(bang)", "there."] and views["/m/none.mov"].error == "no duration"
    graded = {r.path: r.argv for r in jobs.grades(spark, f"{media}/list.txt", "/o", "subtle").collect()}
    assert "eq=contrast=1.03:saturation=0.98" in graded["/m/a.mov"] and graded["/m/a.mov"][-1] == "/o/a_graded.mp4"
    loud = {r.path: r for r in jobs.loudness(spark, f"{media}/list.txt", "/o", f"{media}/reports", f"{media}/probes").collect()}
    assert loud["/m/b.mov"].two_pass and not loud["/m/a.mov"].two_pass and any("measured_I=-20" in x for x in loud["/m/b.mov"].argv) and "-c:v" in loud["/m/b.mov"].argv


def test_burn_ins(spark, media):
    rows = {r.path: r for r in jobs.burn_ins(spark, f"{media}/list.txt", f"{media}/srt", "/o").collect()}
    assert "PLANNING HAPPENS" in rows["/m/a.mov"].document and rows["/m/a.mov"].argv[4].startswith("subtitles='/o/a.srt':force_style='FontName=Helvetica,FontSize=18") and rows["/m/b.mov"].error == "no captions for b"
    assert {r.error for r in jobs.burn_ins(spark, f"{media}/list.txt", f"{media}/srt", "/o", pre_filters="overlay=0:0").collect()} == {"before the captions: overlay"}


def test_verify(spark, media):
    deltas = spark.createDataFrame([("e", 2.7, 0.4)], "media string, cut_time double, delta double")
    envelopes = spark.createDataFrame([("e", 2.7, [0.1] * 500, 1.0)], "media string, cut_time double, bins array<double>, raw_peak double")
    samples = spark.createDataFrame([("e", k, 0.5 + k / 100) for k in range(5)], "media string, sample int, luminance double")
    findings, documents = jobs.verify(spark, f"{media}/edl", f"{media}/probes", deltas, envelopes, samples)
    got = [(r.check, r.passed, r.severity) for r in findings.where("media = 'e'").orderBy("finding").collect()]
    assert got == [("duration", True, "info"), ("cut_boundaries", True, "info"), ("visual_discontinuity", False, "fail"), ("audio_pop", True, "info"), ("grade_consistency", True, "info")]
    plain = {r.check: r.severity for r in findings.where("media = 'plain'").collect()}
    assert plain == {"duration": "warning", "cut_boundaries": "info", "grade_consistency": "warning"}
    better = findings.where("check = 'visual_discontinuity'").selectExpr("media", "finding", "check", "cut_time", "true AS passed", "'info' AS severity", "'delta=0.1' AS details")
    findings, documents = jobs.verify(spark, f"{media}/edl", f"{media}/probes", deltas, envelopes, samples, [better])
    text = documents.where("media = 'e'").first()
    assert "Verify Report: PASS" in text.text and "[retry 1] delta=0.1" in text.text and json.loads(text.json)["pass_count"] == 5


def test_main_writes_tables(spark, media, tmp_path):
    jobs.main(["rough-cuts", f"{media}/cut", f"{tmp_path}/out", "--probes", f"{media}/probes"])
    assert spark.read.json(f"{tmp_path}/out/segments").count() == 4


def test_edits_may_share_names_of_sources(spark, tmp_path):
    """Two lists call different files A: each gets its own words, end and sound."""
    for name in ("words", "edl", "probes"):
        (tmp_path / name).mkdir()
    for medium, word, end, kinds in (("x", "alpha", 9, ["video"]), ("y", "omega", 5, ["video", "audio"])):
        (tmp_path / "words" / f"{medium}.json").write_text(json.dumps({"words": [{"word": word, "start": 1.0, "end": 2.0}, {"word": "last", "start": end - 0.2, "end": end + 1.0}]}))
        (tmp_path / "edl" / f"of_{medium}.json").write_text(json.dumps({"version": 1, "sources": {"A": f"/m/{medium}.mov"}, "ranges": [{"source": "A", "start": 0, "end": end}]}))
        (tmp_path / "probes" / f"{medium}.json").write_text(json.dumps({"format": {"duration": str(end)}, "streams": [{"codec_type": k} for k in kinds]}))
    _, segments, captions = jobs.edit_plan(spark, f"{tmp_path}/edl", f"{tmp_path}/words", probed=f"{tmp_path}/probes")
    got = {r.edl.rsplit("/", 1)[1]: r for r in segments.collect()}
    assert (got["of_x.json"].cut_end, got["of_y.json"].cut_end) == (9000, 5000)
    assert "/m/x.mov" in got["of_x.json"].argv and "-an" in got["of_x.json"].argv and "/m/y.mov" in got["of_y.json"].argv and "-an" not in got["of_y.json"].argv
    said = {r.edl.rsplit("/", 1)[1]: r.document for r in captions.collect()}
    assert "ALPHA" in said["of_x.json"] and "OMEGA" not in said["of_x.json"] and "OMEGA" in said["of_y.json"] and "ALPHA" not in said["of_y.json"]


def test_timeline_views_have_sound_and_silences(spark, media, tmp_path):
    import struct

    import numpy as np

    x = np.concatenate([np.zeros(4000), np.full(4000, 16384)]).astype("<i2").tobytes()
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(x)) + x)
    views = {r.path: r for r in jobs.timeline_views(spark, f"{media}/list.txt", "/o", f"{media}/probes", f"{media}/words", sounds=str(tmp_path)).collect()}
    a = views["/m/a.mov"]
    assert len(a.envelope) == 1820 and a.envelope[0] == 0.0 and a.envelope[1500] == 1.0 and views["/m/b.mov"].envelope is None
    assert [tuple(s) for s in a.silences] == [(0, 1000), (2200, 3800)] and views["/m/b.mov"].silences is None
    assert a.sound_argv[:7] == ["ffmpeg", "-y", "-ss", "0.000", "-i", "/m/a.mov", "-t"] and a.sound_argv[7] == "4.000" and a.sound_argv[-1] == "a.wav"


def test_boundary_views(spark, media):
    (r,) = jobs.boundary_views(spark, f"{media}/edl/e.json", "/renders", "/pictures").collect()
    assert (r.media, round(r.start, 9), round(r.end, 9), r.path) == ("e", 1.2, 4.2, "/pictures/e/boundary_000_2.70s.png") and len(r.frame_argv) == 4 and "/renders/e.mp4" in r.frame_argv[0]
