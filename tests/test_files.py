"""Sources and sinks over files: named files in two phases, WAV pieces, transcripts of any layout, rejects."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid import jobs
from cuegrid.operators import signal
from cuegrid.sources import named_files, sinks, wav


def files_of(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def test_a_file_for_each_name_in_order(spark, tmp_path):
    rows = [(f"d{k % 7}/n{k % 7}.txt", k, f"{k} ") for k in range(700)]
    assert named_files.open_fs("file:/a/b")[1] == named_files.open_fs("file:///a/b")[1] == named_files.open_fs("/a/b")[1] == "/a/b"
    df = spark.createDataFrame(rows, "name string, k long, document string").repartition(5, "k")
    named_files.write_files(df, f"{tmp_path}/out", part="k")
    assert files_of(tmp_path / "out") == {f"d{m}/n{m}.txt": "".join(f"{k} " for k in range(700) if k % 7 == m).encode() for m in range(7)}


def test_the_guard_refuses_replaces_or_skips(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "media string, document string")
    out = f"{tmp_path}/out"
    sinks.write_documents(docs(("/m/a.mov", "one"), ("/m/b.mov", None)), out)
    assert files_of(out) == {"a.txt": b"one", "b.txt": b""}
    with pytest.raises(Exception, match="a.txt"):
        sinks.write_documents(docs(("/m/a.mov", "two"), ("/m/c.mov", "new")), out)
    assert files_of(out) == {"a.txt": b"one", "b.txt": b""}, "nothing of a refused write is left"
    sinks.write_documents(docs(("/m/a.mov", "two"), ("/m/c.mov", "new")), out, exists="skip")
    assert files_of(out) == {"a.txt": b"one", "b.txt": b"", "c.txt": b"new"}
    sinks.write_documents(docs(("/m/a.mov", "two")), out, exists="replace")
    assert files_of(out) == {"a.txt": b"two", "b.txt": b"", "c.txt": b"new"}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("f"), F.col("id") % 20, F.lit(".txt")).alias("name"), F.when(F.col("id") == 1999, F.raise_error(F.lit("lost")).cast("string")).otherwise("x" * 100).alias("document"))
    with pytest.raises(Exception, match="lost"):
        named_files.write_files(rows, f"{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out") or files_of(tmp_path / "out") == {}
    for name in ("../x", "/x", ""):
        with pytest.raises(Exception, match="name inside"):
            named_files.write_files(spark.createDataFrame([(name, "x")], "name string, document string"), f"{tmp_path}/out")


def test_jobs_write_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"words": [{"word": "Hi.", "start": 0.0, "end": 0.5}]}))
    jobs.main(["pack", f"{tmp_path}/a.json", f"{tmp_path}/tables", "--files", f"{tmp_path}/files"])
    assert list(files_of(tmp_path / "files")) == ["a.md"] and b"Hi." in files_of(tmp_path / "files")["a.md"]


def wav_bytes(x, extra=b"", bits=16, channels=1, length=None):
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, 16000, 32000 * channels, 2 * channels, bits)
    data = x.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt + extra + struct.pack("<4sI", b"data", len(data) if length is None else length) + data


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_pieces_make_up_the_samples(spark, tmp_path, piece):
    r = np.random.default_rng(1)
    clips = {name: r.integers(-32768, 32768, n) for name, n in (("a", 300), ("b", 1), ("c", 0), ("d", 41))}
    for k, (name, x) in enumerate(clips.items()):
        (tmp_path / f"{name}.wav").write_bytes(wav_bytes(x, b"LIST\x03\x00\x00\x00abc\x00" if k % 2 else b"", length=0xFFFFFFFF if name == "d" else None))
    (tmp_path / "note.txt").write_text("no sound")
    got = {}
    for p in sorted(wav.read_wav(spark, str(tmp_path), piece).collect(), key=lambda p: p.first):
        name = os.path.basename(p.path)[0]
        assert p.error is None and p.rate == 16000 and p.n_samples == len(clips[name]) and p.first == len(got.get(name, []))
        got[name] = np.concatenate([got.get(name, np.zeros(0, int)), np.frombuffer(p.pcm, "<i2")])
    assert got.keys() == clips.keys() and all((got[k] == clips[k]).all() for k in clips)


def test_broken_sounds_are_rows(spark, tmp_path):
    whole = wav_bytes(np.arange(10))
    for name, b in (("empty", b""), ("text", b"hello, this is no sound at all"), ("cut", whole[:30]), ("wide", wav_bytes(np.arange(10), channels=2)), ("ok", whole)):
        (tmp_path / f"{name}.wav").write_bytes(b)
    got = {os.path.basename(r.path)[:-4]: r.error for r in wav.read_wav(spark, str(tmp_path)).collect()}
    assert got["ok"] is None and got["empty"] == got["text"] == "not a WAV file" and got["wide"].startswith("not 16-bit mono") and got["cut"]


@pytest.mark.parametrize("n, bins", [(1000, 16), (999, 40), (10, 16), (16, 16), (1, 4)])
def test_rms_of_pieces_equals_one_array(spark, tmp_path, n, bins):
    x = np.random.default_rng(n).integers(-3000, 3000, n)
    (tmp_path / "a.wav").write_bytes(wav_bytes(x))
    got = [(r.bin, r.rms) for r in wav.windowed_rms(wav.read_wav(spark, str(tmp_path), 100), bins).orderBy("bin").collect()]
    one = spark.createDataFrame([([float(v) / 32768 for v in x],)], "s array<double>").select(signal.windowed_rms(F.col("s"), bins).alias("r")).first().r
    assert [k for k, _ in got] == list(range(bins)) and np.allclose([v for _, v in got], one, atol=1e-12)


def test_written_sounds_are_read_again(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(f"{name}.wav", k, r.integers(-32768, 32768, 10).tolist()) for name in "xy" for k in (5, -1, 9)]
    df = spark.createDataFrame(rows, "name string, k int, v array<int>")
    named_files.write_files(wav.wav_parts(df, "name", "k", "v"), f"{tmp_path}/w", content="content", part="part")
    for name in "xy":
        got = np.concatenate([np.frombuffer(p.pcm, "<i2") for p in wav.read_wav(spark, f"{tmp_path}/w/{name}.wav", 13).orderBy("first").collect()])
        assert got.tolist() == [v for n, k, x in sorted(rows, key=lambda t: t[1]) if n == f"{name}.wav" for v in x]


BROKEN = {"cut.json": '{"words": [{"word": "a", "sta', "empty.json": " \n", "list.json": "[1, 2]", "number.json": "7", "odd.json": '{"segments": [[0, 1000, "ok"], "no"]}', "short.json": '{"segments": [[0, 1000]]}'}


def test_transcripts_that_do_not_parse_are_rejects(spark, tmp_path):
    for name, text in (BROKEN | {"good.json": json.dumps({"segments": [[500, "1500", " Hello "], {"start": "2", "end": 3.5, "text": 7, "words": None}], "language_code": "fr"})}).items():
        (tmp_path / name).write_text(text)
    (t,) = jobs.transcripts(spark, str(tmp_path)).collect()
    assert t.media.endswith("good.json") and t.language == "fr" and [tuple(s)[:3] for s in t.segments] == [(0.5, 1.5, " Hello "), (2.0, 3.5, "7")]
    from cuegrid.sources import readers

    got = {os.path.basename(r.media): r.error for r in readers.rejects(spark, str(tmp_path)).collect()}
    assert got == {"cut.json": "not JSON", "empty.json": "empty", "list.json": "not an object", "number.json": "not an object", "odd.json": "segment 1 is neither an object nor a list of three", "short.json": "segment 0 is neither an object nor a list of three"}
    packed = {os.path.basename(r.media) for r in jobs.pack(spark, str(tmp_path)).collect()}
    assert packed == {"good.json"}, "a broken file is not a silent one"


@pytest.mark.parametrize("job", ["edit-plan", "rough-cuts", "translated-subtitles"])
def test_jobs_name_files_they_cannot_read(spark, tmp_path, job):
    whole = {"edit-plan": {"version": 1, "sources": {"a": "/m/a.mov"}, "ranges": [{"source": "a", "start": 0, "end": 1}]}, "rough-cuts": {"generated_clips_dir": "/g", "text_dir": "/t", "manifest_path": "/l", "assembly_path": "/o", "segments": [{"name": "x", "type": "image", "input": "/i.png", "duration": "2"}]}, "translated-subtitles": {"windows": [{"id": 1, "start": 0, "end": 2, "source_text": "x", "translated_text": "y"}]}}[job]
    (tmp_path / "in").mkdir()
    (tmp_path / "words").mkdir()
    (tmp_path / "in" / "whole.json").write_text(json.dumps(whole))
    (tmp_path / "in" / "cut.json").write_text(json.dumps(whole)[:-5])
    (tmp_path / "words" / "a.json").write_text(json.dumps({"words": [{"word": "a", "start": 0, "end": 0.5}]}))
    jobs.main([job, f"{tmp_path}/in", f"{tmp_path}/out", "--words", f"{tmp_path}/words"])
    assert [(os.path.basename(r.media), r.error) for r in spark.read.json(f"{tmp_path}/out_rejects").collect()] == [("cut.json", "not JSON")]


def test_audio_events_of_both_places(spark):
    from cuegrid.sources import readers

    text = json.dumps({"words": [{"text": "hi", "start": 0, "end": 1, "type": "word"}, {"text": "(bang)", "start": 2, "type": "audio_event"}, {"text": "(lost)", "type": "audio_event"}], "audio_events": [{"text": "(rain)", "start": "0.5", "end": "4"}]})
    t = readers.parse_transcripts(spark.createDataFrame([("m", text)], "media string, value string"))
    assert [tuple(r) for r in readers.audio_events(t).orderBy("event").collect()] == [("m", 0, "(rain)", 500, 4000, "audio_event"), ("m", 1, "(bang)", 2000, 2000, "audio_event")]
