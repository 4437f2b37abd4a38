"""Jobs over many small files read and parse each of them once."""

import json

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from cuegrid import jobs
from cuegrid.sources import named_files, readers


class Counted:
    """A local file system that counts calls."""

    def __init__(self):
        self.fs, self.calls = arrow_fs.LocalFileSystem(), []

    def __getattr__(self, name):
        return lambda *args, **kw: self.calls.append(name) or getattr(self.fs, name)(*args, **kw)


@pytest.mark.parametrize("exists", ["fail", "replace", "skip"])
def test_a_commit_looks_up_many_names_at_once(tmp_path, monkeypatch, exists):
    out = tmp_path / "out"
    writer = named_files.NamedFilesWriter(str(out), exists)
    staging = tmp_path / "out" / writer.staging.rsplit("/", 1)[1]
    staging.mkdir(parents=True)
    names = [f"{k % 3}/{k}.txt" for k in range(3000)]
    for k, _ in enumerate(names):
        (staging / f"0-{k}").write_text(str(k))
    (staging / "0.list").write_text("".join(json.dumps([f"{staging}/0-{k}", name]) + "\n" for k, name in enumerate(names)))
    if exists != "fail":
        (out / "0").mkdir()
        (out / "0" / "0.txt").write_text("old")
    fs = Counted()
    monkeypatch.setattr(writer, "_fs", lambda path: (fs, path))
    writer.commit([named_files.Written(f"{staging}/0.list")])
    assert fs.calls.count("create_dir") == 3 and fs.calls.count("get_file_info") < 10
    assert sum(1 for _ in out.rglob("*.txt")) == 3000 and not staging.exists() and (out / "2" / "2999.txt").read_text() == "2999"
    assert (out / "0" / "0.txt").read_text() == ("old" if exists == "skip" else "0")


def test_a_commit_refuses_names_that_are_taken(tmp_path):
    writer = named_files.NamedFilesWriter(str(tmp_path), "fail")
    (tmp_path / "b.txt").write_text("old")
    staged = [tmp_path / "1", tmp_path / "2"]
    for s in staged:
        s.write_text("new")
    (tmp_path / "list").write_text("".join(json.dumps([str(s), n]) + "\n" for s, n in zip(staged, ("a.txt", "b.txt"), strict=True)))
    with pytest.raises(FileExistsError):
        writer.commit([named_files.Written(str(tmp_path / "list"))])
    assert (tmp_path / "b.txt").read_text() == "old" and not (tmp_path / "a.txt").exists()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_times_of_cues_are_parsed_before_blocks_become_rows(spark):
    cues = readers.parse_srt(spark.createDataFrame([("m", "1\n00:00:01,000 --> 00:00:02,000\nhi\n")], "media string, value string")).where("error IS NULL")
    assert plan(cues).count("split(") == 3 and [(r.start_ms, r.end_ms, r.text) for r in cues.collect()] == [(1000, 2000, "hi")]


def test_a_transcript_is_parsed_once(spark):
    word = {"word": "a", "start": "0.5", "end": 1, "type": 3}
    made = spark.createDataFrame([("m", json.dumps({"words": [word, "bare", None, {"start": [1], "end": 2}]}))], "media string, value string")
    read = readers.parse_transcripts(made)
    assert plan(read).count("parseJson") == 1
    (r,) = read.collect()
    assert [tuple(w) for w in r.words] == [("a", None, 0.5, 1.0, None, None, "3"), (None,) * 7, (None,) * 7, (None, None, None, 2.0, None, None, None)]


def test_an_edit_plan_reads_every_file_once(spark, tmp_path):
    for name, body in (("edl", {"version": 1, "sources": {"A": "/m/x.mov"}, "ranges": [{"source": "A", "start": 0.9, "end": 2}]}), ("words", {"words": [{"word": "alpha", "start": 1.0, "end": 2.0}]}), ("probes", {"format": {"duration": "9"}, "streams": []})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps(body))
    kept = []
    keep = jobs._kept(spark, f"file://{tmp_path}/kept")
    made = jobs.edit_plan(spark, f"{tmp_path}/edl", f"{tmp_path}/words", probed=f"{tmp_path}/probes", keep=lambda df, name: kept.append(name) or keep(df, name))
    plain = jobs.edit_plan(spark, f"{tmp_path}/edl", f"{tmp_path}/words", probed=f"{tmp_path}/probes")
    for got, want in zip(made, plain, strict=True):
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in text and "FileScan text" not in text
        assert got.select(F.to_json(F.struct("*"))).collect() == want.select(F.to_json(F.struct("*"))).collect()
    assert len(kept) == len(set(kept)) and "ALPHA" in made[2].first().document
