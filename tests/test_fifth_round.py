"""Cases of the findings of round 4."""

from pyspark.sql import functions as F
from test_timeline import made

from cuegrid.streaming import ingest


def recogniser():
    def heard(path):
        text = open(path).read()
        return {"segments": [{"start": 0, "end": 2, "text": text, "words": []}] if text else [], "language": "en"}

    return heard


def test_outputs_are_looked_up_and_not_listed(spark, tmp_path):
    files = tmp_path / "out" / "files"
    files.mkdir(parents=True)
    for name in ("a.txt", "a.srt", "a.json", "b.srt", "_c.txt", "d e.json", "other.txt"):
        (files / name).write_text("" if name == "a.srt" else "x")
    (files / "b.txt").mkdir()
    media = made(spark, [("a",), ("b",), ("_c",), ("d e",), ("none",)], "media string")
    got = sorted(tuple(r) for r in ingest.existing_outputs(media, f"file://{files}").collect())
    assert got == [("_c", ".txt"), ("a", ".json"), ("a", ".srt"), ("a", ".txt"), ("b", ".srt"), ("d e", ".json")]
    assert ingest.existing_outputs(media, str(tmp_path / "nothing")).count() == 0
    lines = made(spark, [("/l", 0, "/m/a.mp3")], "manifest string, line_no int, line string")
    for skip in (True, False):
        decided = ingest._decided_and_recognised(lines, 0, str(tmp_path / "out"), recogniser(), "mine", skip, False)
        plan = decided._jdf.queryExecution().executedPlan().toString()
        # The driver lists what a scan of files reads: none of them may grow with the outputs.
        assert "binaryFile" not in plan and decided.select(F.col("media")).count() == 1


def test_empty_and_hidden_outputs_are_there(spark, tmp_path):
    """Spark's file listings leave out files without a byte, and names that begin with _ or a dot."""
    media, lists, out = (tmp_path / x for x in ("media", "lists", "out"))
    media.mkdir(), lists.mkdir()
    for name, text in (("quiet", ""), ("_hidden", "words"), ("a", "words")):
        (media / f"{name}.mp3").write_text(text)
    for k in range(2):
        (lists / f"{k}.lst").write_text("".join(f"{media}/{name}.mp3\n" for name in ("quiet", "_hidden", "a")))
        ingest.transcribe(spark, str(lists), str(out), recogniser(), "mine").awaitTermination()
    got = {(r.batch, r.media): (r.decision, r.error) for r in ingest.ledger(spark, str(out)).collect()}
    assert got == {(k, name): (("process", "skip")[k], None) for k in range(2) for name in ("quiet", "_hidden", "a")}
    assert (out / "files" / "quiet.txt").read_text() == ""


def test_documents_are_not_broadcast(spark, tmp_path):
    """Small tables of the kind that is broadcast if nothing is said: at size, documents are guessed to be small as well."""
    said = [("a", '{"segments": [{"start": 0, "end": 2, "text": "hi there", "words": []}]}'), ("quiet", '{"segments": []}')]
    at = str(tmp_path / "out" / "ledger" / "batch=0")
    ledger = [(0, m, f"/m/{m}.mp3", "mine", "h", "process", t, None) for m, t in said]
    spark.createDataFrame(ledger, ingest.LEDGER).write.parquet(at)
    transcripts = spark.read.schema(ingest.LEDGER).parquet(at).select("media", "transcript")
    made_of = ingest.documents(transcripts)
    got = {r.name: r.document for r in made_of.collect()}
    assert got == {"a.json": said[0][1], "a.srt": "1\n00:00:00,000 --> 00:00:02,000\nhi there\n", "a.txt": "[00:00:00.000 --> 00:00:02.000] hi there\n", "quiet.json": said[1][1], "quiet.srt": "", "quiet.txt": ""}
    spark.createDataFrame([("/l", 0, "/m/a.mp3")], "manifest string, line_no int, line string").write.parquet(str(tmp_path / "lines"))
    decided = ingest._decided_and_recognised(spark.read.parquet(str(tmp_path / "lines")), 1, str(tmp_path / "out"), recogniser(), "mine", True, False)
    for df in (made_of, decided):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
