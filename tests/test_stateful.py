"""Streams with state, scans of shares, loops and table functions against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cuegrid.operators import folds, islands
from cuegrid.streaming import speakers


def spoken(media, n, r):
    """Words with gaps around the silence, some without a speaker, text or with equal starts."""
    at, out = 1_700_000_000_000, []
    for pos in range(n):
        at += r.choice([0, 100, 300, 499, 500, 501, 900])
        out.append((media, pos, r.choice(["a", "b.", ",", " ", "", None]), r.choice(["x", "y", None]), at, at + r.choice([50, 200]), datetime.datetime.fromtimestamp(at / 1000, datetime.UTC)))
    return out


SCHEMA = "media long, pos long, word string, speaker string, start_ms long, end_ms long, ts timestamp"
COLUMNS = ["media", "phrase_id", "speaker", "start_ms", "end_ms", "n_words", "text"]


def batch(df):
    return [tuple(r) for r in islands.phrases(df.drop("ts"), order=("start_ms", "pos")).select(*COLUMNS).collect()]


def test_stream_packs_as_the_table_does(spark, tmp_path):
    """Files out of order within the watermark; the stream runs again where it stopped."""
    r = random.Random(3)
    words = [w for media in (1, 2, None) for w in spoken(media, 80, r)]
    by_time = sorted(words, key=lambda w: w[4])
    parts = [by_time[k : k + 40] for k in range(0, len(by_time), 40)]
    given = spark.createDataFrame(words, SCHEMA)
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    total_late = 0
    for k, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        q = speakers.start(speakers.speaker_phrases(stream, late="20 seconds"), out, state)
        q.awaitTermination()
        total_late += speakers.late_words(q)
        if k == 3:
            done = speakers.finished(spark, out)
            before = {tuple(x) for x in done.select(*COLUMNS).collect()}
    done = speakers.finished(spark, out)
    want = batch(given)
    assert total_late == 0 and before <= set(want) and 0 < done.count() < len(want)
    assert sorted((tuple(x) for x in speakers.with_open_phrases(given.drop("ts"), done).collect()), key=str) == sorted(want, key=str)


def test_late_words_are_counted_and_left_out(spark, tmp_path):
    at = lambda s: (1_700_000_000_000 + s * 1000, 1_700_000_000_100 + s * 1000, datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC))
    row = lambda pos, s: (1, pos, f"w{pos}", "x", *at(s))
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    late = 0
    for part in ([row(1, 0), row(2, 100)], [row(3, 5), row(4, 200)], [row(5, 300)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        q = speakers.start(speakers.speaker_phrases(spark.readStream.schema(SCHEMA).parquet(folder), late="10 seconds"), out, state)
        q.awaitTermination()
        late += speakers.late_words(q)
    got = sorted(tuple(r) for r in speakers.finished(spark, out).select("text", "n_words").collect())
    assert late == 1 and got == [("w1", 1), ("w2", 1), ("w4", 1)]


def plain_windows(cues):
    out, now = [], []
    for c in cues:
        now.append(c)
        if folds._closes(c[2] - now[0][1], len(now), c[3].rstrip("\"')]}”’").endswith(tuple(".!?。！？"))):
            out.append(now)
            now = []
    return [(k, w[0][1], w[-1][2], len(w), w[0][0], w[-1][0], " ".join(x[3] for x in w)) for k, w in enumerate([*out, *([now] if now else [])], 1)]


@pytest.mark.parametrize("share, group", [(1, 2), (3, 2), (7, 3), (256, 4096)])
def test_windows_by_scan_equal_a_loop(spark, share, group):
    r = random.Random(share)
    rows, want = [], set()
    for media in (1, 2, 3, None):
        at, order, cues = 0, r.randint(0, 5), []
        for _ in range(r.choice([1, 6, 40, 120])):
            at += r.randint(0, 3000)
            end = at + r.randint(100, 9000)
            cues.append((order, at, end, r.choice(["Yes.", 'So he said "no."', "and then", "wait"])))
            at, order = end, order + r.choice([1, 1, 2, 5])
        rows += [(media, *c) for c in cues]
        want |= {(media, *w) for w in plain_windows(cues)}
    df = spark.createDataFrame(rows, "media long, cue int, start_ms long, end_ms long, text string").repartition(3)
    got = folds.translation_windows(df, share=share, group=group)
    assert {tuple(x) for x in got.select("media", "window_id", "start_ms", "end_ms", "n_cues", "cue_first", "cue_last", "source_text").collect()} == want


def test_scan_adds_up_over_groups(spark):
    """A map that counts modulo three and adds the state it meets."""
    shares = spark.range(50).select(F.lit("k").alias("key"), F.col("id").alias("share"), F.expr("transform(sequence(0, 2), s -> named_struct('to', cast((s + 1) % 3 as int), 'n', cast(s as bigint)))").alias("map"))
    got = sorted((r.share, r.to, r.n) for r in folds.scan(shares, "key", 3, group=4).collect())
    assert got == [(k, k % 3, sum(j % 3 for j in range(k))) for k in range(50)]


def test_batches_skip_what_is_done(spark, tmp_path):
    import os

    from cuegrid.streaming import ingest

    def heard(path):
        """A recogniser that leaves a line for each call beside the medium."""
        with open(path + ".calls", "a") as f:
            f.write("x")
        if "bad" in path:
            raise RuntimeError("no speech")
        text = open(path).read()
        return {"segments": [{"start": 0, "end": 2, "text": text, "words": []}], "language": "en"}

    media, lists, out = (tmp_path / x for x in ("media", "lists", "out"))
    media.mkdir(), lists.mkdir(), (tmp_path / "other").mkdir()
    for name in ("a", "b", "bad"):
        (media / f"{name}.mp3").write_text(f"text of {name}")
    (tmp_path / "other" / "a.wav").write_text("same stem")

    def run(name, *lines, **options):
        (lists / name).write_text("\n".join(lines))
        ingest.transcribe(spark, str(lists), str(out), heard, "mine", **options).awaitTermination()
        last = ingest.ledger(spark, str(out)).selectExpr("max(batch) AS b").first().b
        return {os.path.basename(r.path): (r.decision, r.error) for r in ingest.ledger(spark, str(out)).where(f"batch = {last}").collect()}

    all_media = [f"# list\n{media}/a.mp3", f"{media}/b.mp3", f"{media}/bad.mp3", f"{media}/none.mp3", f"{tmp_path}/other/a.wav"]
    first = run("1.txt", *all_media)
    assert first["a.mp3"] == first["b.mp3"] == ("process", None) and first["bad.mp3"] == ("process", "RuntimeError: no speech")
    assert first["none.mp3"][1].startswith("FileNotFoundError") and first["a.wav"] == ("fail", "another input has the same stem")
    assert sorted(os.listdir(out / "files")) == ["a.json", "a.srt", "a.txt", "b.json", "b.srt", "b.txt"] and "text of a" in (out / "files" / "a.srt").read_text()
    assert [(r.n_ok, r.n_failed, r.exit_code) for r in ingest.result(spark, str(out)).collect()] == [(2, 3, 1)]
    (media / "b.mp3").write_text("new text")
    second = run("2.txt", *all_media)
    assert second["a.mp3"] == ("skip", None) and second["b.mp3"] == ("overwrite", None) and second["bad.mp3"][0] == "process"
    calls = lambda n: len((media / f"{n}.mp3.calls").read_text())
    assert (calls("a"), calls("b"), calls("bad")) == (1, 2, 2) and "new text" in (out / "files" / "b.txt").read_text()
    # A batch that is run again, as after a crash, makes its files from the ledger.
    os.remove(out / "files" / "b.srt")
    lines = spark.createDataFrame([("/l", k, x) for k, x in enumerate("\n".join(all_media).split("\n"))], "manifest string, line_no int, line string")
    ingest.one_batch(lines, 1, str(out), heard, "mine")
    assert calls("b") == 2 and os.path.exists(out / "files" / "b.srt")
    os.remove(out / "files" / "a.srt")
    assert run("3.txt", f"{media}/a.mp3")["a.mp3"] == ("fail", "its outputs exist")
    assert run("4.txt", f"{media}/a.mp3", overwrite=True)["a.mp3"] == ("overwrite", None) and calls("a") == 2


def test_passes_end_as_they_should(spark):
    from cuegrid.operators import signal

    rows = [("m", k, "visual" if k % 2 else "duration", k / 10 if k % 2 else None, False, "fail" if k != 7 else "warning", f"d{k}") for k in range(8)]
    df = spark.createDataFrame(rows, "media string, finding int, check string, cut_time double, passed boolean, severity string, details string")
    asked = []

    def measure(at):
        def run(failing, k):
            asked.append(sorted(r.finding for r in failing.collect()))
            better = F.col("finding") % 4 < F.lit(at(k))
            return failing.withColumns({"passed": better, "severity": F.when(better, "info").otherwise("fail"), "details": F.lit("m")})

        return run

    keep = lambda df, _: df.sparkSession.createDataFrame(df.collect(), df.schema)
    for at, most, ending, passes in ((lambda k: 2 * k, 9, "passed", 2), (lambda k: k, 2, "limit", 2), (lambda k: 1, 9, "settled", 2)):
        asked.clear()
        made, got, n = signal.verified(df, measure(at), keep, most)
        assert (got, n) == (ending, passes) and asked[0] == [0, 1, 2, 3, 4, 5, 6] and set(asked[-1]) < set(asked[0])
        rest = {r.finding: r.details for r in made.collect() if not r.passed}
        assert rest.pop(7) == "d7" and all(d.endswith("[unresolved after max passes]") and d.count("unresolved") == 1 for d in rest.values())
        assert (not rest) == (ending == "passed")


def test_table_functions_from_sql(spark):
    from cuegrid.functions import tables

    tables.register(spark)
    words = spark.createDataFrame([(m, k, w, s, a, a + 100) for m in (1, None) for k, (w, s, a) in enumerate([("Hi", None, 0), (",", "x", 150), ("you", "y", 300), (" ", None, 1000), ("end", None, 1499)])], "media long, pos int, word string, speaker string, start_ms long, end_ms long")
    got = spark.sql("SELECT * FROM cue_phrases(TABLE({w}), silence_ms => 500)", w=words)
    want = islands.phrases(words, 500).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 6
    segments = spark.createDataFrame([(7, "a", 0, 3000, "no words here", None, None)], "id int, name string, start_ms long, end_ms long, text string, speaker string, words array<struct<word: string, start_ms: long, end_ms: long>>")
    assert [tuple(r) for r in spark.sql("SELECT * FROM cue_captions(TABLE({s}))", s=segments).collect()] == [(7, "a", 1, 0, 3000, "no words here", 3, None)]
    with pytest.raises(Exception, match="no column pos"):
        spark.sql("SELECT * FROM cue_phrases(TABLE({w}))", w=words.drop("pos")).collect()


def test_cards_wrap_as_a_loop_does(spark):
    from cuegrid.plans import cards

    r = random.Random(6)
    widths = {c: r.randint(100, 900) for c in "abcdefg "}
    texts = ["", "  \n\n ", "one", "a" * 90 + " b", "x y\n \nz"] + ["\n\n".join(" ".join("".join(r.choice("abcdefgq") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 3))) for _ in range(20)]
    got = {}
    frame = spark.createDataFrame(list(enumerate(texts)), "card int, text string")
    for x in cards.card_layout(frame, spark.createDataFrame(list(widths.items()), "char string, width int"), 55, 37).collect():
        got.setdefault(x.card, []).append((x.paragraph, x.line, x.text, round(x.x, 3), round(x.y, 3)))

    def plain(text):
        paragraphs = [p.strip() for p in text.strip().split("\n\n") if p.strip()]
        wide = lambda t, size: sum(widths.get(c, 500) for c in t) * size / 1000
        blocks = []
        for k, p in enumerate(paragraphs):
            size, lines = (60 if k == 0 else 40), []
            for part in p.split("\n"):
                words = part.split()
                now = words[0] if words else ""
                for w in words[1:]:
                    if wide(f"{now} {w}", size) <= 1497:
                        now += f" {w}"
                    else:
                        lines.append(now)
                        now = w
                lines.append(now)
            blocks.append((lines, size, 55 if k == 0 else 37))
        y = (1080 - sum(len(b) * h + (len(b) - 1) * 14 for b, _, h in blocks) - 28 * (len(blocks) - 1)) / 2
        out = []
        for k, (lines, size, h) in enumerate(blocks):
            for n, line in enumerate(lines):
                out.append((k, n, line, round((1920 - wide(line, size)) / 2, 3), round(y, 3)))
                y += h + 14
            y += 28 - 14
        return out

    assert {k: sorted(v) for k, v in got.items()} == {k: plain(t) for k, t in enumerate(texts) if plain(t)}
