"""Cases of the findings of round 3."""

import pyarrow as pa
from pyspark.sql import functions as F
from test_timeline import made, value

from cuegrid import catalog
from cuegrid.functions import text as X
from cuegrid.operators import folds, islands
from cuegrid.plans import cards, ffmpeg


def test_srt_times_of_a_hundred_hours_are_read_back(spark):
    for ms in (359_999_999, 360_000_000, 399_999_123, 3_600_000_000):
        written = value(spark, X.srt_time(F.col("ms")), ms=ms)
        assert value(spark, X.parse_srt_time(F.col("t")), t=written) == ms
    X.register(spark)
    assert spark.sql("SELECT cue_srt_time(360000000L) AS a").first()["a"] == "100:00:00,000"


def test_labels_on_a_pixels_edge(spark):
    # (t / z) * 1820 in doubles is just under the whole number for some of these.
    rows = [(z, k, k * z // 1820) for z in (1820 * 3, 1820 * 7, 1820 * 11) for k in range(1821)]
    x = ffmpeg.time_to_x(F.col("t"), F.lit(0).cast("long"), F.col("z"))
    assert all(r.x == 50 + r.k for r in made(spark, rows, "z long, k int, t long").withColumn("x", x).collect())


def test_words_are_dealt_into_parts_that_grow_with_the_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "TURNS", 8)
    turns = catalog.table(spark, sf_dir, "conversations").count()
    parts = catalog.words(spark, sf_dir).select(F.spark_partition_id().alias("p"), "media").distinct().collect()
    assert turns > 8 * 8 and len({r.p for r in parts}) > 8 and len({r.media for r in parts}) == len(parts)


def test_bold_captions_need_no_shuffle(spark):
    cues = made(spark, [(1, 0, 1000, "a b, c d e"), (2, 0, 1000, " ".join(f"w{k}" for k in range(1001)))], "media long, start_ms long, end_ms long, text string")
    captions = islands.bold_captions(cues, ("media",))
    assert "Exchange" not in captions._jdf.queryExecution().executedPlan().toString()
    got = captions.orderBy("media", "chunk").collect()
    assert [r.text for r in got if r.media == 1] == ["A B", "C D", "E"] and [r.text for r in got if r.media == 2][499:] == ["W998 W999", "W1000"]


def test_captions_take_a_batch_in_parts():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(folds.row_parts(iter([batch])))
    assert max(p.num_rows for p in parts) == folds.PYTHON_ROWS and [x for p in parts for x in p["x"].to_pylist()] == list(range(1000))


def test_lines_of_cards_are_broken_inside_a_row(spark):
    texts = made(spark, [(1, "aa  b c\n\nd", 10), (2, "", 10), (3, "aaaaaa é b", 1)], "card long, text string, size int")
    widths = made(spark, [("a", 1000), ("b", 500), (" ", 100)], "char string, width long")
    lines = cards.wrapped_lines(texts, widths, ("card",), 26)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in lines.orderBy("card", "line").collect()]
    assert got == [(1, 0, "aa b", 26000), (1, 1, "c", 5000), (1, 2, "", 0), (1, 3, "d", 5000), (2, 0, "", 0), (3, 0, "aaaaaa é b", 7200)]
