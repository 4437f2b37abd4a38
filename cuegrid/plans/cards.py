"""Where the lines of a card stand: paragraphs wrapped by the widths of their glyphs, and centred. Drawing stays out.

Widths are a table (char, width) in thousandths of the font's size; kerning is not in it. It holds a row for each
character at most, which bounds its broadcast. A text is wrapped inside its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.functions import text as X

# A card's size, the share of it that text may fill, font sizes and gaps.
WIDTH, HEIGHT, SHARE = 1920, 1080, 0.78
HEADER_SIZE, BODY_SIZE, PARAGRAPH_GAP, LINE_GAP = 60, 40, 28, 14


def line_breaks(widths: DataFrame, most: int, default: int) -> Callable:
    """A function of (words, whether each begins a line, font size) to a text's lines: (first word, width). ``widths``
    (char, width) holds a row for each character at most and goes to the tasks as one array by code point."""
    known = {r["char"]: r["u"] for r in widths.groupBy("char").agg(F.max(F.col("width").cast("long")).alias("u")).collect() if r["char"] and len(r["char"]) == 1 and r["u"] is not None}
    table = np.full(max(map(ord, known), default=0) + 2, default, np.int64)
    for c, u in known.items():
        table[ord(c)] = u
    shared, space = widths.sparkSession.sparkContext.broadcast(table), known.get(" ", default)

    @F.pandas_udf("array<struct<first: int, width: bigint>>")
    def breaks(words: pd.Series, begins: pd.Series, sizes: pd.Series) -> pd.Series:
        units, out = shared.value, []
        for text, begin, size in zip(words, begins, sizes, strict=True):
            if text is None:
                out.append(None)
                continue
            codes = np.frombuffer("".join(text).encode("utf-32-le"), "<u4")
            upto = np.concatenate([[0], np.cumsum(units[np.minimum(codes, len(units) - 1)])])
            wide = (np.diff(upto[np.cumsum([len(w) for w in text], dtype=np.int64)], prepend=0) * size).tolist()
            lines, used, gap = [], 0, space * size
            for k, (w, new) in enumerate(zip(wide, begin, strict=True)):
                if new or used + gap + w > most * 1000:
                    lines.append({"first": k, "width": w})
                    used = w
                else:
                    lines[-1]["width"] = used = used + gap + w
            out.append(lines)
        return pd.Series(out)

    return breaks


def wrapped_lines(texts: DataFrame, widths: DataFrame, keys: tuple[str, ...], most: int, text: str = "text", size: str = "size", default: int = 500) -> DataFrame:
    """(keys, line, text, width) of texts (keys, text, size): each of their lines broken between words so that none is
    wider than ``most`` pixels, but for a single word; lines are numbered from 0, a blank one is empty. ``width`` is
    in thousandths of a pixel. Characters without a width have ``default`` thousandths of the size."""
    lines = F.transform(F.split(text, "\n"), lambda t: F.when(F.size(X.tokens(t)) > 0, X.tokens(t)).otherwise(F.array(F.lit(""))))
    rows = texts.select(*keys, F.col(size).cast("long").alias("_size"), F.flatten(lines).alias("words"), F.flatten(F.transform(lines, lambda p: F.transform(p, lambda _, k: k == 0))).alias("begins"))
    breaks = line_breaks(widths, most, default)
    broken = rows.select(*keys, "words", breaks("words", "begins", "_size").alias("at"))
    each = broken.select("*", F.posexplode("at").alias("line", "here"))
    end = F.coalesce(F.get("at", F.col("line") + 1)["first"], F.size("words"))
    return each.select(*keys, "line", F.array_join(F.slice("words", F.col("here.first") + 1, end - F.col("here.first")), " ").alias("text"), F.col("here.width").alias("width"))


def card_layout(cards: DataFrame, widths: DataFrame, header_height: int, body_height: int, key: str = "card", text: str = "text") -> DataFrame:
    """(card, paragraph, line, text, x, y): every line of the cards' texts and its upper left corner in pixels. The
    first paragraph is the header. The heights are those of a line in either font."""
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(trimmed(F.col(text)), "\n\n"), trimmed), lambda p: p != "")
    rows = cards.select(key, F.posexplode(paragraphs).alias("paragraph", "text")).withColumn("size", F.when(F.col("paragraph") == 0, HEADER_SIZE).otherwise(BODY_SIZE))
    lines = wrapped_lines(rows, widths, (key, "paragraph"), int(WIDTH * SHARE))
    tall = F.when(F.col("paragraph") == 0, header_height).otherwise(body_height)
    card = W.partitionBy(key).orderBy("paragraph", "line")
    # What a line takes: its height, and the gap before it.
    gap = F.when(F.row_number().over(card) == 1, 0).when(F.col("line") == 0, PARAGRAPH_GAP).otherwise(LINE_GAP)
    sized = lines.withColumn("_tall", tall).withColumn("_gap", gap)
    below = F.sum(F.col("_tall") + F.col("_gap"))
    whole = below.over(W.partitionBy(key))
    return sized.select(key, "paragraph", "line", "text", ((WIDTH - F.col("width") / 1000) / 2).alias("x"), ((HEIGHT - whole) / 2 + below.over(card.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_tall")).alias("y"))
