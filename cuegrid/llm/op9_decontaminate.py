"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are compared lower-cased, with runs of white space as one space and none at the
ends. An item of m characters may differ from a passage of a document by k = floor(ERROR_RATE * m) edits. It is
cut into k + 1 pieces: at least one of them stands unchanged in any such passage. All pieces of all items are
found in one pass over a text (Aho-Corasick); hits of one item near the same diagonal form a region, and Myers'
bit-parallel distance decides whether the item ends in that region with k edits at most.

Items of fewer than SHORT characters, to which the rate gives no edit, must stand at word boundaries, as they would be
found by chance inside words.

Different items are read in blocks of MAX_ITEM_CHARS characters at most, by a hash, so that what the driver and the
executors hold is bounded; a larger benchmark takes more passes over the documents, and a block is released after
its pass. However often an item is repeated, it is searched once; its ids are joined to what was found.

Defined cases: null or empty items and texts match nothing; very long texts are read whole; an empty table of either
kind gives no rows; equal items are reported under each of their ids;
repeated documents are reported each; null doc_id and item_id are passed on; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm.common import materialise, prepare

ERROR_RATE = 0.08
#: The fewest characters that the rate gives an edit.
SHORT = 13
MAX_ITEM_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Pattern:
    """An item's bit masks for Myers' distance."""

    def __init__(self, text: str, budget: int):
        self.m, self.budget = len(text), budget
        self.eq: dict[str, int] = {}
        for k, c in enumerate(text):
            self.eq[c] = self.eq.get(c, 0) | 1 << k

    def best(self, region: str) -> tuple[int, int] | None:
        """(distance, end) of the best occurrence inside the region, the first of equals; None beyond the budget."""
        eq, get = self.eq, self.eq.get
        top, full = 1 << (self.m - 1), (1 << self.m) - 1
        up, down, score = full, 0, self.m
        limit, found = self.budget, None
        left = len(region)
        for j, c in enumerate(region):
            if score - (left - j) > limit:
                break
            e = get(c, 0)
            xv = e | down
            xh = (((e & up) + up) ^ up) | e
            plus = down | (full & ~(xh | up))
            minus = up & xh
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = plus << 1 & full
            minus = minus << 1 & full
            up = minus | (full & ~(xv | plus))
            down = plus & xv
            if score <= limit:
                found, limit = (score, j + 1), score - 1
                if not score:
                    break
        return found if eq else None


class Matcher:
    """All items of a block: pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, short: int = SHORT):
        import ahocorasick

        texts: dict[str, list] = {}
        for item_id, text in items:
            if t := normal(text):
                texts.setdefault(t, []).append(item_id)
        self.items = list(texts.items())
        self.short = short
        self.patterns = [Pattern(t, int(rate * len(t)) if len(t) >= short else 0) for t, _ in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (p, (t, _)) in enumerate(zip(self.patterns, self.items, strict=True)):
            cuts = [p.m * j // (p.budget + 1) for j in range(p.budget + 2)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[a:z], []).append((k, z - 1))
        self.found = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.found.add_word(piece, at)
        if pieces:
            self.found.make_automaton()
        self.any = bool(pieces)

    def matches(self, text: str) -> list[tuple[object, int, int]]:
        """(item_id, distance, end in the normalised text) of the best occurrence of each item in the text."""
        if not self.any:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, at in self.found.iter(text):
            for k, last in at:
                starts.setdefault(k, set()).add(end - last)
        out = []
        for k, diagonals in sorted(starts.items()):
            p, best = self.patterns[k], None
            near = sorted(diagonals)
            if p.m < self.short:
                whole = [x for x in near if text[x - 1 : x] in ("", " ") and text[x + p.m : x + p.m + 1] in ("", " ")]
                out += [(i, 0, whole[0] + p.m) for i in self.items[k][1]] if whole else []
                continue
            a = 0
            while a < len(near):
                z = a
                while z + 1 < len(near) and near[z + 1] - near[z] <= p.budget:
                    z += 1
                low, high = max(0, near[a] - p.budget), near[z] + p.m + p.budget
                hit = p.best(text[low:high])
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], low + hit[1]
                a = z + 1
            if best:
                out += [(i, *best) for i in self.items[k][1]]
        return out


SCHEMA = "doc_id long, item long, distance int, match_end long, item_chars int"


def item_blocks(benchmark: DataFrame, most: int = MAX_ITEM_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(hash, text) of the different items, in blocks of about ``most`` characters, one at a time on the driver."""
    rows = benchmark.where(F.length("text") > 0).select("text").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // most)
    for k in range(blocks):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select(F.xxhash64("text"), "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, match_end, item_chars): a row for each document and item that it holds."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.length("text") > 0)
    out = spark.createDataFrame([], SCHEMA)
    for items in item_blocks(benchmark):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            sizes = {i: p.m for p, (_, ids) in zip(matcher.patterns, matcher.items, strict=True) for i in ids}
            for batch in batches:
                rows = [(d, i, e, at, sizes[i]) for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, e, at in matcher.matches(text.as_py())]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        out = out.unionAll(materialise(texts.mapInArrow(run, SCHEMA), "leaks"))
        shipped.destroy()
    ids = benchmark.where(F.length("text") > 0).select(F.xxhash64("text").alias("item"), F.col("item_id").cast("long"))
    return out.join(ids, "item").select("doc_id", "item_id", "distance", "match_end", "item_chars")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item. Each row is judged by its text where it is read."""
    spark = docs.sparkSession
    prepare(spark)
    at, before = docs.columns.index("text"), None
    for items in item_blocks(benchmark):
        if before is not None:
            docs = materialise(docs, "clean")
            before.destroy()
        shipped = before = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not (t and matcher.matches(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that some document holds, over all ``documents`` and ``benchmark``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
