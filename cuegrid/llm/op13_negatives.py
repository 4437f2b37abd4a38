"""Hard negatives by a distributed kNN join over Voronoi cells.

Rows (vec_id, embedding, label) become whole-number vectors; the score of two is their inner product. An anchor's
positives are its best rows of the same label, and for each of them its negatives are the best rows of other labels
whose score lies between half and 95 % of the positive's.

Method: with M the greatest norm, a row x gets one more component sqrt(M^2 - |x|^2) and an anchor gets 0 there, so that
the distance of an anchor q and a row is d^2 = |q|^2 + M^2 - 2 * score: the best scores are the nearest rows. Some rows
serve as pivots; each row knows its distance to all of them, each anchor belongs to the cell of its nearest pivot.
What score an anchor still needs gives the greatest distance r at which a row can serve it; by the triangle inequality
its distance to pivot p then lies in [d(q, p) - r, d(q, p) + r]. For every cell of anchors and every pivot the bounds of
all its anchors are put together, and a row is copied only to those cells all of whose bounds it meets. There anchors
and rows meet in blocks, and exact scores decide; a block's best are merged with those of others.

What is needed at least: of the rows of an anchor's label in its own cell, the PROBE nearest to the pivot are scored
first; the worst of the KEEP best is a bound that no result is under (rows that are probed only give the bound; the join
looks at all). Anchors with fewer such rows form a cell of their own, to which every row is copied. For negatives the
least allowed score is the bound.

How it scales: equal vectors of one label are one class with the smallest KEEP ids (more of them can never be among an
anchor's best), so copies cost nothing, and anchors of one class are searched once. A cell's anchors are dealt into
blocks of BLOCK_ANCHORS and the rows sent there into blocks as well, so that a task holds a bounded matrix whatever the
cell holds. The driver gets the pivots and the bounds of cells: MOST_PIVOTS squared numbers at most. In vectors
without any structure the bounds exclude little and rows are copied to most cells; there is one for ANCHORS_A_CELL
anchors, so the join then is the exact comparison of all anchors with all rows in blocks.

Defined cases: rows with a null vec_id, label or vector or with a null or non-finite component take no part; rows
that share vec_id, label and vector count once; vectors of different lengths are filled up with zeros; ties go by
vec_id; components of 2^31 and more, or scores that a 64-bit integer can't hold, raise an error; an empty table, and
anchors without positives or negatives, give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.llm.common import materialise, prepare

SCALE = 256
ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: An anchor may be among its own best rows, so one more is kept than it has positives.
KEEP = POSITIVES + 1
MOST_PIVOTS, ANCHORS_A_CELL, BLOCK_ANCHORS, BLOCK_ROWS, PROBE = 1024, 512, 512, 4096, 64
#: The cell of anchors without a bound.
WIDE = -1
#: Added to bounds of distances, as a part of the greatest norm: distances are floating point.
SLACK = 1e-6


def usable(rows: DataFrame, noisy_every: int | None = None, labels: int = 10) -> DataFrame:
    """(vec_id, label, x): rows that take part, with whole-number components. ``noisy_every``: where it divides
    vec_id, the label is the next one modulo ``labels``."""
    label = F.col("label").cast("long")
    if noisy_every:
        label = F.when(F.col("vec_id") % noisy_every == 0, (label + 1) % labels).otherwise(label)
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE))
    few = F.forall(F.col("x"), lambda v: F.abs(v) < (1 << 31))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(ok)
    return found.select("vec_id", "label", x.alias("x")).withColumn("x", F.when(few, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large"))).cast("array<int>"))


def _name() -> Column:
    """A name of a vector and label."""
    return F.md5(F.concat(F.col("label").cast("string"), F.lit(":"), F.array_join(F.col("x").cast("array<string>"), ",")).cast("binary"))


def classes(rows: DataFrame) -> DataFrame:
    """(class_id, label, x, ids): the distinct vectors of each label, with their KEEP smallest ids."""
    least = rows.withColumn("_k", F.dense_rank().over(W.partitionBy("x", "label").orderBy("vec_id"))).where(F.col("_k") <= KEEP)
    made = least.groupBy("x", "label").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return made.select(_name().alias("class_id"), "label", "x", "ids")


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where no sum reaches 2^53, as 64-bit integers else."""
    most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("scores do not fit into 64-bit integers")


class Pivots:
    """The pivots' vectors and the greatest norm; distances of rows (filled up) and of anchors to them."""

    def __init__(self, x: np.ndarray, norm2: float):
        self.x, self.norm2, self.own = x, norm2, (x * x).sum(1)
        self.last = np.sqrt(np.maximum(norm2 - self.own, 0.0))
        self.slack = SLACK * (1.0 + np.sqrt(norm2))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0.0))
        d2 = (x * x).sum(1)[:, None] + self.own - 2 * (x @ self.x.T) + (last[:, None] - self.last) ** 2
        return np.sqrt(np.maximum(d2, 0.0))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(1)[:, None] + self.norm2 - 2 * (x @ self.x.T)
        return np.sqrt(np.maximum(d2, 0.0))

    def reach(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far a row with a score of ``least`` is from each anchor."""
        return np.sqrt(np.maximum((x * x).sum(1) + self.norm2 - 2 * least, 0.0))


def fit_pivots(found: DataFrame, anchors: int) -> tuple[Pivots, int]:
    """Pivots drawn by hash, one for ANCHORS_A_CELL anchors, 2 at least and MOST_PIVOTS at most; and the dimension."""
    bound = found.agg(F.max(F.size("x")).alias("dim"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("norm2")).first()
    many = int(min(MOST_PIVOTS, max(2, -(-anchors // ANCHORS_A_CELL))))
    drawn = found.select("class_id", "x").orderBy(F.xxhash64("class_id"), "class_id").limit(many).toPandas()
    return Pivots(_matrix(drawn["x"], bound["dim"]), float(bound["norm2"])), int(bound["dim"])


# What a task keeps for an anchor and a band of scores: the best rows by score, then by their smallest id.


def _best(got: np.ndarray, ids: np.ndarray, allowed: np.ndarray, many: int) -> list[np.ndarray]:
    """For each anchor the places of its best ``many`` allowed rows: greatest score, then least id."""
    by_id = np.argsort(ids, kind="stable")
    worst = np.iinfo(np.int64).min
    s = np.where(allowed, got, worst)[:, by_id]
    out = []
    for k in range(len(s)):
        row = s[k]
        if len(row) > many:
            least = np.partition(row, len(row) - many)[len(row) - many]
            at = np.flatnonzero(row >= least)
        else:
            at = np.arange(len(row))
        at = at[row[at] > worst]
        out.append(by_id[at[np.argsort(-row[at], kind="stable")][:many]])
    return out


def _positives_of(anchors: pd.DataFrame, rows: pd.DataFrame, dim: int) -> pd.DataFrame:
    got = scores(_matrix(anchors["x"], dim), _matrix(rows["x"], dim))
    same = anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()
    best = _best(got, rows["first_id"].to_numpy(np.int64), same, KEEP)
    at = [(a, b) for a, found in enumerate(best) for b in found]
    a, b = (np.array([x[k] for x in at], np.int64) for k in (0, 1))
    return pd.DataFrame({"anchor": anchors["anchor"].to_numpy()[a], "band": np.int64(0), "score": got[a, b], "ids": rows["ids"].to_numpy()[b]})


def _negatives_of(anchors: pd.DataFrame, rows: pd.DataFrame, dim: int) -> pd.DataFrame:
    got = scores(_matrix(anchors["x"], dim), _matrix(rows["x"], dim))
    other = anchors["label"].to_numpy()[:, None] != rows["label"].to_numpy()
    first = rows["first_id"].to_numpy(np.int64)
    order = np.lexsort((first, np.zeros(len(first))))
    out = []
    for a, bands in enumerate(anchors["bands"]):
        at = order[other[a, order]]
        at = at[np.argsort(-got[a, at], kind="stable")]
        falling = -got[a, at]
        for p in bands:
            low, high = -(-p // 2), 95 * p // 100
            begin, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
            out += [(a, p, b) for b in at[begin : min(end, begin + NEGATIVES)]]
    a, p, b = (np.array([x[k] for x in out], np.int64) for k in range(3))
    return pd.DataFrame({"anchor": anchors["anchor"].to_numpy()[a], "band": p, "score": got[a, b] if len(a) else np.zeros(0, np.int64), "ids": rows["ids"].to_numpy()[b]})


def _served(anchors: DataFrame, rows: DataFrame, pivots: Pivots, dim: int, of) -> DataFrame:
    """(anchor, band, score, ids): for every anchor (anchor, label, x, bands, least, most) the best of each block of
    the rows (class_id, label, x, ids) that can serve its cell."""
    spark = rows.sparkSession

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["x"], dim)
            d = pivots.of_anchors(x)
            least, most = (pdf[c].to_numpy(float) for c in ("least", "most"))
            bounded = np.isfinite(least)
            far = pivots.reach(x, np.where(bounded, least, 0.0)) + pivots.slack
            near = pivots.reach(x, most) - pivots.slack
            lows = np.maximum(np.maximum(near[:, None] - d, 0.0), d - far[:, None])
            yield pdf.assign(cell=np.where(bounded, d.argmin(1), WIDE), lows=list(np.where(bounded[:, None], lows, -np.inf)), highs=list(np.where(bounded[:, None], d + far[:, None], np.inf)))

    schema = "anchor string, label long, x array<int>, bands array<long>, least double, most double, cell int, lows array<double>, highs array<double>"
    dealt = materialise(anchors.select("anchor", "label", "x", "bands", "least", "most").mapInPandas(placed, schema), "anchors-placed")
    each = dealt.select("cell", F.posexplode(F.arrays_zip("lows", "highs")).alias("p", "b")).groupBy("cell", "p").agg(F.min("b.lows").alias("low"), F.max("b.highs").alias("high"))
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = sorted((r["cell"], r["n"]) for r in sizes.collect())
    if not cells:
        return spark.createDataFrame([], "anchor string, band long, score long, ids array<long>")
    low, high = (np.full((len(cells), len(pivots.x)), v) for v in (np.inf, -np.inf))
    at = {c: k for k, (c, _) in enumerate(cells)}
    for r in each.collect():
        low[at[r["cell"]], r["p"]], high[at[r["cell"]], r["p"]] = r["low"], r["high"]
    names = np.array([c for c, _ in cells])
    blocks = {c: -(-n // BLOCK_ANCHORS) for c, n in cells}

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = pivots.of_rows(_matrix(pdf["x"], dim))
            meets = np.stack([((d >= low[k]) & (d <= high[k])).all(1) for k in range(len(names))], 1)
            yield pdf.assign(cells=[names[m].tolist() for m in meets])

    sent = rows.select("class_id", "label", "x", "ids").mapInPandas(copied, "class_id string, label long, x array<int>, ids array<long>, cells array<int>")
    sent = sent.select("label", "x", "ids", F.col("ids")[0].alias("first_id"), F.xxhash64("class_id").alias("h"), F.explode("cells").alias("cell"))
    arrived = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {c: max(1, -(-arrived.get(c, 0) // BLOCK_ROWS)) for c, _ in cells}
    many = lambda held: F.element_at(F.create_map(*(F.lit(int(v)) for kv in held.items() for v in kv)), F.col("cell"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = dealt.select("anchor", "label", "x", "bands", "cell", F.pmod(F.xxhash64("anchor"), many(blocks)).cast("int").alias("block"), upto(many(shares)).alias("share"))
    right = sent.select("label", "x", "ids", "first_id", "cell", F.pmod("h", many(shares)).cast("int").alias("share"), upto(many(blocks)).alias("block"))
    keys = ["cell", "block", "share"]

    def join(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [of(a[k : k + BLOCK_ANCHORS], b, dim) for k in range(0, len(a), BLOCK_ANCHORS)] if len(b) else []
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "band": [], "score": [], "ids": []})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(join, "anchor string, band long, score long, ids array<long>")


def _ranked(found: DataFrame, many: int) -> DataFrame:
    """(anchor, band, score, vec_id, place): the best rows over all blocks."""
    rows = found.select("anchor", "band", "score", F.explode("ids").alias("vec_id"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= many)


def _probed(anchors: DataFrame, rows: DataFrame, pivots: Pivots, dim: int) -> DataFrame:
    """Adds least: a score that each of the KEEP best rows of an anchor's label reaches; infinite where unknown."""

    def celled(anchor: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf["x"], dim)
                    d = pivots.of_anchors(x) if anchor else pivots.of_rows(x)
                    yield pdf.assign(cell=d.argmin(1).astype(np.int32), far=d.min(1))

        return run

    kind = "label long, x array<int>, {}, cell int, far double"
    some = rows.select("label", "x", "ids").mapInPandas(celled(False), kind.format("ids array<long>"))
    some = some.withColumn("_k", F.row_number().over(W.partitionBy("cell", "label").orderBy("far", F.col("ids")[0]))).where(F.col("_k") <= PROBE)
    some = some.groupBy("cell", "label").agg(F.collect_list(F.struct("x", F.size("ids").alias("n"))).alias("probe"))
    mine = anchors.select("label", "x", "anchor").mapInPandas(celled(True), kind.format("anchor string"))

    @F.pandas_udf("double")
    def least(x: pd.Series, probe: pd.Series) -> pd.Series:
        out = []
        for v, p in zip(x, probe, strict=True):
            if p is None or not len(p):
                out.append(np.inf)
                continue
            s = scores(_matrix(pd.Series([v]), dim), _matrix(pd.Series([r["x"] for r in p]), dim))[0]
            s = np.repeat(s, [r["n"] for r in p])
            out.append(float(np.sort(s)[-KEEP]) if len(s) >= KEEP else np.inf)
        return pd.Series(out)

    return mine.join(some, ["cell", "label"], "left").select("anchor", "label", "x", least("x", "probe").alias("least"))


def hard_negatives(rows: DataFrame, anchor: str = f"vec_id % {ANCHOR_EVERY} = 0") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``usable`` that the
    condition ``anchor`` names."""
    prepare(rows.sparkSession)
    rows = materialise(rows, "vectors")
    found = materialise(classes(rows), "vector-classes")
    asked = rows.where(anchor).withColumnRenamed("vec_id", "anchor_id")
    # Anchors of one vector and label have one search.
    whole = materialise(asked.select("anchor_id", _name().alias("anchor"), "label", "x").distinct(), "anchors")
    searched = whole.select("anchor", "label", "x").distinct()
    pivots, dim = fit_pivots(found, searched.count()) if found.limit(1).count() else (Pivots(np.zeros((1, 1)), 0.0), 1)
    bounded = _probed(searched, found, pivots, dim).withColumns({"bands": F.array(F.lit(0).cast("long")), "most": F.lit(float("inf"))})
    best = materialise(_ranked(_served(bounded, found, pivots, dim, _positives_of), KEEP), "nearest")
    bands = best.where("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("bands"))
    banded = searched.join(bands, "anchor").withColumns({"least": F.ceil(F.array_min("bands") / 2).cast("double"), "most": F.array_max("bands").cast("double") * 0.95})
    negatives = _ranked(_served(banded, found, pivots, dim, _negatives_of), NEGATIVES).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "place": "rank", "band": "positive_score"})
    mine = whole.select("anchor_id", "anchor").join(best.select("anchor", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "anchor").where("positive_id <> anchor_id")
    mine = mine.withColumn("_k", F.row_number().over(W.partitionBy("anchor_id", "anchor").orderBy(F.desc("positive_score"), "positive_id"))).where(F.col("_k") <= POSITIVES)
    return mine.join(negatives, ["anchor", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hard negatives of every anchor's five positives in ``embeddings``."""
    return hard_negatives(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), noisy_every=7))


_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS positive_id, p.score AS ps, s.b AS negative_id, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": _SQL}
