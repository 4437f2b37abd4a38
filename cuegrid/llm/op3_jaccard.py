"""Similarity join of documents by the Jaccard index of their word n-grams, with count-vector R-trees.

A document's set is that of its distinct shingles of SHINGLE words (lower-cased A-Z); shorter documents have
their whole word sequence as the one element; documents without words have an empty set and no link. Two sets
link if 4 * |A and B| >= 3 * |A or B|. Documents with equal sets form a class, and one document stands for it.

Points. Shingles are hashed into groups; a set's counts by group are its point. For any two sets the overlap is
at most the sum of the coordinate-wise minima of their points, and for a node of an R-tree at most the sum of the
minima of a point and the upper corner of the node's box. Nodes and pairs whose bound is too small for a link are
cut, first on GROUPS groups, then on finer counts of the same hashes, whose number grows with the set.

Blocks. One tree over all documents would neither be bounded nor spread, so trees are built for blocks that
together hold every possible link: under any total order of the shingles two linked sets share an element among
the first n - ceil(3n/4) + 1 of each (prefix filter). In the smaller of the two, whose overlap is 6/7 of it at least, it
is even among the first n - ceil(6n/7) + 1, the head. So each shingle that stands in two prefixes and in the head of one
is a block, of the sets that have it in their head and of larger ones that have it in their prefix. The order is from
rare to frequent where counts are known, then by hash; it matters for speed alone. Texts of one template that do not
link, however near they come, have heads of shingles of their own and share no block.

Clusters. The least class of a block is its leader. All classes of a leader's blocks are searched in one R-tree, so
a class is a point of few trees, and any two classes that share a block meet in one. A class belongs to the cluster
of the leader that most of its blocks have; classes of one cluster are compared in its leader's tree alone. A pair
that the bounds leave sends both classes to one of their two clusters; what leaves the trees is classes by cluster,
never pairs. Trees of more than TREE_ROWS points are split: the largest cluster is dealt out, the others visit every
part, and the leader's own cluster goes on as it is.

Verification. The full sets meet by cluster, in pieces of bounded size; overlaps are counted exactly by a product
of their incidence matrices, and each piece sends a spanning forest of its links. Where a cluster has several
pieces, its leader visits all of them, and then do all classes that are not yet in the cluster's largest
component. No pair of different components stays unverified.

Defined cases: null text counts as empty; null doc_id stays and is no component's id unless it is alone (then
null); repeated rows are rows of one class; very long texts are read whole; other columns are ignored. Shingles
are told apart by 64-bit hashes, classes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm.common import Seen, discard, join_texts, materialise, mix64, prepare, row_sums, sequence_class, signed, text_slices, whole_windows, window_hashes, word_hashes
from cuegrid.llm.components import components

SHINGLE, GROUPS, LEAF = 5, 256, 16
#: A shingle of this many sets may be put late in the order; at most so many, the most frequent ones, are.
COMMON, MOST_COMMON = 8, 100_000
#: Rows of a tree, rows of a piece, and shingles of a piece (by its average), at most.
TREE_ROWS, PIECE, PIECE_SHINGLES = 4096, 2048, 1 << 21


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingle hashes, bounds of the rows in them); ascending inside a row."""
    for at, data, offsets in text_slices(texts):
        words, bounds, _, _ = word_hashes(data, offsets, lower=True)
        row, start = whole_windows(bounds, SHINGLE)
        values = window_hashes(words, SHINGLE)[start] if len(start) else np.zeros(0, np.uint64)
        short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE))
        if len(short):
            row = np.concatenate([row, short])
            values = np.concatenate([values, mix64(sequence_class(words, bounds)[0][short])])
        order = np.lexsort((values, row))
        row, values = row[order], values[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
        yield at, values[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(bounds) - 1))])


def set_class(values: np.ndarray, bounds: np.ndarray, salt: int = 1) -> np.ndarray:
    return row_sums(mix64(values ^ np.uint64(0xA5A5 * salt)), bounds)


def class_names(c1: np.ndarray, c2: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """One number for the 128 bits of each class: the first 64, or for those first halves that two classes share
    (``clashes``) the halves combined."""
    return np.where(np.isin(c1, clashes), c1 ^ c2, c1) if len(clashes) else c1


def group_count(n: int) -> int:
    """Groups of a set of n shingles: GROUPS, or the largest power of two up to n."""
    return max(GROUPS, 1 << max(int(n).bit_length() - 1, 0))


def point(values: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((mix64(values) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(p: np.ndarray) -> bytes:
    """Counts with one, two or four bytes each, after the number of bytes."""
    width = 1 if p.max(initial=0) < 1 << 8 else 2 if p.max() < 1 << 16 else 4
    return bytes([width]) + p.astype(f"<u{width}").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """The point of fewer groups: the hashes are the same, so groups fall together."""
    return p.reshape(-1, groups).sum(0)


def prefix(values: np.ndarray, bounds: np.ndarray, common: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the prefixes: the first n - ceil(3n/4) + 1 in the order (level of common ones, hash)."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        order = np.lexsort((values, np.where(common[at] == values, level[at], 0), row))
        values = values[order]
    place = np.arange(len(values)) - bounds[:-1][row]
    keep = place < (n - -(-3 * n // 4) + 1)[row]
    return row[keep], values[keep]


def bound_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest possible overlap of sets with these points."""
    return np.minimum(a, b).sum(1, dtype=np.int64)


class Forest:
    """R-trees over the points of many blocks: leaves of LEAF rows, nodes of LEAF children. Rows come sorted by
    block. Of the boxes the upper corners are kept, as the bound needs no more, and the least and largest set
    size and side. Rows of one side are not compared, unless they are ``inner``."""

    def __init__(self, block: np.ndarray, side: np.ndarray, inner: np.ndarray, sizes: np.ndarray, vectors: np.ndarray):
        self.side, self.inner, self.sizes, self.vectors = side, inner, sizes, vectors
        #: Rows that a caller has found a partner of their side for. Two such rows of one side are not compared.
        self.known = np.zeros(len(sizes), bool)
        _, self.root, count = np.unique(block, return_inverse=True, return_counts=True)
        first = np.cumsum(count) - count
        high, low, left, right, top, end = sizes, sizes, side, side, vectors, np.arange(1, len(sizes) + 1)
        self.levels = []
        while not self.levels or len(high) > len(count):
            n = np.diff(np.append(first, len(high)))
            cut = np.flatnonzero((np.arange(len(high)) - np.repeat(first, n)) % LEAF == 0)
            stop = np.append(cut[1:], len(high))
            high, low, top = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut, axis=0)
            left, right, end = np.minimum.reduceat(left, cut), np.maximum.reduceat(right, cut), end[stop - 1]
            first = np.cumsum(-(-n // LEAF)) - -(-n // LEAF)
            self.levels.append((cut, stop, high, low, left, right, top, end))

    def _fits(self, q: np.ndarray, high, low, left, right, top, at: np.ndarray) -> np.ndarray:
        """Which (query, node) can hold a link: by size, by side, and by the bound."""
        size, side = self.sizes[q], self.side[q]
        ok = np.flatnonzero((4 * high[at] >= 3 * size) & (3 * low[at] <= 4 * size) & (self.inner[q] | (left[at] != side) | (right[at] != side)))
        out = [ok[:0]]
        for k in range(0, len(ok), 1 << 15):
            i = ok[k : k + (1 << 15)]
            out.append(i[7 * bound_of(top[at[i]], self.vectors[q[i]]) >= 3 * (size[i] + low[at[i]])])
        return np.concatenate(out)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, later row) of all pairs of a block that the bound leaves, for a share of the rows at a time."""
        k, share = 0, 64
        while k < len(self.sizes):
            q = np.arange(k, min(k + share, len(self.sizes)))
            at, k, share = self.root[q], k + share, min(2 * share, 1024)
            for cut, stop, high, low, left, right, top, end in reversed(self.levels):
                later = end[at] > q + 1
                q, at = q[later], at[later]
                fit = self._fits(q, high, low, left, right, top, at)
                q, at = q[fit], at[fit]
                n = stop[at] - cut[at]
                at = np.repeat(cut[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                q = np.repeat(q, n)
            later = (at > q) & ~(self.known[q] & self.known[at] & (self.side[q] == self.side[at]))
            q, at = q[later], at[later]
            fit = self._fits(q, self.sizes, self.sizes, self.side, self.side, self.vectors, at)
            yield q[fit], at[fit]


def finer(points: list[np.ndarray], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs pass the bound on as many groups as both points have."""
    groups = np.array([len(p) for p in points])
    both, keep = np.minimum(groups[a], groups[b]), np.ones(len(a), bool)
    for g in np.unique(both[both > GROUPS]).tolist():
        at = np.flatnonzero(both == g)
        rows, of = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        table = np.array([folded(points[r], g) for r in rows.tolist()], np.uint32)
        step = max(1, (1 << 23) // g)
        for k in range(0, len(at), step):
            i = at[k : k + step]
            bound = bound_of(table[of[k : k + len(i)]], table[of[len(at) + k : len(at) + k + len(i)]])
            keep[i] = 7 * bound >= 3 * (sizes[a[i]] + sizes[b[i]])
    return keep


def linked_groups(home: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set of a piece the first one that it is connected with by links of the piece. Overlaps are counted
    exactly, by a product of the incidence matrices over the shingles that stand in two sets or more; two sets
    that are only visiting are not compared."""
    size = np.diff(bounds)
    m = len(size)
    _, shingle, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[shingle]
    column, row = (np.cumsum(shared) - 1)[shingle[keep]], np.repeat(np.arange(m), size)[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    kind = np.float32 if size.max() < 1 << 24 else np.float64
    overlap = np.zeros((m, m), kind)
    width = 1024
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [c, c + width])
        part = np.zeros((m, width), kind)
        part[row[lo:hi], column[lo:hi] - c] = 1
        overlap += part @ part.T
    near = (7 * overlap >= 3 * (size[:, None] + size[None, :])) & (home[:, None] | home[None, :])
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], m).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


# --- Spark steps ---


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of locally common shingles (n_shingles = -1: hash in c1, count in c2)."""
    names = ["doc_id", "n_shingles", "c1", "c2", "point"]
    held: list[np.ndarray] = []

    def common(last: bool) -> Iterator[pa.RecordBatch]:
        if held and (last or sum(map(len, held)) > 2_000_000):
            value, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            value, count = value[count >= 4], count[count >= 4]
            none = pa.nulls(len(value), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(np.full(len(value), -1)), pa.array(signed(value)), pa.array(count.astype(np.int64)), pa.nulls(len(value), pa.binary())], names)

    for batch in batches:
        for at, values, bounds in shingle_sets(batch.column(1)):
            held.append(values)
            yield from common(False)
            p = [packed(point(values[i:j], group_count(j - i))) if j > i else None for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(p)), pa.array(np.diff(bounds)), pa.array(signed(set_class(values, bounds))), pa.array(signed(set_class(values, bounds, 2))), pa.array(p, pa.binary())], names)
    yield from common(True)


def _whole_nodes(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by (node, piece) as tables of whole pieces, of about so many rows or one larger piece."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node, piece = batch.column("node").to_numpy(), batch.column("piece").to_numpy()
        other = np.flatnonzero((node != node[-1]) | (piece != piece[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut and held:  # the last piece so far may have ended with the batch before
            before = held[-1]
            ended = (before.column("node")[-1].as_py(), before.column("piece")[-1].as_py()) != (int(node[0]), int(piece[0]))
        else:
            ended = cut > 0
        if ended and sum(b.num_rows for b in held) + cut >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class Join:
    """The steps over one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, tree_rows: int = TREE_ROWS, piece: int = PIECE, piece_shingles: int = PIECE_SHINGLES):
        self.tree_rows, self.piece, self.piece_shingles = tree_rows, piece, piece_shingles
        self.rows = docs.select(F.col("doc_id").cast("long"), "text")
        prepare(docs.sparkSession)
        summary = materialise(self.rows.mapInArrow(_summaries, "doc_id long, n_shingles long, c1 long, c2 long, point binary"), "summary")
        clash = summary.where("n_shingles > 0").groupBy("c1").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).where("lo < hi").select("c1")
        #: First halves of 128-bit hashes that two classes share: one pair is expected among six billion classes.
        self.clashes = np.array([r[0] for r in clash.collect()], np.int64)
        name = F.when(F.col("c1").isin(self.clashes.tolist()), F.col("c1").bitwiseXOR("c2")).otherwise(F.col("c1")) if len(self.clashes) else F.col("c1")
        self.docs = summary.where("n_shingles >= 0").select("doc_id", "n_shingles", name.alias("class"), "point")
        same = self.docs.where("n_shingles > 0").groupBy("class")
        self.classes = materialise(same.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("point").alias("point"), F.count("*").alias("copies")), "classes")
        #: Whether some class has no doc_id to fetch its text by.
        self.unnamed = not self.classes.where("doc_id IS NULL").isEmpty()
        counts = materialise(summary.where("n_shingles < 0").groupBy("c1").agg(F.sum("c2").alias("n")).where(F.col("n") >= COMMON).select("c1", F.floor(F.log2("n")).alias("level")), "counts")
        least, listed = 64, 0
        for level, n in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
            listed += n
            if listed > MOST_COMMON:
                break
            least = level
        common = sorted((r["c1"] & (1 << 64) - 1, r["level"]) for r in counts.where(F.col("level") >= least).collect())
        self.common, self.level = np.array([c for c, _ in common], np.uint64), np.array([n for _, n in common], np.int64)

    def prefixes(self) -> DataFrame:
        """(class, n, tokens): the set's size and prefix, in order; a class may come from several tasks."""
        common, level, clashes = self.common, self.level, self.clashes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Seen()
            for batch in batches:
                for _, values, bounds in shingle_sets(batch.column(0)):
                    row, token = prefix(values, bounds, common, level)
                    name = class_names(signed(set_class(values, bounds)), signed(set_class(values, bounds, 2)), clashes)
                    n = np.bincount(row, minlength=len(name))
                    keep = seen.new(name) & (n > 0)
                    offsets = np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(np.diff(bounds)[keep]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(token[keep[row]])))], ["class", "n", "tokens"])

        return materialise(self.rows.select("text").mapInArrow(run, "class long, n long, tokens array<long>"), "prefixes")

    def blocks(self) -> DataFrame:
        """(token, class, leader) of all blocks of two classes or more; leader is the block's least class. The
        leaders are combined before their shuffle; the rows of a very common shingle then meet its leader in a
        join, whose hot partitions Spark splits."""
        prefixes = self.prefixes()
        one = prefixes.select(F.posexplode("tokens").alias("place", "token"), "class", "n").withColumn("head", F.expr("place <= n - (6 * n + 6) div 7")).drop("place")
        ends = F.when(F.col("head"), F.col("n"))
        leaders = one.groupBy("token").agg(F.min("class").alias("leader"), F.max("class").alias("last"), F.min(ends).alias("low"), F.max(ends).alias("high")).where("leader < last AND low IS NOT NULL").select("token", "leader", "low", "high")
        leaders = materialise(leaders, "leaders")
        met = join_texts(one, leaders, "token", "inner").where("head OR (n >= low AND 3 * n <= 4 * high)")
        blocks = materialise(met.select("token", "class", "leader"), "blocks")
        discard(prefixes, leaders)
        return blocks

    def searched(self) -> DataFrame:
        """(class, node): the clusters in which a class must be verified."""
        blocks = self.blocks()
        votes = materialise(blocks.groupBy("class", "leader").count(), "votes")
        discard(blocks)
        cluster = materialise(votes.groupBy("class").agg(F.max_by("leader", "count").alias("cluster")), "cluster")
        weights = cluster.groupBy("cluster").agg(F.count("*").alias("weight"))
        known = materialise(cluster.join(weights.hint("merge"), "cluster"), "known")

        rows = materialise(votes.select("class", F.col("leader").alias("node")).join(known, "class"), "rows")
        sides = rows.groupBy("node", "cluster").agg(F.count("*").alias("n")).groupBy("node")
        nodes = sides.agg(F.sum("n").alias("rows"), F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.max_by("cluster", "n").alias("main"))
        parts = F.ceil(F.col("rows") / self.tree_rows).cast("int")
        nodes = materialise(nodes.where("rows > 1 AND (low < high OR low = node)").select("node", "main", parts.alias("parts")), "nodes")
        dealt = rows.join(nodes.hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("class"), "parts").cast("int"))
        pieces = F.when((F.col("parts") == 1) | (F.col("cluster") == F.col("main")), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = dealt.withColumn("piece", F.explode(pieces)).join(self.classes.select("class", "n", "point"), "class")
        inner = (F.col("parts") == 1) & (F.col("cluster") == F.col("node"))
        dealt = dealt.select("node", "piece", "class", "cluster", "weight", inner.alias("inner"), (F.col("own") == F.col("piece")).alias("home"), "n", "point")
        tree_rows = self.tree_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole_nodes(batches, tree_rows):
                name, at = _survivors(table)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(at)], ["class", "node"])

        near = dealt.repartition("node", "piece").sortWithinPartitions("node", "piece", "cluster", F.desc("n"), "class").mapInArrow(run, "class long, node long")
        large = rows.where("cluster = node").join(nodes.where("parts > 1").select("node").hint("merge"), "node").select("class", "node")
        out = materialise(near.unionAll(large).distinct(), "placed")
        discard(votes, rows)
        return out

    def links(self, deals: DataFrame) -> DataFrame:
        """(a, b): spanning forests of the links of all pieces; ``deals`` has (class, node, piece, home)."""
        clashes = self.clashes
        at = "array<struct<node:long,piece:int,home:boolean>>"
        needed = deals.groupBy("class").agg(F.collect_list(F.struct("node", "piece", "home")).alias("at")).join(self.classes.select("class", "doc_id"), "class")
        needed = materialise(needed.select("doc_id", "class", F.col("at").cast(at).alias("at")), "needed")
        schema = "node long, piece int, home boolean, class long, shingles array<long>"

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The set of each (text, class, at) whose text is of the class, once for each place."""
            seen = Seen()
            for batch in batches:
                want = batch.column(1).to_numpy()
                for first, values, bounds in shingle_sets(batch.column(0)):
                    own = class_names(signed(set_class(values, bounds)), signed(set_class(values, bounds, 2)), clashes)
                    keep = (own == want[first : first + len(own)]) & (np.diff(bounds) > 0)
                    keep[keep] = seen.new(own[keep])
                    for k in np.flatnonzero(keep).tolist():
                        places, one = batch.column(2)[first + k].as_py(), pa.array(signed(values[bounds[k] : bounds[k + 1]]))
                        step = max(1, 100_000 // len(one))
                        for s in range(0, len(places), step):
                            part = places[s : s + step]
                            offsets = np.arange(len(part) + 1, dtype=np.int32) * len(one)
                            shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([one] * len(part)))
                            yield pa.RecordBatch.from_arrays([pa.array([p["node"] for p in part], pa.int64()), pa.array([p["piece"] for p in part], pa.int32()), pa.array([p["home"] for p in part], pa.bool_()), pa.array([int(own[k])] * len(part), pa.int64()), shingles], ["node", "piece", "home", "class", "shingles"])

        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, values, bounds in shingle_sets(batch.column(0)):
                    name = class_names(signed(set_class(values, bounds)), signed(set_class(values, bounds, 2)), clashes)
                    offsets = pa.array(bounds.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.ListArray.from_arrays(offsets, pa.array(signed(values)))], ["class", "shingles"])

        rows = join_texts(self.rows, needed.where("doc_id IS NOT NULL"), "doc_id", "inner").select("text", "class", "at").mapInArrow(sets, schema)
        if self.unnamed:
            rest = self.rows.where("doc_id IS NULL").select("text").mapInArrow(names, "class long, shingles array<long>")
            rest = rest.join(needed.where("doc_id IS NULL").select("class", "at"), "class").select(F.inline("at"), "class", "shingles")
            rows = rows.unionAll(rest)
        least = self.piece

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole_nodes(batches, 1):
                node, piece, name, home = (table[c].to_numpy() for c in ("node", "piece", "class", "home"))
                listed = pa.concat_arrays(table["shingles"].chunks)
                values = listed.flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
                new = np.ones(len(node), bool)
                new[1:] = (node[1:] != node[:-1]) | (piece[1:] != piece[:-1]) | (name[1:] != name[:-1])  # a class may come from several tasks
                at = np.flatnonzero(new)
                cuts = np.flatnonzero(np.append(True, (node[at][1:] != node[at][:-1]) | (piece[at][1:] != piece[at][:-1])))
                one, two = [], []
                for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                    if j - i < 2:
                        continue
                    rows = at[i:j]
                    size = ends[rows + 1] - ends[rows]
                    inside = np.concatenate([values[ends[r] : ends[r + 1]] for r in rows.tolist()])
                    group = linked_groups(home[rows], inside, np.concatenate([[0], np.cumsum(size)]))
                    moved = np.flatnonzero(group != np.arange(len(rows)))
                    one.append(name[rows[group[moved]]])
                    two.append(name[rows[moved]])
                if one:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], ["a", "b"])

        found = materialise(rows.repartition("node", "piece").sortWithinPartitions("node", "piece", "class").mapInArrow(run, "a long, b long"), "links")
        discard(needed)
        return found

    def linked(self) -> DataFrame:
        """(node, root) of the classes that link with another."""
        placed = self.searched()
        pieces = placed.join(self.classes.select("class", "n"), "class").groupBy("node").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.min("class").alias("lead"))
        pieces = pieces.where("rows > 1").select("node", "lead", F.greatest(F.ceil(F.col("rows") / self.piece), F.ceil(F.col("total") / self.piece_shingles)).cast("int").alias("pieces"))
        pieces = materialise(pieces, "pieces")
        own = F.pmod(F.xxhash64("class"), "pieces").cast("int")
        everywhere = F.sequence(F.lit(0), F.col("pieces") - 1)

        def deal(rows: DataFrame, visits: "F.Column") -> DataFrame:
            return rows.select("class", "node", own.alias("own"), F.explode(F.when(visits, everywhere).otherwise(F.array(own))).alias("piece")).select("class", "node", "piece", (F.col("own") == F.col("piece")).alias("home"))

        links = self.links(deal(placed.join(pieces.hint("merge"), "node"), (F.col("class") == F.col("lead")) & (F.col("pieces") > 1)))
        roots = components(links)
        split = pieces.where("pieces > 1")
        if split.isEmpty():
            return roots
        rows = materialise(placed.join(split.hint("merge"), "node").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class")), "split")
        core = rows.groupBy("node", "root").count().groupBy("node").agg(F.max_by("root", "count").alias("core"))
        more = self.links(deal(rows.join(core.hint("merge"), "node"), F.col("root") != F.col("core")))
        return components(materialise(links.unionAll(more), "links"))

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every document. Only rows of classes that have copies or links meet
        others, so a class that is alone is not shuffled."""
        named = self.classes.select("class", "doc_id", "copies").join(self.linked().withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        named = materialise(named, "named")
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1")
        met = materialise(named.join(least.hint("merge"), "root").select("class", "component_id"), "met")
        docs = self.docs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class"))
        found = join_texts(docs, met.withColumn("in_component", F.lit(True)), "class", "left")
        return found.select("doc_id", "n_shingles", F.when(F.col("in_component"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _survivors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(class, cluster) of the classes of searched pieces that have a partner by the bounds."""
    node, piece, name, cluster, weight, inner, home, size = (table[c].to_numpy() for c in ("node", "piece", "class", "cluster", "weight", "inner", "home", "n"))
    points = [unpacked(b) for b in table["point"].to_pylist()]
    coarse = [folded(p, GROUPS) for p in points]
    top = max(p.max() for p in coarse)
    vectors = np.array(coarse, np.uint8 if top < 1 << 8 else np.uint32)
    change = np.append(False, (node[1:] != node[:-1]) | (piece[1:] != piece[:-1]))
    forest = Forest(np.cumsum(change), cluster, inner, size, vectors)
    who, where = [name[:0]], [name[:0]]
    for a, b in forest.pairs():
        ok = home[a] | home[b]
        a, b = a[ok], b[ok]
        ok = finer(points, size, a, b)
        a, b = a[ok], b[ok]
        alike = cluster[a] == cluster[b]
        forest.known[a[alike]] = forest.known[b[alike]] = True
        second = (weight[b] > weight[a]) | ((weight[b] == weight[a]) & (cluster[b] > cluster[a]))
        at = np.where(second, cluster[b], cluster[a])
        both = np.unique(np.stack([np.concatenate([name[a], name[b]]), np.concatenate([at, at])]), axis=1)
        who.append(both[0])
        where.append(both[1])
    both = np.unique(np.stack([np.concatenate(who), np.concatenate(where)]), axis=1)
    return both[0], both[1]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id); component_id is the smallest doc_id reachable by links."""
    return Join(docs).result()


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(min(r.reach), d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n"""
}
