"""Connected components by repeated contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import materialise

#: Rows of a file of the small tables between rounds.
FILE_ROWS = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): nodes of one component have the same root, which is one of
    them. In each round every node is drawn to the least of itself and its neighbours, in an order that is hashed
    anew for each round, and the edges are renamed; a star is done in one round and a path loses a part of its
    length. Tables are written to the shared folder. Null ends must not occur."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    left, named = now.count(), None
    k = 0
    while left:
        files = 1 + left // FILE_ROWS
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("to"))
        drawn = materialise(drawn.coalesce(files), "drawn")
        step = lambda c: drawn.select(F.col("node").alias(c), F.col("to").alias(f"t{c}"))  # noqa: B023, E731
        renamed = now.join(step("a"), "a").join(step("b"), "b").where("ta <> tb").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct()
        if named is None:
            named = drawn.withColumnRenamed("to", "root")
        else:
            moved = drawn.select(F.col("node").alias("root"), "to")
            named = materialise(named.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).coalesce(files), "named")
        now = materialise(renamed.coalesce(files), "edges")
        left, k = now.count(), k + 1
    if named is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return named
