"""Connected components of an edge table, as joins and grouped minima."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge table (a, b) and the least node it is connected to.

    Each round links every neighbour of a node to the least one of them: first the greater
    neighbours, then the smaller ones, until every edge leads straight to a component's least
    node.  Rounds grow with the logarithm of the number of nodes.  A round's edges are written to
    the shared folder, and only their number and a checksum reach the driver.  Minima are
    taken before the shuffle, so a node with very many neighbours is no problem; the joins
    are plain ones that adaptive execution may split.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    state = _state(pairs)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        pairs = materialize(_small_star(_large_star(pairs)).distinct(), "edges")
        after = _state(pairs)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved)
