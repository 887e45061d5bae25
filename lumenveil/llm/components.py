"""Connected components over an edge table, by alternating star contractions.

The large-star and small-star steps of Kiveris et al. ("Connected Components in
MapReduce and Beyond"): every step is one aggregation and one join on node ids,
the number of rows never grows, and each round is cut with a written table, so
neither a long chain nor a hub passes through one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.session import discard, materialize, shuffle_partitions


def _table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table of few files: rounds are many, edges are small.

    Every core still has work, and no file is larger than eight partitions.
    """
    spark = df.sparkSession
    return materialize(df.coalesce(max(4 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 8)), name)


def _least(pairs: DataFrame) -> DataFrame:
    """(node, least): the least of each node and its neighbours, as a table.

    A join of two plain tables can split the rows of a hub among tasks; a join
    with an aggregation that has just run cannot.
    """
    return _table(pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), "least")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (node > other)."""
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    least = _least(both)
    larger = both.filter("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("other"))
    large = _table(larger.distinct(), "large-star")
    own = _least(large)
    steps = F.array(F.struct(F.col("other").alias("node"), F.col("least").alias("other")), F.struct("node", F.col("least").alias("other")))
    small = large.join(own, "node").select(F.inline(steps)).filter("node > other").distinct()
    after = _table(small, "edges")
    for table in (least, large, own):
        discard(table)
    return after


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns: a, b).

    root is the least node reachable, the node itself included. Self-loops,
    repeated edges and either direction are fine; an empty table gives no rows.
    Stops when a round changes nothing, which the row count and the sum of row
    hashes show; these two numbers are all that reaches the driver.
    """
    current = _table(
        edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).filter("node > other").distinct(),
        "edges",
    )
    state = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        after = _round(current)
        discard(current)
        current = after
    roots = current.select("other").distinct().select(F.col("other").alias("node"), F.col("other").alias("root"))
    return current.select("node", F.col("other").alias("root")).unionByName(roots)
