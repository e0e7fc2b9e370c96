"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm.common import discard, materialize

#: Rows a task and file of a round holds, about: tables of few links are not cut into many files.
ROWS_A_FILE = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of one orderable type, in any direction, repeats and loops allowed, to
    (node, component): each node of an edge with the smallest node it can reach.

    Each round is two joins on the nodes, each with a written table that has every node once:
    where Spark finds that table small it is broadcast, else both sides are shuffled and a node
    of very many links can be split. Neither the lineage nor the driver grows with the rounds.
    The rounds end when every node is the least of its neighbourhood or has one neighbour, a
    smaller one: that neighbour can't have one neighbour only, so it is the least of the
    component. Rows with a null end are ignored; no edges give no rows. Rounds grow with the
    logarithm of the longest path.
    """
    e = edges.where("a is not null and b is not null and a != b")
    e = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    files = max(e.sparkSession.sparkContext.defaultParallelism, -(-e.count() // ROWS_A_FILE))  # no round has more rows

    def put(df: DataFrame, name: str) -> DataFrame:
        return materialize(df.coalesce(files), name)

    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = put(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "cc-low")
        if low.where("m < u and m != most").isEmpty():
            discard(e)
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        large = both.where("v > u").join(low.select("u", F.least("u", "m").alias("m")), "u")
        large = put(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "cc-large")
        least = put(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        for old in (e, low, large, least):
            discard(old)
        e = small
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
