"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a partially aggregated minimum per node and an equi-join back, so a node with very many neighbours is
combined before the shuffle.  The minima are written first: AQE splits a hot partition only of a join of two plain
shuffles.  Rounds end at a written table; their number grows
with the logarithm of the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import storage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = storage.written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = storage.written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = edges.join(least, "u")
    return joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of one orderable type to (node, root) for every node of an edge; the root is the component's least node."""
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = storage.written(now, "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        large = storage.written(_large_star(now).distinct(), "edges")
        new = storage.written(_small_star(large).where(F.col("u") != F.col("v")).distinct(), "edges")
        storage.delete(now)
        storage.delete(large)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
