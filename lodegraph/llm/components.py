"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge to another one; ``root`` is the smallest node reachable.

    ``edges`` has two columns of one ordered type.  Edges with a null end and loops are ignored; repeated edges
    count once.  The work of a round is joins and aggregates over the edges, and rounds grow with the logarithm of
    the number of nodes; a hub's edges are split by the engine's skew handling.
    """
    a, b = edges.columns
    pairs = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    pairs, size = _stored(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # every larger neighbour of a node hangs on the least node around it
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        # then every node and its smaller neighbours hang on the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after, then = _stored(least.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        if then == size:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        pairs, size = after, then


def _stored(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs on reliable storage, and what tells two sets of pairs apart."""
    pairs = checkpoint(pairs)
    sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    return pairs, tuple(pairs.agg(F.count(F.lit(1)), *sums).first())
