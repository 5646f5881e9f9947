"""Graph walks over an edge table (subject_key, predicate, object_key, edge_id).

Edges may come without ids, which then follow from the rest of an edge and are made for the result only.

Each level is one join of the frontier with the edges.  A level is checkpointed
so that the plan does not grow with the depth; the driver only sees counts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.session import checkpoint, dealt, forget

IMPACT_PREDICATES = ("depends_on", "imports")

COMPACT_EVERY = 16

EDGE_ORDER = ("subject_key", "predicate", "object_key", "edge_id")


def impact(
    edges: DataFrame,
    start: str,
    direction: str,
    depth: int | None = None,
    limit: int | None = None,
    predicates: tuple = IMPACT_PREDICATES,
) -> DataFrame:
    """Breadth-first walk with one canonical shortest edge per node.

    The walk goes on until nothing new is found, or to ``depth`` levels.  ``limit`` keeps the first steps of the
    finished walk in order of depth and edge; ``limit_reached`` tells whether there were more.  The edges are stored
    once, dealt out by the end that a level looks up, so that levels shuffle their frontier only.
    """
    near, far = ("subject_key", "object_key") if direction == "outbound" else ("object_key", "subject_key")
    spark = edges.sparkSession
    order = [c for c in EDGE_ORDER if c in edges.columns]
    usable = dealt(edges.where(F.col("predicate").isin(*predicates)).select(*order), near, "edges")
    frontier = spark.range(1).select(F.lit(start).alias("_key"))
    visited, steps, total, level = frontier, None, 0, 0
    while depth is None or level < depth:
        level += 1
        found = checkpoint(
            usable.join(frontier, usable[near] == F.col("_key"), "left_semi")
            .groupBy(F.col(far).alias("node_key"))
            .agg(F.min(F.struct(*order)).alias("edge"))
            .join(visited, F.col("node_key") == visited["_key"], "left_anti")
        )
        size = found.count()
        if size == 0:
            break
        total += size
        step = found.select(F.lit(level).alias("depth"), "node_key", "edge")
        steps = step if steps is None else steps.unionByName(step)
        frontier = found.select(F.col("node_key").alias("_key"))
        visited = visited.unionByName(frontier)
        if level % COMPACT_EVERY == 0:
            visited = checkpoint(visited)
    forget(usable)
    if steps is None:
        return spark.createDataFrame([], "depth int, node_key string, edge_id string, limit_reached boolean")
    reached = limit is not None and total > limit
    if reached:
        steps = steps.orderBy("depth", "edge").limit(limit)
    made = identity.edge_id("edge.subject_key", "edge.predicate", "edge.object_key")
    edge_id = F.col("edge.edge_id") if "edge_id" in order else made
    return steps.select("depth", "node_key", edge_id.alias("edge_id"), F.lit(reached).alias("limit_reached"))


def impact_both(
    nodes: DataFrame, edges: DataFrame, start: str, depth: int | None = None, limit: int | None = None
) -> DataFrame:
    """Inbound and outbound walk; no rows when the start node does not exist."""
    if nodes.where(F.col("stable_key") == start).limit(1).count() == 0:
        empty = "direction string, depth int, node_key string, edge_id string, limit_reached boolean"
        return nodes.sparkSession.createDataFrame([], empty)
    sides = [
        impact(edges, start, side, depth, limit).withColumn("direction", F.lit(side)) for side in ("inbound", "outbound")
    ]
    return sides[0].unionByName(sides[1])


def descendants(edges: DataFrame, roots: DataFrame, near: str = "subject_key", far: str = "object_key") -> DataFrame:
    """All (root, node) pairs reachable from the given roots, any number of levels.

    ``roots`` has one column ``root``.  Semi-naive: only new pairs are extended.  The links are stored once, dealt out
    by the end that a level looks up.
    """
    links = dealt(edges.select(F.col(near).alias("_from"), F.col(far).alias("_to")), "_from", "links")
    fresh = checkpoint(roots.select("root", F.col("root").alias("node")).distinct())
    known, levels = fresh, 0
    while True:
        step = (
            fresh.join(links, fresh["node"] == links["_from"])
            .select("root", F.col("_to").alias("node"))
            .distinct()
            .join(known, ["root", "node"], "left_anti")
        )
        fresh = checkpoint(step)
        if fresh.isEmpty():
            forget(links)
            return known
        # every level is stored already; the union is only rewritten when it gets long
        known, levels = known.unionByName(fresh), levels + 1
        if levels % COMPACT_EVERY == 0:
            known = checkpoint(known)


def subtree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything reachable from each root plus the root's direct dependents."""
    dependents = edges.select(F.col("object_key").alias("root"), F.col("subject_key").alias("node")).join(
        roots.select("root").distinct(), "root", "left_semi"
    )
    return descendants(edges, roots).unionByName(dependents).distinct()
