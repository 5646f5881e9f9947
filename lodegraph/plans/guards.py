"""Guard chains: route, handler, guard, and the calls that lead to a service or model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.resolve import union_all
from lodegraph.operators.traversal import COMPACT_EVERY
from lodegraph.session import checkpoint, dealt, forget

GUARD, TARGETS = "auth_dependency", ("service", "model")


def anchors(edges: DataFrame, roles: DataFrame, test_nodes: DataFrame) -> DataFrame:
    """(route, handler, guard) of routes and handlers outside test files.

    ``edges``: subject_key, predicate, object_key, edge_id, evidence-backed ones only.
    ``roles``: key, role.  ``test_nodes``: key.
    """
    tests = test_nodes.select("key").distinct()
    routes = edges.where("predicate = 'routes_to'").select(
        F.col("subject_key").alias("route"), F.col("object_key").alias("handler")
    )
    for side in ("route", "handler"):
        routes = routes.join(tests, routes[side] == tests["key"], "left_anti")
    guards = roles.where(F.col("role") == GUARD).select("key").distinct()
    injected = edges.where("predicate = 'injects'").select(
        F.col("subject_key").alias("handler"), F.col("object_key").alias("guard")
    )
    injected = injected.join(guards, injected["guard"] == guards["key"], "left_semi")
    return routes.distinct().join(injected.distinct(), "handler").select("route", "handler", "guard")


def guard_paths(edges: DataFrame, guards: DataFrame) -> list[DataFrame]:
    """Levels of the breadth-first tree of ``calls`` below each guard: (guard, node, parent, edge_id, depth, rank).

    ``rank`` grows in queue order among the nodes of a guard on a level: by the parent's rank, then by node.  So a node
    is found first by its parent of least rank, and a row is as short on a deep level as on the first.  Ranks come from
    range-partitioned, sorted rows, which also spreads a guard with most of the nodes over tasks.  The calls are stored
    once, dealt out by the caller that a level looks up.  Edges may come without ``edge_id``; levels then have none.
    """
    ids = [c for c in edges.columns if c == "edge_id"]
    calls = edges.where("predicate = 'calls'").select(
        F.col("subject_key").alias("parent"), F.col("object_key").alias("node"), *ids
    )
    calls = dealt(calls, "parent", "calls")
    start = guards.select("guard").distinct()
    fresh = checkpoint(start.select("guard", F.col("guard").alias("node"), F.lit(0).cast("bigint").alias("rank")))
    visited, levels = fresh.select("guard", "node"), []
    while True:
        found = (
            fresh.select("guard", F.col("node").alias("parent"), F.col("rank").alias("above"))
            .join(calls, "parent")
            .groupBy("guard", "node")
            .agg(F.min(F.struct("above", "parent", *ids)).alias("_f"))
            .join(visited, ["guard", "node"], "left_anti")
            .select("guard", "node", "_f.*")
        )
        order = "guard", "above", "node"
        placed = found.repartitionByRange(*order).sortWithinPartitions(*order)
        # the ids of sorted ranges grow from range to range, with gaps; stored, as a second run may cut elsewhere
        fresh = checkpoint(placed.withColumn("rank", F.monotonically_increasing_id()).drop("above"))
        if fresh.isEmpty():
            forget(calls)
            return levels
        levels.append(fresh.withColumn("depth", F.lit(len(levels) + 1)))
        visited = visited.unionByName(fresh.select("guard", "node"))
        if len(levels) % COMPACT_EVERY == 0:
            visited = checkpoint(visited)


def used_hops(levels: list[DataFrame], roles: DataFrame) -> DataFrame:
    """Tree edges on the way to a classified target: (guard, subject_key, object_key, edge_id, depth).

    Marks go back up level by level: a node is needed if it is a target or the parent of a needed node.
    """
    targets = roles.where(F.col("role").isin(*TARGETS)).select(F.col("key").alias("node")).distinct()
    used, parents = [], None
    for level in reversed(levels):
        marks = level.join(targets, "node", "left_semi").select("guard", "node")
        if parents is not None:
            marks = marks.unionByName(parents)
        used.append(checkpoint(level.join(marks, ["guard", "node"], "left_semi")))
        parents = used[-1].select("guard", F.col("parent").alias("node")).distinct()
    if not used:
        empty = "guard string, subject_key string, object_key string, edge_id string, depth int"
        return roles.sparkSession.createDataFrame([], empty)
    ids = [c for c in levels[0].columns if c == "edge_id"]
    return union_all(used).select(
        "guard", F.col("parent").alias("subject_key"), F.col("node").alias("object_key"), *ids, "depth"
    )


def role_of(roles: DataFrame) -> DataFrame:
    """(key, kind): middleware before service before model; callers default to dependency."""
    rank = F.when(F.col("role") == GUARD, 0).when(F.col("role") == "service", 1).when(F.col("role") == "model", 2)
    best = roles.groupBy("key").agg(F.min(rank).alias("_r")).where("_r IS NOT NULL")
    return best.select("key", F.get(F.array(F.lit("middleware"), F.lit("service"), F.lit("model")), F.col("_r")).alias("kind"))


def claims(anchor_rows: DataFrame, hops: DataFrame, roles: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Distinct (kind, key, confidence) of nodes that have evidence."""
    named = hops.select(F.col("object_key").alias("key")).distinct().join(role_of(roles), "key", "left")
    rows = union_all(
        [
            anchor_rows.select(F.lit("route").alias("kind"), F.col("route").alias("key"), F.lit("observed").alias("confidence")),
            anchor_rows.select(F.lit("middleware").alias("kind"), F.col("guard").alias("key"), F.lit("heuristic").alias("confidence")),
            named.select(F.coalesce("kind", F.lit("dependency")).alias("kind"), "key", F.lit("heuristic").alias("confidence")),
        ]
    )
    return rows.distinct().join(evidenced.select("key").distinct(), "key", "left_semi")


def relationships(anchor_rows: DataFrame, hops: DataFrame) -> DataFrame:
    """Distinct (subject_key, predicate, object_key) over all chains."""
    parts = [
        anchor_rows.select(F.col("route").alias("subject_key"), F.lit("routes_to").alias("predicate"), F.col("handler").alias("object_key")),
        anchor_rows.select(F.col("handler").alias("subject_key"), F.lit("injects").alias("predicate"), F.col("guard").alias("object_key")),
        hops.select("subject_key", F.lit("calls").alias("predicate"), "object_key"),
    ]
    return union_all(parts).distinct()


def explain(edges: DataFrame, roles: DataFrame, test_nodes: DataFrame, evidenced: DataFrame) -> dict[str, DataFrame]:
    """All parts of the explanation.

    A chain is an anchor row followed by the hops of its guard; hops are kept once
    per guard because every route behind that guard shares them.
    """
    found = anchors(edges, roles, test_nodes)
    hops = used_hops(guard_paths(edges, found), roles)
    return {
        "chains": found,
        "hops": hops,
        "claims": claims(found, hops, roles, evidenced),
        "relationships": relationships(found, hops),
    }
