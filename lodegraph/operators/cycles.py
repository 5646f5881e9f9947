"""Strongly connected components of a link table.

First, nodes that nothing leads to or that lead nowhere are trimmed, as long as that halves the links.

A round takes away nodes without incoming or outgoing links, and bypasses nodes with one of each: the link into such a
node and the one out of it become one link.  Of neighbours that could both be bypassed the one with the smaller hash
is, so a round bypasses a third of a chain, and chains, rings and trees shrink to nothing in rounds that grow with the
logarithm of their size.  (A node that is taken away may come back with the link around its bypassed neighbour; it
still has no other side, and goes in the next round.)  What is left is coloured: every node takes the greatest node that reaches it, and those that
reach their own colour backwards are a component.  At the end bypassed nodes come back, the last ones first: they are
in the component of their two neighbours if these are in the same one.

Rounds are stored below the checkpoint folder, as tables where many of them follow each other: constraints that
checkpoints carry on would multiply.  The driver only sees how many links are left, or whether a table is empty.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.resolve import union_all
from lodegraph.session import checkpoint, written


def _degrees(links: DataFrame) -> DataFrame:
    """(node, i, before, o, after): how many links go in and out, and the least of their other ends."""
    into = links.groupBy(F.col("t").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("s").alias("before"))
    out = links.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("t").alias("after"))
    return into.join(out, "node", "full")


def _bypassed(degrees: DataFrame, number: int) -> DataFrame:
    """(node, before, after) of nodes with one link in and one out, no two of which are neighbours."""
    rank = F.struct(F.xxhash64("node", F.lit(number)), "node").alias("rank")
    able = found = degrees.where("i = 1 AND o = 1").select("node", "before", "after", rank)
    for end in ("before", "after"):
        beside = able.select(F.col("node").alias(end), F.col("rank").alias("_beside"))
        found = found.join(beside, end, "left").where("_beside IS NULL OR rank < _beside").drop("_beside")
    return found.select("node", "before", "after")


def _coloured(links: DataFrame) -> DataFrame:
    """(node, comp): the components of the greatest colours, of one node too."""
    nodes = links.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    colour = checkpoint(nodes.withColumn("comp", F.col("node")))
    while True:
        reached = links.join(colour, links["s"] == colour["node"]).groupBy(F.col("t").alias("node"))
        more = reached.agg(F.max("comp").alias("_c"))
        grown = colour.join(more, "node", "left").withColumn("_grown", F.col("_c") > F.col("comp"))
        grown = checkpoint(grown.withColumn("comp", F.greatest("comp", "_c")))
        colour = grown.select("node", "comp")
        if grown.where("_grown").isEmpty():
            break
    at = {end: colour.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")) for end in ("s", "t")}
    within = checkpoint(links.join(at["s"], "s").join(at["t"], "t").where("_s = _t").select("s", "t"))
    found = front = checkpoint(colour.where("node = comp"))
    while True:
        before = within.join(front, within["t"] == front["node"]).select(F.col("s").alias("node"), "comp").distinct()
        front = checkpoint(before.join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def _trimmed(links: DataFrame) -> DataFrame:
    """The links without most of those that no cycle can hold: first links from nodes that nothing leads to, then links
    to nodes that lead nowhere.  Each side goes on while a turn at least halves the links, so all turns together cost
    little more than the first.
    """
    size = links.count()
    for near, far in (("s", "t"), ("t", "s")):
        halved = size > 0
        while halved:
            ends = links.select(F.col(far).alias(near)).distinct()
            rest = written(links.join(ends, near, "left_semi").select("s", "t"), "links")
            left = rest.count()
            halved, links, size = 0 < 2 * left <= size, rest, left
    return links


def components(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component) of every node that lies on a cycle; ``component`` is the smallest node of its component.

    Repeated links count once; links with a null end are left out.  A node with a link to itself is on a cycle.
    """
    links = links.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL")
    links = written(links, "links")
    loops, away = [links.where("s = t").select(F.col("s").alias("node"))], []
    left, found, number = written(_trimmed(links.where("s <> t")).distinct(), "links"), [], 0
    while not left.isEmpty():
        number += 1
        degrees = written(_degrees(left), "degrees")
        over = written(_bypassed(degrees, number), "bypassed")
        bypass, ends = not over.isEmpty(), degrees.where("i IS NULL OR o IS NULL")
        if bypass or not ends.isEmpty():
            gone = ends.select("node").unionByName(over.select("node"))
        else:
            found.append(checkpoint(_coloured(left)))
            gone = found[-1].select("node")
        gone = gone.withColumnRenamed("node", "_n")
        kept = left.join(gone, left["s"] == gone["_n"], "left_anti").join(gone, F.col("t") == gone["_n"], "left_anti")
        if bypass:
            away.append(over)
            joined = over.select(F.col("before").alias("s"), F.col("after").alias("t"))
            loops.append(joined.where("s = t").select(F.col("s").alias("node")))
            kept = kept.unionByName(joined.where("s <> t")).distinct()
        left = written(kept, "links")

    loop = checkpoint(union_all(loops).distinct())
    known = loop.select("node", F.col("node").alias("comp"))
    if found:
        several = checkpoint(union_all(found))
        real = several.groupBy("comp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("comp")
        several = several.join(real, "comp", "left_semi").select("node", "comp")
        known = several.unionByName(known.join(several, "node", "left_anti"))
    if away:
        known = known.join(union_all(away).select("node"), "node", "left_anti")
    known = written(known, "components")
    if not found and loop.isEmpty():
        return known.select("node", F.col("comp").alias("component"))
    for over in reversed(away):
        ends = over
        for end in ("before", "after"):
            ends = ends.join(known.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")), end, "left")
        ends = ends.join(loop.withColumn("_loop", F.lit(True)), "node", "left")
        own = F.when(F.col("_before") == F.col("_after"), F.col("_before")).when(F.col("_loop"), F.col("node"))
        more = written(ends.select("node", own.alias("comp")).where("comp IS NOT NULL"), "components")
        known = known.unionByName(more)
    least = known.groupBy("comp").agg(F.min("node").alias("component"))
    return known.join(least, "comp").select("node", "component")


def links_on_cycles(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Links within a component, which are the links that lie on a cycle."""
    found = components(links, source, target)
    links = links.select(source, target).distinct()
    for end in (source, target):
        links = links.join(found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end)
    return links.where(F.col(f"_{source}") == F.col(f"_{target}")).select(source, target)
