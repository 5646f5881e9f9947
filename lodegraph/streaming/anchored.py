"""Fixed windows that open at a key's first hit, not on the clock.

A window opens at a hit, closes after ``width`` seconds, and the next hit opens
the next one.  Where a window opens depends on all earlier hits of the key, but
only through one number, the time before which the current window is still open.
Hits are therefore counted per timestamp and cut into time chunks.  Each chunk is
summarized as a step function, "open until x on entry -> open until y on exit".

Step functions of neighbouring chunks compose into one: a prefix composition over
a tree of chunks, ``FAN`` children to a node, gives every chunk its entry value in
rounds that grow with the logarithm of the number of chunks.  Going up, nodes are
composed; going down, a node's entry value runs through its children.  Then all
chunks number their windows independently.  A task holds the functions of one
key's node and child at a time, so no key is ever gathered in one task.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.groups import each_group, map_groups
from lodegraph.operators.ranking import ranked, running_total
from lodegraph.session import checkpoint

#: Children of a node of the tree of chunks.
FAN = 64
#: Rows in which tasks hand results on.
ROWS = 10_000


def composed(first: tuple, then: tuple, width: int) -> tuple:
    """One step function for two, each (entries, exits): the exit belongs to the first entry not below the state.

    A state above all entries passes unchanged.  Entries that no state can reach are left out: a window that is open
    on arrival was opened before the first entry, so it is over ``width`` after that one at the latest.
    """
    entry, ends = first
    at = np.searchsorted(then[0], ends)
    through = np.append(then[1], 0)[at]
    ends = np.where(at < len(then[0]), through, ends)
    limit = entry[0] + width
    if entry[-1] < limit:
        begin = int(np.searchsorted(then[0], entry[-1], "right"))
        to = int(np.searchsorted(then[0], limit)) + 1
        entry, ends = np.append(entry, then[0][begin:to]), np.append(ends, then[1][begin:to])
    # exits never decrease with the entry, so a run of equal exits needs only its last entry
    keep = np.append(ends[1:] != ends[:-1], True)
    return entry[keep], ends[keep]


def _frames(rows: list[dict]) -> pd.DataFrame:
    sizes = [len(r["_entry"]) if "_entry" in r else 1 for r in rows]
    out = {}
    for name in rows[0]:
        cells = [r[name] if isinstance(r[name], np.ndarray) else np.repeat(r[name], n) for r, n in zip(rows, sizes)]
        out[name] = np.concatenate(cells)
    return pd.DataFrame(out)


def _climb(width: int):
    """Step functions of parents from those of their children, which come in by key, parent, node and entry."""

    def step(batches):
        done, held, now, function = [], 0, None, None
        for group in each_group(batches, ["_key", "_parent", "_node"]):
            own = group["_key"][0], group["_parent"][0]
            table = group["_entry"], group["_exit"]
            if own == now:
                function = composed(function, table, width)
                continue
            if now is not None:
                done.append({"_key": now[0], "_node": now[1], "_entry": function[0], "_exit": function[1]})
                held += len(function[0])
            now, function = own, table
            if held > ROWS:
                yield _frames(done)
                done, held = [], 0
        if now is not None:
            done.append({"_key": now[0], "_node": now[1], "_entry": function[0], "_exit": function[1]})
            yield _frames(done)

    return step


def _descend(batches):
    """The entry value of each node from that of its parent (``_open``), in the same order."""
    done, now, state = [], None, None
    for group in each_group(batches, ["_key", "_parent", "_node"]):
        own = group["_key"][0], group["_parent"][0]
        if own != now:
            now, state = own, group["_open"][0]
        done.append({"_key": own[0], "_node": group["_node"][0], "_open": state})
        at = int(np.searchsorted(group["_entry"], state))
        # without such an entry the window open on arrival outlasts the node's hits
        if at < len(group["_entry"]):
            state = group["_exit"][at]
        if len(done) > ROWS:
            yield pd.DataFrame(done)
            done = []
    if done:
        yield pd.DataFrame(done)


def entry_values(entries: DataFrame, opened: DataFrame | None, width: int, nodes: int, fan: int = 0) -> DataFrame:
    """(_key, _node, _open): the value with which each node is entered.

    ``entries``: _key, _node, _entry, _exit, with ``_node`` from 0 to ``nodes - 1`` in the order of time.  ``opened``:
    _key, _open of keys that start with an open window; -1 stands for none.
    """
    fan = fan or FAN
    kind = entries.schema["_key"].dataType.simpleString()
    order = ["_key", "_parent", "_node", "_entry"]
    levels, height = [entries], nodes
    while height > fan:
        levels[-1] = checkpoint(levels[-1])  # read on the way up and on the way down
        dealt = levels[-1].withColumn("_parent", F.floor(F.col("_node") / fan).cast("bigint"))
        dealt = dealt.repartition("_key", "_parent").sortWithinPartitions(*order)
        schema = f"_key {kind}, _node bigint, _entry bigint, _exit bigint"
        levels.append(dealt.select("_key", "_parent", "_node", "_entry", "_exit").mapInPandas(_climb(width), schema))
        height = -(-height // fan)
    closed = F.lit(-1).cast("bigint")
    states = None if opened is None else opened.select("_key", F.lit(0).cast("bigint").alias("_parent"), "_open")
    for level in reversed(levels):
        level = level.withColumn("_parent", F.floor(F.col("_node") / fan).cast("bigint"))
        if states is None:
            dealt = level.withColumn("_open", closed)
        else:
            dealt = level.join(states, ["_key", "_parent"], "left").withColumn("_open", F.coalesce("_open", closed))
        dealt = dealt.repartition("_key", "_parent").sortWithinPartitions(*order)
        dealt = dealt.select("_key", "_parent", "_node", "_entry", "_exit", "_open")
        found = dealt.mapInPandas(_descend, f"_key {kind}, _node bigint, _open bigint")
        states = found.withColumnRenamed("_node", "_parent")
    return found


def anchored_hits(
    hits: DataFrame,
    key: str,
    time: str,
    tie: str,
    width: int,
    tie_granule: Column,
    carry: DataFrame | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """Add ``window_start``, ``hit_count`` and ``reset_seconds`` to every hit.

    ``time`` is a timestamp; ``tie`` orders hits of the same time.  ``carry`` holds the open
    windows of earlier input: key, carry_start (microseconds), carry_count.

    ``chunk`` (seconds) bounds what one task holds: the distinct times of one key in one
    chunk.  Shorter chunks need less memory, longer ones leave fewer functions to compose.
    Hits without a key or a time are not counted.
    """
    micros = width * 1_000_000
    span = (chunk or max(width * 16, 86_400)) * 1_000_000
    stamped = hits.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    key_type = hits.schema[key].dataType.simpleString()
    counted = stamped.groupBy(F.col(key).alias("_key"), "_t").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_chunk", F.floor(F.col("_t") / span).cast("bigint"))
    ends = stamped.select(F.floor(F.col("_t") / span).cast("bigint").alias("_chunk"))
    first, last = ends.agg(F.coalesce(F.min("_chunk"), F.lit(0)), F.coalesce(F.max("_chunk"), F.lit(0))).first()
    nodes = last - first + 1

    def summarize(group: dict) -> dict:
        ts = group["_t"]
        size = len(ts)
        following = np.searchsorted(ts, ts + micros)
        last = np.where(following < size, following, np.arange(size))
        while True:  # doubling: each round squares how far the chain of windows is followed
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        ends = ts[last] + micros
        # an open window lets in one of the hits of its width, or the first hit after that
        able = int(np.searchsorted(ts, ts[0] + micros)) + 1
        entry, ends = ts[:able], ends[:able]
        # exits never decrease with the entry, so a run of equal exits needs only its last entry
        keep = np.append(ends[1:] != ends[:-1], True)
        return {"_key": group["_key"][0], "_node": group["_chunk"][0] - first, "_entry": entry[keep], "_exit": ends[keep]}

    entries = map_groups(
        counted.select("_key", "_chunk", "_t"),
        ["_key", "_chunk"],
        ["_t"],
        f"_key {key_type}, _node bigint, _entry bigint, _exit bigint",
        summarize,
    )
    opened = None
    if carry is not None:
        opened = carry.select(F.col(key).alias("_key"), (F.col("carry_start") + micros).alias("_open"))
    states = entry_values(entries, opened, micros, nodes).withColumn("_chunk", F.col("_node") + first)
    states = states.select("_key", "_chunk", "_open")

    def place(group: dict) -> dict:
        ts, opened = group["_t"], group["_open"][0]
        starts = np.empty(len(ts), dtype="int64")
        at = 0
        if opened >= 0:
            at = int(np.searchsorted(ts, opened))
            starts[:at] = opened - micros
        while at < len(ts):
            end = int(np.searchsorted(ts, ts[at] + micros))
            starts[at:end] = ts[at]
            at = end
        return {"_key": group["_key"][0], "_t": ts, "_n": group["_n"], "_start": starts}

    placed = map_groups(
        counted.join(states, ["_key", "_chunk"]).select("_key", "_chunk", "_t", "_n", "_open"),
        ["_key", "_chunk"],
        ["_t"],
        f"_key {key_type}, _t bigint, _n bigint, _start bigint",
        place,
    )
    slice_of_window = F.floor((F.col("_t") - F.col("_start")) / max(micros // 64, 1))
    summed = running_total(placed, ["_key", "_start"], ["_t"], slice_of_window, "_n", "_sum")
    if carry is not None:
        before = carry.select(
            F.col(key).alias("_key"), F.col("carry_start").alias("_start"), F.col("carry_count").alias("_before_count")
        )
        summed = summed.join(before, ["_key", "_start"], "left").withColumn(
            "_sum", F.col("_sum") + F.coalesce("_before_count", F.lit(0))
        )
    summed = summed.select(F.col("_key").alias(key), "_t", "_start", (F.col("_sum") - F.col("_n")).alias("_earlier"))
    numbered = ranked(stamped, [key, "_t"], [tie], tie_granule, "_rn").join(summed, [key, "_t"])
    left = F.ceil((F.col("_start") + micros - F.col("_t")) / 1_000_000).cast("long")
    return numbered.select(
        *hits.columns,
        F.timestamp_micros("_start").cast(hits.schema[time].dataType).alias("window_start"),
        (F.col("_earlier") + F.col("_rn")).alias("hit_count"),
        F.greatest(left, F.lit(1)).alias("reset_seconds"),
    )


def open_windows(counted: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """Windows that may still take hits after the newest hit seen: (key, carry_start, carry_count)."""
    newest = counted.select(F.max(F.unix_micros(F.col(time).cast("timestamp"))).alias("m")).scalar()
    state = counted.groupBy(key).agg(
        F.max(F.struct(F.unix_micros(F.col("window_start").cast("timestamp")).alias("s"), F.col("hit_count").alias("c"))).alias("_w")
    )
    return state.select(key, F.col("_w.s").alias("carry_start"), F.col("_w.c").alias("carry_count")).where(
        F.col("carry_start") + width * 1_000_000 > newest
    )


def over_budget(counted: DataFrame, kind: str, budgets: dict[str, int], default: int) -> DataFrame:
    """Flag hits beyond the budget of their class."""
    limit = F.lit(default)
    for name, value in budgets.items():
        limit = F.when(F.col(kind) == name, value).otherwise(limit)
    return counted.withColumn("over_budget", F.col("hit_count") > limit)
