"""How five filters of a corpus act on each other, for every order in which they may be applied.

One pass of the transducer of ``byte_scan`` over a text counts its words, capitals, code points and symbols, and puts
the spans of its words into a verified hash table, which counts the distinct ones.  Which filters a document fails
does not depend on the order, so documents are counted by (part, set of failed filters, labels) first; the orders are
spread over these few counts.

Filters: ``A`` fewer than ``min_words`` words; ``B`` distinct words below ``distinct`` percent of all; ``C`` capitals
A-Z above ``capitals`` percent of the code points; ``D`` one of ``#$%&*|``; ``E`` the text of a smaller id.

Defined results: a null text is empty; an empty text fails A and neither B nor C; a null part is the empty string; a
row without id is nobody's copy and has none; rows that repeat an id count each, and are no copies of each other;
several labels of a document count as one that has what any of them has; a document without labels has neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm import byte_scan
from lodegraph.llm.common import release, short_batches, slices

FILTERS = "ABCDE"
SLICE = 1_000_000


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    text, begin = byte_scan.joined(texts)
    table, n = byte_scan.WordTable(text), len(texts)
    out = {name: np.zeros(n, np.int64) for name in ("words", "distinct", "capitals", "points", "symbols")}
    flags = ("capitals", byte_scan.IS_CAPITAL), ("points", byte_scan.POINT), ("symbols", byte_scan.IS_SYMBOL)
    opened = np.zeros(0, np.int64)
    for at, emitted in byte_scan.blocks(text):
        # a segment is the part of a text that lies in the block
        first = int(np.searchsorted(begin, at, "right")) - 1
        last = int(np.searchsorted(begin, at + len(emitted), "left"))
        cuts = np.maximum(begin[first:last] - at, 0)
        for name, flag in flags:
            out[name][first:last] += np.add.reduceat((emitted & flag) > 0, cuts, dtype=np.int64)
        starts = np.concatenate([opened, np.flatnonzero(emitted & byte_scan.STARTS) + at])
        ends = np.flatnonzero(emitted & byte_scan.ENDS) + at
        starts, opened = starts[: len(ends)], starts[len(ends) :]
        owner = np.searchsorted(begin, starts, "right") - 1
        new = table.insert(owner, starts, ends, byte_scan.word_hashes(text, starts, ends))
        out["words"] += np.bincount(owner, minlength=n)
        out["distinct"] += np.bincount(owner[new], minlength=n)
    out["points"] -= 1  # the space behind each text
    return out


def failures(
    df: DataFrame,
    keep: list[str],
    min_words: int = 100,
    distinct: int = 80,
    capitals: int = 10,
    text: str = "text",
) -> DataFrame:
    """Columns ``keep``, the counts of ``counts_of``, and ``failed``: bit i is set if filter i of A to D fails."""
    names = [f"_{i}_keep" for i in range(len(keep))]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            found = counts_of([x or b"" for x in texts])
            bits = [
                found["words"] < min_words,
                100 * found["distinct"] < distinct * found["words"],
                100 * found["capitals"] > capitals * found["points"],
                found["symbols"] > 0,
            ]
            failed = sum(bit.astype(np.int32) << i for i, bit in enumerate(bits))
            columns = [*batch.columns[1:], *(pa.array(x) for x in found.values()), pa.array(failed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *found, "failed"])
        release()

    short_batches(df.sparkSession)
    kept = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True))
    schema = f"{kinds}, words bigint, distinct bigint, capitals bigint, points bigint, symbols bigint, failed int"
    out = df.select(F.col(text).alias("_text"), *kept).mapInArrow(step, schema)
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def fail_counts(
    df: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text", **limits: int
) -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and set of failed filters, and how many have which label."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = df.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(key).alias("id"),
        digest.alias("digest"),
        F.col(text).alias("text"),
    )
    rows = failures(rows, ["part", "id", "digest"], **limits).select("part", "id", "digest", "failed")
    told = labels.groupBy(F.col(key).alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = rows.join(told, "id", "left")
    good, toxic = (F.coalesce(F.col(c) == 1, F.lit(False)).cast("int") for c in ("q", "t"))
    # rows of one id first, then of one text: what is left of a text is a few rows, however many copies it has
    group = ["digest", "part", "failed", "q", "t"]
    each = rows.withColumns({"q": good, "t": toxic}).groupBy(*group, "id").agg(F.count(F.lit(1)).alias("n"))
    own = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    few = each.groupBy(*group).agg(
        F.sum("n").alias("n"), own.alias("own"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("nameless")
    )
    least = F.min("own.id").over(Window.partitionBy("digest"))
    few = few.withColumn("least", least)
    single = F.when(F.col("own.id") == F.col("least"), F.col("own.n")).otherwise(0) + F.coalesce("nameless", F.lit(0))
    split = F.array(
        F.struct(F.col("failed").alias("set"), single.alias("m")),
        F.struct(F.col("failed").bitwiseOR(F.lit(16)).alias("set"), (F.col("n") - single).alias("m")),
    )
    each = few.select("part", "q", "t", F.inline(split)).where("m > 0")
    return each.groupBy("part", F.col("set").alias("failed")).agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("q")).alias("good"), F.sum(F.col("m") * F.col("t")).alias("toxic")
    )


def over_orders(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the rows of ``fail_counts``; at most 32 rows of a part come in."""
    orders = ["".join(x) for x in permutations(FILTERS)]
    rows = counts.select("*", F.explode(F.array(*(F.lit(x) for x in orders))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    # bits of the filters before a step, and of its own
    letters = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.ascii(F.substring("filter_order", i, 1)) - ord("A"))
    bits = F.transform(letters, lambda x: F.pow(F.lit(2), x).cast("int"))
    rows = rows.withColumn("_bits", bits)
    own = F.element_at("_bits", F.col("step"))
    earlier = F.aggregate(F.slice("_bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x)
    rows = rows.select("*", own.alias("_own"), earlier.alias("_earlier"))
    failing = F.col("failed").bitwiseAND(F.col("_own")) != 0
    gone = F.col("failed").bitwiseAND(F.col("_earlier")) != 0
    here = failing & ~gone

    def total(test, what="n"):
        return F.coalesce(F.sum(F.when(test, F.col(what))), F.lit(0)).cast("bigint")

    # of the orders of all filters, each filter that a document fails comes first among these equally often
    share = F.lit(len(orders)) / F.bit_count("failed")
    shapley = F.coalesce(F.sum(F.when(failing, F.col("n") * share.cast("bigint"))), F.lit(0)).cast("bigint")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~failing & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(failing & gone).alias("redundant"),
        total(F.col("failed") == F.col("_own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Counts of each part, order and step; for the options see ``fail_counts``."""
    return over_orders(fail_counts(df, labels, **options))
