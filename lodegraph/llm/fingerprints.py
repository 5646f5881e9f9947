"""Document fingerprints that tell versions apart: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, long ones into pieces at places that depend on the text around them alone, so that an
edit changes the pieces it touches and no others.  Each piece's digest (with its number among equal pieces) goes into
one cell of each of three parts of a sketch; a cell holds a count and the sums (exclusive or) of digests and of their
checks.  Sketches of two versions subtract cell by cell; what is left holds just the pieces that differ, and cells
that hold a single piece are peeled until none is left.  If peeling fails, the sketch was too small for the
difference, and larger ones are made and tried, up to one that must succeed.

The likeness of two texts is the share of pieces they have in common: ``common / (common + differing)``.

Defined results: a null text is empty; an empty text has no piece, its sketch is zero, and it is like another empty
text by 1 and like any other by 0.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import partitions_for, short_batches, slices

#: Cells of a fingerprint, and how many times more the next larger sketch has.
CELLS, GROWTH = 12, 4
_PARTS = 3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    x = values + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(data: bytes) -> list[bytes]:
    """Paragraphs, cut further after about one space in four, by the two bytes before it and the one after."""
    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    space = np.flatnonzero(_SPACE[b])
    space = space[(space > 1) & (space < len(b) - 1)]
    mark = b[space - 1].astype(np.int64) * 31 + b[space - 2] * 17 + b[space + 1] * 7
    cuts = space[(b[space] == 10) | (mark % 4 == 0)] + 1
    ends = [*cuts.tolist(), len(data)]
    return [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def digests(data: bytes) -> np.ndarray:
    """Digests of the pieces, each with its number among equal ones; all different."""
    found = np.array([xxhash.xxh3_64_intdigest(x) for x in pieces(data)], np.uint64)
    found.sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return mixed(found, 0) + mixed((np.arange(len(found)) - first).astype(np.uint64), 1)


class Sketches:
    """Sketches of several sets of digests, ``cells`` cells each."""

    def __init__(self, count: int, cells: int):
        self.cells, self.part = cells, cells // _PARTS
        self.counts = np.zeros(count * cells, np.int64)
        self.keys = np.zeros(count * cells, np.uint64)
        self.checks = np.zeros(count * cells, np.uint64)

    def places(self, row: np.ndarray, keys: np.ndarray, part: int) -> np.ndarray:
        at = (mixed(keys, 2 + part) % np.uint64(self.part)).astype(np.int64)
        return row * self.cells + part * self.part + at

    def add(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        checks = mixed(keys, 9)
        for part in range(_PARTS):
            at = self.places(row, keys, part)
            np.add.at(self.counts, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def subtract(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.counts = self.counts - other.counts
        out.keys, out.checks = self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of all that was peeled, and by row whether nothing is left; empties the sketches."""
        rows, keys, signs = [], [], []
        while True:
            at = np.flatnonzero(np.abs(self.counts) == 1)
            at = at[self.checks[at] == mixed(self.keys[at], 9)]
            if not len(at):
                break
            # a piece alone in several cells is peeled once
            row, key, sign = at // self.cells, self.keys[at], self.counts[at]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign = row[new], key[new], sign[new]
            self.add(row, key, -sign)
            rows.append(row)
            keys.append(key)
            signs.append(sign)
        left = (self.counts != 0) | (self.keys != 0) | (self.checks != 0)
        done = ~left.reshape(-1, self.cells).any(axis=1)
        empty = [np.zeros(0, np.int64)]
        return (
            np.concatenate(rows or empty), np.concatenate(keys or [np.zeros(0, np.uint64)]),
            np.concatenate(signs or empty), done,
        )

    def hex(self) -> list[str]:
        """One string for each sketch: counts, digest sums and check sums of its cells."""
        cell = np.zeros(len(self.keys), [("count", ">u2"), ("key", ">u8"), ("check", ">u2")])
        cell["count"], cell["key"], cell["check"] = self.counts & 0xFFFF, self.keys, self.checks & np.uint64(0xFFFF)
        data, width = cell.tobytes().hex(), self.cells * cell.itemsize * 2
        return [data[i : i + width] for i in range(0, len(data), width)]


def sketch(sets: list[np.ndarray], cells: int) -> Sketches:
    out = Sketches(len(sets), cells)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    out.add(rows, np.concatenate([*sets, np.zeros(0, np.uint64)]), 1)
    return out


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, what only the first and what only the second holds, by subtracting sketches."""
    out: list = [None] * len(a)
    left, cells = list(range(len(a))), CELLS
    while left:
        rows, keys, signs, done = sketch([a[i] for i in left], cells).subtract(
            sketch([b[i] for i in left], cells)
        ).peel()
        order = np.argsort(rows, kind="stable")
        rows, keys, signs = rows[order], keys[order], signs[order]
        bounds = np.searchsorted(rows, np.arange(len(left) + 1))
        for n, i in enumerate(left):
            if done[n]:
                key, sign = keys[bounds[n] : bounds[n + 1]], signs[bounds[n] : bounds[n + 1]]
                out[i] = key[sign > 0], key[sign < 0]
        left, cells = [i for n, i in enumerate(left) if not done[n]], cells * GROWTH
    return out


def likeness(a: np.ndarray, b: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of pieces in common, given what only one of both holds."""
    differ = len(found[0]) + len(found[1])
    common = (len(a) + len(b) - differ) // 2
    return common / (common + differ) if common + differ else 1.0


def edited(text: str, after: str) -> str:
    """The last third of a text replaced by as much of the beginning of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame, key: str, text: str, step, schema: str) -> DataFrame:
    """Run ``step`` over the rows in descending order of ``key``, each partition followed by the row that comes next.

    The batches have ``_id``, ``_text`` and ``_guest``; a guest is the first row of a later partition, there to be
    looked at only.  Only keys are sampled and counted beforehand; texts are shuffled once.  Rows without a key come
    last; of rows that share one, the order follows a hash of their texts.
    """
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    least = -(2**63)
    order = F.coalesce(F.col(key), F.lit(least))
    width = partitions_for(spark)
    keys = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("k"))
    shares = [i / width for i in range(1, width)]
    cuts = sorted({int(x) for x in keys.approxQuantile("k", shares, 0.1 / width)}) if shares else []
    # part 0 has the largest keys
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("_order"))) if cuts else F.lit(0)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), order.alias("_order"))
    rows = rows.withColumn("_part", part.cast("int"))
    # the first row of each part: one row for each part, however many documents there are
    tie = F.xxhash64(F.coalesce("_text", F.lit("")))
    firsts = rows.groupBy("_part").agg(F.max("_order").alias("_top")).orderBy("_part").collect()
    if not firsts:
        return rows.select("_id", "_text", F.lit(False).alias("_guest"), "_part").mapInArrow(step, schema)
    before = {b["_part"]: a["_part"] for a, b in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)}
    tops = spark.createDataFrame(
        [(f["_top"], f["_part"], before[f["_part"]]) for f in firsts], "_order bigint, _part int, _host int"
    )
    guests = rows.join(F.broadcast(tops), ["_order", "_part"])
    guests = guests.withColumn("_part", F.col("_host")).select("_id", "_text", "_order", "_part")
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    both = both.withColumn("_tie", tie).repartitionById(width, "_part")
    return (
        both.sortWithinPartitions("_part", "_guest", F.desc("_order"), "_tie")
        .select("_id", "_text", "_guest", "_part")
        .mapInArrow(step, schema)
    )


def fingerprint_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its fingerprint and that of its edited text, and how near they are.

    The edited text ends with the beginning of the next document in descending order of ``key``; after the last one
    comes the first.  ``differing_pieces`` counts the pieces by which both versions differ.
    """

    def rows_of(own: list[tuple], after: str, after_digests: np.ndarray) -> pa.RecordBatch:
        texts = [t for _, t, _ in own]
        sets = [d for *_, d in own]
        nexts = [*texts[1:], after]
        changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
        datas = [x.encode() for x in changed]
        changed_sets = [digests(x) for x in datas]
        next_sets = [*sets[1:], after_digests]
        found, beyond = differing(sets, changed_sets), differing(sets, next_sets)
        columns = [
            pa.array([i for i, *_ in own], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in datas]),
            pa.array(sketch(sets, CELLS).hex()),
            pa.array(sketch(changed_sets, CELLS).hex()),
            pa.array(list(map(likeness, sets, changed_sets, found)), pa.float64()),
            pa.array(list(map(likeness, sets, next_sets, beyond)), pa.float64()),
            pa.array([len(a) + len(b) for a, b in found], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        part, closed = None, False
        for batch in slices(batches, "_text", 1_000_000):
            cells = (batch.column(i).to_pylist() for i in range(4))
            for i, t, guest, p in zip(*cells, strict=True):
                if p != part:
                    part, closed = p, False
                if closed:
                    continue  # further rows that share the guest's key
                t = t or ""
                found = digests(t.encode())
                if guest:
                    if waiting:
                        yield rows_of(waiting, t, found)
                    waiting, closed = [], True
                else:
                    waiting.append((i, t, found))
            if len(waiting) > 1:
                # the last row waits for the one after it
                yield rows_of(waiting[:-1], waiting[-1][1], waiting[-1][2])
                waiting = waiting[-1:]

    names = [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        "differing_pieces",
    ]
    kinds = ["bigint", "bigint", "string", "string", "string", "double", "double", "bigint"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return with_next(docs.withColumn(key, F.col(key).cast("bigint")), key, text, step, schema)
