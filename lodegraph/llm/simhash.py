"""SimHash near-duplicate classes.

A text's shingles are hashed; bit i of its fingerprint is the majority of bit i over the hashes.  Fingerprints are
cut into blocks, and two that differ in few bits agree on all bits of some blocks (pigeonhole): they are joined on
every choice of that many blocks, and the Hamming distance of what meets is verified.

Only distinct fingerprints are joined, so copies cost nothing.  A block key that very many distinct fingerprints
share is not expanded into pairs where there is an exact way without, see ``links``.

Defined results: a null text is empty; a text without words has fingerprint zero and links like any other; a row
without id belongs to its fingerprint's class but gives no class of its own an id; rows that repeat an id share its
class if their texts do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import release, short_batches, slices, stored
from lodegraph.llm.components import components
from lodegraph.session import checkpoint

SEED = 42
#: Shingles whose bits are counted at a time; bounds memory for very long texts.
COUNTED = 50_000
#: Block keys with more distinct fingerprints than this are linked without forming pairs, for one part and two bits.
PAIRED = 32


def grams_of(text: bytes, shingle: int) -> list[bytes]:
    """The shingles of a text in order, repeats included."""
    tokens = text.lower().split()  # of bytes: A-Z only, and the six white space bytes
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: len(tokens) - shingle] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def print_of(grams: list[bytes], words: int = 1) -> list[int]:
    """Fingerprint of shingles in ``words`` 64-bit parts; part k hashes with seed 42 + k."""
    parts = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(grams), COUNTED):
            hashes = [xxhash.xxh64_intdigest(g, SEED + k) for g in grams[at : at + COUNTED]]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        parts.append(int.from_bytes(np.packbits(2 * ones > len(grams), bitorder="little").tobytes(), "little"))
    return parts


def simhash(text: bytes, shingle: int, words: int = 1) -> list[int]:
    return print_of(grams_of(text, shingle), words)


def fingerprints(df: DataFrame, shingle: int, words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, f0, f1, ...) of each row: the 64-bit parts of its fingerprint as signed numbers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = [simhash((x or "").encode(), shingle, words) for x in batch.column(1).to_pylist()]
            parts = np.array(rows, np.uint64).reshape(-1, words).astype(np.int64)
            columns = [pa.array(parts[:, k]) for k in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])
        release()

    short_batches(df.sparkSession)
    names = [f"f{k}" for k in range(words)]
    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} bigint" for n in names)
    out = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(step, schema)
    return out.withColumnRenamed("id", key)


def block_keys(parts: list[str], blocks: int, equal: int) -> Column:
    """One key for each choice of ``equal`` of the ``blocks`` of each 64-bit part, as a hash of choice and bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for part in parts:
        for chosen in combinations(range(blocks), equal):
            mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
            mask -= (mask >> 63) << 64
            keys.append(F.xxhash64(F.lit(len(keys)), F.col(part).bitwiseAND(F.lit(mask))))
    return F.explode(F.array(*keys))


def around(part: str) -> Column:
    """A value and those that differ from it in one bit."""
    flips = [0, *(1 << i for i in range(63)), -(1 << 63)]
    return F.transform(F.array(*(F.lit(m).cast("bigint") for m in flips)), lambda m: F.col(part).bitwiseXOR(m))


def links(
    classes: DataFrame, parts: list[str], bits: int, blocks: int, equal: int, paired: int = PAIRED
) -> DataFrame:
    """Verified links (a, b) between the ``node`` values of distinct fingerprints.

    Complete for ``bits <= blocks - equal`` in the sense that matters for classes: fingerprints at a distance of
    ``bits`` or less are linked directly or by a chain of links.  A block key with up to ``paired`` fingerprints
    gives all its pairs.  In a larger one, for a single part and two bits, fingerprints are linked through the
    values that lie one bit from both (any two at distance two have such a value, and two that share one are at
    distance two at most), which is exact and linear.  For other settings it gives all its pairs, too.
    """
    keyed = classes.select("node", block_keys(parts, blocks, equal).alias("key"))
    shared = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.max("node").alias("last")
    )
    shared = stored(shared.where("n > 1"), "block-keys")
    members = stored(keyed.join(shared.where("n > 2"), "key"), "block-members")
    pairs = shared.select(F.col("first").alias("a"), F.col("last").alias("b"))
    exact = len(parts) == 1 and bits == 2
    few = members.where(F.col("n") <= paired) if exact else members
    left, right = few.select("key", F.col("node").alias("a")), few.select("key", F.col("node").alias("b"))
    pairs = pairs.unionByName(left.join(right, "key").where("a < b").select("a", "b"))
    if exact:
        many = members.where(F.col("n") > paired).select("node").distinct()
        near = many.join(classes, "node").select("node", F.explode(around(*parts)).alias("z"))
        hubs = near.groupBy("z").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = pairs.unionByName(near.join(hubs, "z").select("a", F.col("node").alias("b")))
    pairs = pairs.where("a < b").distinct()
    # the fingerprints come back to what is left, and are verified
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(end), F.struct(*parts).alias(f"{end}_print")), end)
    differ = (F.bit_count(F.col(f"a_print.{p}").bitwiseXOR(F.col(f"b_print.{p}"))) for p in parts)
    return pairs.where(sum(differ, F.lit(0)) <= bits).select("a", "b")


def near_duplicates(
    df: DataFrame,
    shingle: int = 3,
    bits: int = 2,
    blocks: int = 4,
    equal: int = 2,
    words: int = 1,
    key: str = "doc_id",
    text: str = "text",
    paired: int = PAIRED,
) -> DataFrame:
    """(key, f0, ..., component_id) of each row; ``component_id`` is the smallest key reachable over links."""
    parts = [f"f{k}" for k in range(words)]
    prints = checkpoint(fingerprints(df, shingle, words, key, text))
    classes = checkpoint(prints.groupBy(*parts).agg(F.min(key).alias("node")))
    roots = components(links(classes.where("node is not null"), parts, bits, blocks, equal, paired))
    named = classes.join(roots, "node", "left").select(*parts, F.coalesce("root", "node").alias("component_id"))
    # the hot fingerprint of a group of copies is split by the engine's skew handling
    return prints.join(named, parts)
