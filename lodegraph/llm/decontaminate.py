"""Benchmark passages in documents, by q-gram counting in diagonal bands.

A passage of m characters that occurs with at most k edits shares at least ``m - q + 1 - k q`` of its q-grams with
the place where it occurs, all on diagonals (place in the document minus place in the passage) that lie within k of
each other.  Diagonals are cut into overlapping bands that each hold any such run whole; only bands with that many
shared q-grams are aligned, in a band of the alignment matrix, and kept if the alignment costs k edits or less.

Texts are compared in lower case with runs of white space as one space.  Both are mapped to one byte a character
for the filter; that can only add candidates, and the alignment compares code points.

The passages are the stated query set: they are gone through in blocks of bounded size, and each block meets all
documents.  Nothing else is shared with tasks.

Defined results: a null or empty text has no passage; passages of fewer than ``MIN_CHARS`` characters (null and empty
ones too) are too short to tell and are never found; repeated passages are found each; a passage that occurs several
times in a document is reported where it costs least, at the first such place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import short_batches, slices

Q = 8
#: Edits allowed per character of a passage.
EDIT_RATE = 0.1
#: Shortest passage looked for.
MIN_CHARS = 24
#: Characters of passages in a block: the size of what is shared with tasks.
BLOCK_CHARS = 2_000_000
_BITS = 22
_CELLS = 21


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def one_byte(text: str) -> bytes:
    """A byte for each character; characters above 255 share bytes."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return np.where(points < 256, points, points * 167 >> 3 & 255).astype(np.uint8).tobytes()


def grams(data: bytes) -> np.ndarray:
    """The q-grams at all places, as numbers; eight zero bytes are added at the end."""
    padded = data + bytes(Q)
    out = np.empty(len(data), "<u8")
    for shift in range(min(Q, len(data))):
        part = np.frombuffer(padded, "<u8", count=(len(padded) - shift) // 8, offset=shift)
        here = out[shift::8]
        here[:] = part[: len(here)]
    return out


def mixed(values: np.ndarray, bits: int) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Passages:
    """A block of passages with their q-grams."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in self.texts]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        # the budget leaves one q-gram to share at least
        self.budget = np.minimum((lengths * EDIT_RATE).astype(np.int64), (lengths + 1) // Q - 1)
        self.needed = lengths - Q + 1 - self.budget * Q
        self.lengths = lengths
        found = [grams(one_byte(t))[: len(t) - Q + 1] for t in self.texts]
        values = np.concatenate(found)
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found])
        order = np.argsort(values, kind="stable")
        self.item, self.place = item[order], place[order]
        self.values, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[mixed(self.values, _BITS)] = True
        # bands are as wide as twice the largest budget, and each begins in the middle of another
        self.half = int(self.budget.max()) + 1

    def candidates(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, band) with enough shared q-grams; band b holds diagonals b * half up to (b + 2) * half."""
        none = np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[mixed(values, _BITS)])
        slot = np.minimum(np.searchsorted(self.values, values[at]), len(self.values) - 1)
        same = self.values[slot] == values[at]
        at, slot = at[same], slot[same]
        if not len(at):
            return none, none
        times = self.count[slot]
        ends = np.cumsum(times)
        entry = np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(self.first[slot], times)
        item = self.item[entry]
        # lengths and one half are added so that no band is below one
        band = (np.repeat(at, times) - self.place[entry] + self.lengths[item]) // self.half + 1
        stride = int(band.max()) + 2
        keys = item * stride + band
        # counts by a hash of the key are too large at most: they leave few hits to count exactly
        cells = mixed(keys.astype(np.uint64), _CELLS).astype(np.int64)
        rough = np.bincount(cells, minlength=1 << _CELLS)
        sides = [rough[mixed((keys + d).astype(np.uint64), _CELLS).astype(np.int64)] for d in (-1, 1)]
        maybe = rough[cells] + np.maximum(*sides) >= self.needed[item]
        # a q-gram of the passage counts once in a band, however often the text repeats it
        longest = int(self.lengths.max()) + 1
        keys = np.unique(keys[maybe] * longest + self.place[entry[maybe]]) // longest
        keys, times = np.unique(keys, return_counts=True)
        if not len(keys):
            return none, none

        def tally(wanted: np.ndarray) -> np.ndarray:
            slot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[slot] == wanted, times[slot], 0)

        # a band is two half bands: its hits are those of both
        starts = np.unique(np.concatenate([keys, keys - 1]))
        item, band = np.divmod(starts, stride)
        good = tally(starts) + tally(starts + 1) >= self.needed[item]
        return item[good], band[good] - 1

    def align(self, item: int, low: int, width: int, points: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, end) of the cheapest occurrence within the budget on ``width`` diagonals from ``low`` on.

        Column c of row i stands for i characters of the passage against the text up to place low + i + c.
        """
        passage, k = self.points[item], int(self.budget[item])
        steps, far = np.arange(width), k + 1
        text = np.concatenate([[0xFFFFFFFF], points, [0xFFFFFFFF]])
        start = low + steps
        cost = np.where((start < 0) | (start > len(points)), far, 0)
        for i, char in enumerate(passage.tolist(), 1):
            places = low + i + steps
            outside = (places < 0) | (places > len(points))
            best, origin = cost + (text[np.clip(places, 0, len(points) + 1)] != char), start
            # a character of the passage is missing in the text
            gap, source = np.append(cost[1:] + 1, far), np.append(start[1:], 0)
            origin = np.where(gap < best, source, origin)
            best = np.where(outside, far, np.minimum(best, gap))
            # characters of the text are extra: the least cost to the left and its distance
            run = np.minimum.accumulate((best - steps) * width + steps)
            extra = run // width + steps
            start = np.where(extra < best, origin[run % width], origin)
            cost = np.where(outside, far, np.minimum(np.minimum(best, extra), far))
            if cost.min() > k:
                return None
        last = int(cost.argmin())
        return int(cost[last]), int(start[last]), int(low + len(passage) + last)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, edits, start, end) for each passage found in each text."""
        parts, starts, at = [], [], 0
        for text in texts:
            starts.append(at)
            data = one_byte(text)
            parts += [data, bytes(Q)]
            at += len(data) + Q
        items, bands = self.candidates(grams(b"".join(parts)))
        begin = np.array(starts)
        lows = bands * self.half - self.lengths[items]
        # a band lies in one text, or reaches from the end of one into others
        first = np.maximum(np.searchsorted(begin, lows, "right") - 1, 0)
        last = np.searchsorted(begin, lows + 2 * self.half + self.lengths[items], "right") - 1
        places: dict[tuple[int, int], list[int]] = {}
        for item, low, a, b in zip(items.tolist(), lows.tolist(), first.tolist(), last.tolist(), strict=True):
            for row in range(a, b + 1):
                places.setdefault((row, item), []).append(low - starts[row])
        out = []
        for (row, item), diagonals in sorted(places.items()):
            text, k, m = texts[row], int(self.budget[item]), int(self.lengths[item])
            if (exact := text.find(self.texts[item])) >= 0:
                out.append((row, item, 0, exact, exact + m))  # no alignment is cheaper
                continue
            hits = []
            for diagonal in diagonals:
                low, width = diagonal - k, 2 * self.half + 2 * k
                a, b = max(0, low), min(len(text), low + width + m)
                if b - a >= m - k:
                    points = np.frombuffer(text[a:b].encode("utf-32-le"), "<u4")
                    if hit := self.align(item, low - a, width, points):
                        hits.append((hit[0], hit[1] + a, hit[2] + a))
            if hits:
                out.append((row, item, *min(hits)))
        return out


def blocks_of(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The passages in blocks of bounded size, in the order of their ids, read through one block at a time."""
    block, held = [], 0
    rows = benchmark.select(item, text).where(F.length(text) >= MIN_CHARS).orderBy(item, text)
    for row in rows.toLocalIterator():
        passage = normal(row[1])
        if len(passage) < MIN_CHARS:
            continue
        if held and held + len(passage) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row[0], passage))
        held += len(passage)
    if block:
        yield block


def passages_in(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, item, edits, start_word, end_word, passage) for each benchmark passage that a document holds.

    Words are counted from 0 in the document's words; ``passage`` is what stands there, in normal form.
    """
    short_batches(df.sparkSession)
    spark = df.sparkSession
    kinds = df.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, start_word int, end_word int, passage string"
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    item_kind = pa.from_numpy_dtype(np.int64) if kinds[1] == "bigint" else None
    out = spark.createDataFrame([], schema)
    for block in blocks_of(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(block)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = Passages(shared.value)
            for batch in slices(batches, "_text"):
                texts = [normal(x) for x in batch.column(1).to_pylist()]
                hits = passages.find(texts)
                cells = []
                for row, i, edits, a, b in hits:
                    before = texts[row][:a].count(" ")
                    cells.append((row, passages.ids[i], edits, before, before + texts[row][a:b].count(" "), texts[row][a:b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([c[0] for c in cells], pa.int64())),
                        pa.array([c[1] for c in cells], item_kind),
                        *(pa.array([c[i] for c in cells], pa.int32()) for i in (2, 3, 4)),
                        pa.array([c[5] for c in cells], pa.string()),
                    ],
                    names=["id", "item", "edits", "start_word", "end_word", "passage"],
                )

        out = out.unionByName(rows.mapInArrow(step, schema))
    return out.withColumnsRenamed({"id": key, "item": item})
