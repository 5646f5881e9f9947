"""Byte-level BPE encoding and decoding.

Two forms of one method, the fold of ranked merges over the bytes of distinct words:

* ``encode`` / ``decode`` take DataFrames.  Each task keeps the ids of the distinct words it has met and folds only
  new ones; the ids of a text are those of its words, one after another, and decoding concatenates binary pieces.
* ``Vocabulary`` gives the same fold as Spark higher-order functions over a literal rank map, for columns of words.

The rank map has the size of the vocabulary, whatever the corpus.

Defined results: a null or empty text has no ids and decodes to no bytes.  Every row gives one row, repeated rows
included; other columns than those asked for are ignored.  Words of any length take n log n steps for n bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import release, schema_of, short_batches, slices

#: No token, and no rank.
NOTHING = 1_000_000_000
#: Buckets and slots of the pair table: primes whose product exceeds every key, so that no two keys of a bucket
#: share a slot at every shift.
BUCKETS, SLOTS = 32_749, 131_071
#: Parts of texts whose ids a task remembers, and their longest length; they bound memory, not results.
REMEMBERED, REMEMBERED_CHARS = 450_000, 60

#: Longest word in bytes whose pairs are scanned at each merge; longer ones keep their pairs in a heap.
SCANNED = 64

Rank = Callable[[Column, Column], Column]


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and ranks; a token's rank is its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The id that two neighbouring tokens merge into, for each way to cut a token into two tokens."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    return pairs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def perfect_table(entries: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """Shifts by bucket, then keys and values by slot; the slot of a key is (key * shift of its bucket) mod SLOTS."""
    buckets: dict[int, list[int]] = {}
    for key in entries:
        buckets.setdefault(key % BUCKETS, []).append(key)
    shifts, keys, values = [1] * BUCKETS, [-1] * SLOTS, [NOTHING] * SLOTS
    for bucket, members in sorted(buckets.items(), key=lambda item: (-len(item[1]), item[0])):
        for shift in range(1, SLOTS):
            slots = [key * shift % SLOTS for key in members]
            if len(set(slots)) == len(slots) and all(keys[slot] < 0 for slot in slots):
                break
        else:
            raise ValueError("the vocabulary has more pairs than the table has room for")
        shifts[bucket] = shift
        for key, slot in zip(members, slots, strict=True):
            keys[slot], values[slot] = key, entries[key]
    return shifts, keys, values


class Vocabulary:
    """A vocabulary whose tables are Spark literals."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for {len(missing)} single bytes")
        self.ranks, self.pattern = ranks, pattern
        self.base = max(ranks.values()) + 1
        if self.base**2 > BUCKETS * SLOTS:
            raise ValueError("the vocabulary has too many tokens for the pair table")
        pairs = {left * self.base + right: rank for (left, right), rank in pair_ranks(ranks).items()}
        pieces = [""] * self.base
        for token, rank in ranks.items():
            pieces[rank] = token.hex()
        self.tables = [",".join(map(str, x)) for x in (*perfect_table(pairs), pieces)]

    def using(self, body: Callable[[Rank, Column], Column]) -> Column:
        """``body`` of the rank map and the pieces by id; the tables are constants that stand in the plan once."""
        shifts, keys, values, pieces = (F.split(F.lit(x), ",") for x in self.tables)

        def ranked(shifts: Column, keys: Column, values: Column) -> Rank:
            def rank(left: Column, right: Column) -> Column:
                key = left.cast("bigint") * F.lit(self.base) + right
                slot = (key * F.get(shifts, (key % F.lit(BUCKETS)).cast("int")) % F.lit(SLOTS)).cast("int")
                return F.when(F.get(keys, slot) == key, F.get(values, slot)).otherwise(F.lit(NOTHING))

            return rank

        return let(
            shifts.cast("array<bigint>"),
            lambda s: let(
                keys.cast("array<bigint>"),
                lambda k: let(
                    values.cast("array<int>"), lambda v: let(pieces, lambda p: body(ranked(s, k, v), p))
                ),
            ),
        )

    def encode(self, rank: Rank, word: Column) -> Column:
        """Ids of a word given as the ids of its single bytes, one byte at least.

        The ids stand between two markers; entry i of the ranks belongs to ids i and i + 1.  Each step merges
        the leftmost pair of least rank, and only the ranks on both sides of it change.
        """
        marker = F.array(F.lit(NOTHING))
        ids = F.concat(marker, word, marker)
        inner = F.zip_with(
            F.slice(word, F.lit(1), F.size(word) - 1), F.slice(word, F.lit(2), F.size(word) - 1), rank
        )
        start = F.struct(ids.alias("ids"), F.concat(marker, inner, marker).alias("ranks"))

        def merge(state: Column) -> Column:
            def at(best: Column) -> Column:
                p = best["p"].cast("int")
                m, ids, ranks = best["m"], state["ids"], state["ranks"]
                left, right = F.get(ids, p - 2), F.get(ids, p + 1)
                return F.struct(
                    F.concat(F.slice(ids, F.lit(1), p - 1), F.array(m), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
                    F.concat(
                        F.slice(ranks, F.lit(1), p - 2),
                        F.array(
                            F.when(left == NOTHING, NOTHING).otherwise(rank(left, m)),
                            F.when(right == NOTHING, NOTHING).otherwise(rank(m, right)),
                        ),
                        F.slice(ranks, p + 2, F.size(ids)),
                    ).alias("ranks"),
                )

            least = F.array_min(state["ranks"])
            best = F.struct(least.alias("m"), F.array_position(state["ranks"], least).alias("p"))
            return let(best, at)

        folded = F.aggregate(
            F.slice(word, F.lit(2), F.size(word)),
            start,
            lambda state, _: F.when(F.array_min(state["ranks"]) < NOTHING, merge(state)).otherwise(state),
        )["ids"]
        return F.slice(folded, F.lit(2), F.size(folded) - 2)

    def decode(self, pieces: Column, ids: Column) -> Column:
        """The bytes of ids: their binary pieces, one after another."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


class Encoder(dict):
    """Ids by part of a text, where parts begin at single spaces.

    A cut before a space that is not next to another space is a cut of the split pattern as well, since a run of
    letters, digits or signs takes at most one space and only in front.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.base = max(ranks.values(), default=0) + 1
        self.singles = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {left * self.base + right: rank for (left, right), rank in pair_ranks(ranks).items()}
        self.signs = {x: tuple(self.fold(x.encode())) for x in ".,;:!?"} if b"." in ranks else {}
        self.line_end = tuple(self.fold(b"\n")) if b"\n" in ranks else ()
        self.first: dict[str, tuple[int, ...]] = {}

    def fold(self, word: bytes) -> list[int]:
        """Merge the leftmost pair of least rank until no pair has a rank."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        ranks, pairs, base = self.ranks, self.pairs, self.base
        ids = list(map(self.singles.__getitem__, word))
        if len(ids) <= SCANNED:
            return self.fold_short(ids)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] * base + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] * base + ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            before[k] = i
            if k < n and (r := pairs.get(rank * base + ids[k])) is not None:
                heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := pairs.get(ids[h] * base + rank)) is not None:
                heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def fold_short(self, ids: list[int]) -> list[int]:
        """The same by scanning all pairs, which is faster for a few bytes."""
        get, base = self.pairs.get, self.base
        ranks = [get(a * base + b, NOTHING) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < NOTHING:
            i = ranks.index(rank)
            ids[i] = rank
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(rank * base + ids[i + 1], NOTHING)
            if i:
                ranks[i - 1] = get(ids[i - 1] * base + rank, NOTHING)
        return ids

    def split(self, part: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.fold(word.encode()) for word in self.find(part)))

    def __missing__(self, part: str) -> tuple[int, ...]:
        # a sign after a last letter, and a line end between others than white space, are words of their own
        if part[-1:] in self.signs and part[-2:-1].isalpha():
            return self[part[:-1]] + self.signs[part[-1]]
        if "\n" in part:
            lines = part.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                rest = (self.line_end + self.bare(x) for x in lines[1:])
                return tuple(chain(self[lines[0]], chain.from_iterable(rest)))
        ids = self.split(" " + part)
        if len(part) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def bare(self, word: str) -> tuple[int, ...]:
        """Ids of a part without a space in front."""
        ids = self.first.get(word)
        if ids is None:
            ids = self.split(word)
            if len(self.first) >= REMEMBERED // 8:
                self.first.clear()
            if len(word) <= REMEMBERED_CHARS:
                self.first[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return list(self.split(text))
        first, *rest = text.split(" ")
        return [*self.split(first), *chain.from_iterable(map(self.__getitem__, rest))]


#: The encoder of a Python worker, kept from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row and ``ids``, the token ids of its text."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(*shared.value)
        encoder = _ENCODERS[name]
        for batch in slices(batches, "_text"):
            ids, ends = array("i"), [0]
            for text in batch.column(0).to_pylist():
                ids.extend(encoder.encode(text or ""))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*keep, "ids"])
        release()

    short_batches(df.sparkSession)
    rows = df.select(F.col(text).alias("_text"), *keep)
    return rows.mapInArrow(step, schema_of(df, keep, "ids array<int>"))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded``, the bytes of its ids; null ids have no bytes.

    The binary pieces are a literal that higher-order functions look up by id; an id outside the vocabulary is an
    error.
    """
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    found = let(
        F.split(F.lit(",".join(pieces)), ","),
        lambda table: F.transform(F.col(ids), lambda i: F.element_at(table, i + 1)),
    )
    return df.withColumn("decoded", F.coalesce(F.unhex(F.array_join(found, "")), F.unhex(F.lit(""))))
