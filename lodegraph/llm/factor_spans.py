"""Removal of word sequences that a document with a smaller id holds, by relative Lempel-Ziv parsing.

Every run of ``window`` words has one anchor, its least hash of ``GRAM`` words, which equal runs share.  A document
falls into pieces: the runs with the same anchor, at most ``2 * window - GRAM`` words.  Anchors that only one document
has are left out.  All other distinct pieces go to the reference block of their anchor, so that a piece meets every
block that may hold one of its runs, and no other one.

A block indexes its pieces by their sorted suffixes.  Each piece is factored greedily from left to right: the next
factor is the longest word sequence that a piece of a smaller id has too.  In the order of the suffixes this is one of
the two nearest suffixes with a smaller id, so a lookup takes no search.  Factors of ``window`` words are spans.  A
shared run that lies in no single factor goes over one boundary, and the second factor reaches its end at least; so
these runs are looked up at boundaries whose factors are long enough together.

Documents are dealt into chunks by a hash of their id.  A chunk sends equal pieces once, with their least id; the
other copies are spans as a whole.  An anchor with more than ``HOT`` pieces (a phrase that a large share of all
documents has, each time among other words) sends single runs, each to the block of its own hash, so no anchor is ever
gathered.  The texts are shuffled once and read from that shuffle three times.

Defined results: a null text has no words; runs are told apart by 64-bit hashes of their words; a sequence that one
document repeats is no span; rows that repeat an id are one document; rows without id lose nothing and nothing is
lost to them.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm import byte_scan
from lodegraph.llm.common import release, schema_of, short_batches

GRAM = 5
#: Bytes of text of a chunk and of pieces of a block, and pieces of an anchor that go to one block.
CHUNK_BYTES, BLOCK_BYTES, HOT = 2_000_000, 4_000_000, 10_000


class Pieces:
    """The words of a chunk's texts, and the pieces that they fall into."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        self.text, begin = byte_scan.joined(texts)
        self.starts, self.ends = byte_scan.spans(self.text)
        self.owner = np.searchsorted(begin, self.starts, "right") - 1
        self.prints = byte_scan.word_hashes(self.text, self.starts, self.ends)
        words, gram = len(self.starts), min(GRAM, window)
        runs = np.arange(max(words - window + 1, 0))
        self.runs = runs[self.owner[runs] == self.owner[runs + window - 1]]
        grams = np.arange(max(words - gram + 1, 0))
        anchors = byte_scan.run_hashes(self.prints, grams, grams + gram)
        least, at = anchors[: len(runs)].copy(), runs.copy()
        for k in range(1, window - gram + 1):  # the first of equal ones stays
            other = anchors[k : k + len(runs)]
            less = other < least
            least[less], at[less] = other[less], runs[less] + k
        at = at[self.runs]
        cut = np.flatnonzero(np.concatenate([[len(at) > 0], at[1:] != at[:-1]]))
        self.window = window
        self.first = self.runs[cut]
        self.last = self.runs[np.append(cut[1:], len(at)) - 1] + window if len(cut) else self.first
        self.key = anchors[at[cut]].view(np.int64)
        self.id = ids[self.owner[self.first]]
        self.print = byte_scan.run_hashes(self.prints, self.first, self.last).view(np.int64)

    def single(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, id) of each run of the chosen pieces."""
        sizes = self.last[chosen] - self.first[chosen] - self.window + 1
        before = np.cumsum(sizes) - sizes
        first = np.repeat(self.first[chosen] - before, sizes) + np.arange(int(sizes.sum()))
        hashes = byte_scan.run_hashes(self.prints, first, first + self.window).view(np.int64)
        return first, hashes, np.repeat(self.id[chosen], sizes)

    def words(self, first: int, last: int) -> bytes:
        return b" ".join(self.text[self.starts[first] : self.ends[last - 1]].split())


def once(key: np.ndarray, print_: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct (key, print) a place with its least id, and the least id for each place."""
    order = np.lexsort((ids, print_, key))
    k, p = key[order], print_[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])])[: len(k)]
    chosen = order[new]
    least = np.empty(len(ids), ids.dtype)
    least[order] = ids[chosen][np.cumsum(new) - 1]
    return chosen, least


def chunk_pieces(rows: pa.Table, window: int) -> Pieces:
    rows = rows.filter(rows.column("_id").is_valid())
    texts = [x or b"" for x in rows.column("_text").cast(pa.binary()).to_pylist()]
    return Pieces(rows.column("_id").to_numpy().astype(np.int64), texts, window)


def _anchors(window: int):
    def step(rows: pa.Table) -> pa.Table:
        own = chunk_pieces(rows, window)
        chosen, _ = once(own.key, own.print, own.id)
        keys, pieces = np.unique(own.key[chosen], return_counts=True)
        at = np.searchsorted(keys, own.key)
        least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, at, own.id)
        np.maximum.at(most, at, own.id)
        several = (least != most) & (pieces > 1)
        chunk = pa.array(np.full(len(keys), rows.column("chunk")[0].as_py(), np.int64))
        return pa.table([chunk, pa.array(keys), pa.array(pieces), pa.array(several)], names=["chunk", "key", "m", "several"])

    return step


def _send(window: int):
    def step(rows: pa.Table, hits: pa.Table) -> pa.Table:
        key, print_, ids, words, chunk = [], [], [], [], 0
        if rows.num_rows and hits.num_rows:
            own, chunk = chunk_pieces(rows, window), rows.column("chunk")[0].as_py()
            hot = hits.column("hot").to_numpy(zero_copy_only=False)
            found = hits.column("key").to_numpy()
            plain = np.flatnonzero(np.isin(own.key, found[~hot]))
            chosen = plain[once(own.key[plain], own.print[plain], own.id[plain])[0]]
            first, hashes, of = own.single(np.flatnonzero(np.isin(own.key, found[hot])))
            runs, _ = once(hashes, hashes, of)
            key = np.concatenate([own.key[chosen], hashes[runs]])
            print_ = np.concatenate([own.print[chosen], hashes[runs]])
            ids = np.concatenate([own.id[chosen], of[runs]])
            begin = np.concatenate([own.first[chosen], first[runs]]).tolist()
            end = np.concatenate([own.last[chosen], first[runs] + window]).tolist()
            words = [own.words(a, b) for a, b in zip(begin, end, strict=True)]
        out = [pa.array(x, pa.int64()) for x in (key, print_, ids, [chunk] * len(key))]
        return pa.table([*out, pa.array(words, pa.binary())], names=["key", "print", "id", "chunk", "words"])

    return step


class ReferenceBlock:
    """Pieces (id, words) of one block, indexed by their sorted suffixes."""

    def __init__(self, ids: np.ndarray, pieces: list[bytes], window: int):
        text, begin = byte_scan.joined(pieces)
        starts, ends = byte_scan.spans(text)
        owner = np.searchsorted(begin, starts, "right") - 1
        _, word = np.unique(byte_scan.word_hashes(text, starts, ends), return_inverse=True)
        # a symbol of its own follows each piece, so no sequence goes from one piece into the next
        place = np.arange(len(word)) + owner
        self.sizes = np.bincount(owner, minlength=len(pieces))
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        symbols = np.empty(len(word) + len(pieces), np.int64)
        symbols[self.begin + self.sizes] = len(word) + np.arange(len(pieces))
        symbols[place] = word
        self.id = np.repeat(ids, self.sizes + 1)
        self.id[self.begin + self.sizes] = np.iinfo(np.int64).max
        # names of the sequences of 1, 2, 4, ... symbols, in the order of the sequences
        self.names, width = [symbols], 1
        while width <= int(self.sizes.max(initial=0)):
            last = self.names[-1]
            after = np.zeros(len(last), np.int64)
            after[: len(last) - width] = last[width:] + 1
            pairs = last * (len(symbols) + len(word) + 2) + after
            self.names.append(np.unique(pairs, return_inverse=True)[1])
            width *= 2
        self.suffix = np.argsort(self.names[-1], kind="stable")
        self.at = np.empty(len(symbols), np.int64)
        self.at[self.suffix] = np.arange(len(symbols))
        in_order = self.id[self.suffix]
        self.above = self._smaller(in_order)
        self.below = len(symbols) - 1 - self._smaller(in_order[::-1])[::-1]

    @staticmethod
    def _smaller(ids: np.ndarray) -> np.ndarray:
        """The last place before each place with a smaller id, or -1."""
        out = np.arange(len(ids)) - 1
        left = np.arange(len(ids))
        while True:
            left = left[out[left] >= 0]
            left = left[ids[out[left]] >= ids[left]]
            if not len(left):
                return out
            # all between a place and ``out`` of it have no smaller id, so this may be followed
            out[left] = out[out[left]]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols two suffixes share at their begin."""
        size = np.zeros(len(a), np.int64)
        end = len(self.suffix)
        for k in range(len(self.names) - 1, -1, -1):
            x, y = a + size, b + size
            in_ = np.maximum(x, y) < end
            same = np.zeros(len(a), bool)
            same[in_] = self.names[k][x[in_]] == self.names[k][y[in_]]
            size[same] += 1 << k
        return size

    def longest(self, places: np.ndarray) -> np.ndarray:
        """The length of the longest sequence from each place on that a piece of a smaller id has."""
        best, rank = np.zeros(len(places), np.int64), self.at[places]
        for other in (self.above[rank], self.below[rank]):
            there = np.flatnonzero((other >= 0) & (other < len(self.suffix)))
            size = self._common(places[there], self.suffix[other[there]])
            best[there] = np.maximum(best[there], size)
        return best

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, place, length) of all factors, by piece and place; a new word is a factor of length 0."""
        piece, place = np.arange(len(self.sizes)), self.begin.copy()
        end, out = self.begin + self.sizes, []
        piece = piece[place < end]
        while len(piece):
            size = self.longest(place[piece])
            out.append((piece, place[piece], size))
            place[piece] += np.maximum(size, 1)
            piece = piece[place[piece] < end[piece]]
        none = np.zeros(0, np.int64)
        piece, start, size = (np.concatenate([none, *(x[i] for x in out)]) for i in range(3))
        order = np.lexsort((start, piece))
        return piece[order], start[order], size[order]

    def shared(self, window: int) -> list[bytes]:
        """For each piece a byte for each word: 1 if the word lies in a run that a smaller id has."""
        piece, start, size = self.factors()
        long = size >= window
        spans = [(start[long], start[long] + size[long])]
        follows = np.flatnonzero(piece[1:] == piece[:-1])
        first, edge = start[follows], start[follows + 1]
        end = edge + np.maximum(size[follows + 1], 1)
        enough = end - first >= window
        first, edge, end = first[enough], edge[enough], end[enough]
        for back in range(1, window):  # runs over a boundary
            run = edge - back
            run = run[(run > first) & (run + window <= end)]
            run = run[self.longest(run) >= window]
            spans.append((run, run + window))
        change = np.zeros(len(self.id) + 1, np.int64)
        for a, b in spans:
            np.add.at(change, a, 1)
            np.add.at(change, b, -1)
        covered = (np.cumsum(change) > 0).astype(np.uint8)
        return [covered[a : a + n].tobytes() for a, n in zip(self.begin.tolist(), self.sizes.tolist(), strict=True)]


def _factor(window: int):
    """Marks of the pieces; they come in by key and print, of equal ones the least id first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, now = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if waiting:
                block = ReferenceBlock(np.array([r[2] for r in waiting], np.int64), [r[4] for r in waiting], window)
                yield marked([(*r[:4], m) for r, m in zip(waiting, block.shared(window), strict=True)])
            waiting.clear()
            size = 0

        def marked(rows: list[tuple]) -> pa.RecordBatch:
            # of a single run the chunk has to know in any case
            rows = [r for r in rows if r[0] == r[1] or any(r[4])]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in (3, 0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[4] for r in rows], pa.binary())], names=["chunk", "key", "print", "mark"])

        for batch in batches:
            copies = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and row[:2] == now[:2] and row[4] == now[4]:
                    copies.append((*row[:4], b"\x01" * (row[4].count(b" ") + 1)))
                    continue
                if size > BLOCK_BYTES and row[0] != now[0]:
                    yield from close()
                now = row
                waiting.append(row)
                size += len(row[4])
            if copies:
                yield marked(copies)
        yield from close()
        release()

    return step


def _remove(window: int, keep: list[str]):
    def step(rows: pa.Table, marks: pa.Table) -> pa.Table:
        named = rows.filter(rows.column("_id").is_valid())
        nameless = rows.filter(rows.column("_id").is_null())
        own = chunk_pieces(named, window)
        change = np.zeros(len(own.starts) + 1, np.int64)

        def cover(first: np.ndarray, last: np.ndarray) -> None:
            np.add.at(change, first, 1)
            np.add.at(change, last, -1)

        # a copy of a piece of a smaller id is a span
        _, least = once(own.key, own.print, own.id)
        copy = own.id > least
        cover(own.first[copy], own.last[copy])
        key, print_ = (marks.column(c).to_numpy() for c in ("key", "print"))
        mark = marks.column("mark").to_pylist()
        single = key == print_
        pieces = {(k, p): m for k, p, m, s in zip(key.tolist(), print_.tolist(), mark, single.tolist(), strict=True) if not s}
        if pieces:
            near = np.flatnonzero(np.isin(own.print, print_[~single]) & ~copy)
            for i, k, p in zip(near.tolist(), own.key[near].tolist(), own.print[near].tolist(), strict=True):
                found = pieces.get((k, p))
                if found is not None:
                    at = np.flatnonzero(np.diff(np.frombuffer(b"\0" + found + b"\0", np.int8))) + own.first[i]
                    cover(at[::2], at[1::2])
        if single.any():
            first, hashes, ids = own.single(np.arange(len(own.first)))
            hot = np.isin(hashes, key[single])
            first, hashes, ids = first[hot], hashes[hot], ids[hot]
            _, least = once(hashes, hashes, ids)
            told = np.array([m[0] > 0 for m, s in zip(mark, single.tolist(), strict=True) if s], bool)
            gone = (ids > least) | np.isin(hashes, key[single][told])
            cover(first[gone], first[gone] + window)
        lost = np.cumsum(change)[:-1] > 0

        texts = named.column("_text").cast(pa.binary()).to_pylist()
        ends = np.searchsorted(own.owner, np.arange(len(texts)), "right").tolist()
        out, begin = [], 0
        for text, end in zip(texts, ends, strict=True):
            words, gone = (text or b"").split(), lost[begin:end]
            n = int(gone.sum())
            places: list = []
            if n:
                at = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                places = [{"start": a, "end": b} for a, b in zip(at[::2], at[1::2], strict=True)]
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            out.append((end - begin, n, places, b" ".join(words)))
            begin = end
        for text in nameless.column("_text").cast(pa.binary()).to_pylist():
            words = (text or b"").split()
            out.append((len(words), 0, [], b" ".join(words)))
        rows = pa.concat_tables([named, nameless])
        place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        columns = [rows.column(f"_{i}_keep") for i in range(len(keep))]
        columns += [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)]
        columns += [pa.array([x[2] for x in out], place), pa.array([x[3] for x in out], pa.binary()).cast(pa.string())]
        return pa.table(columns, names=[*keep, "n_words", "n_removed", "spans", "kept_text"])

    return step


def remove_repeats(
    df: DataFrame, keep: list[str], window: int = 13, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns ``keep`` of each row, ``n_words``, ``n_removed``, ``spans`` of removed words, and ``kept_text``."""
    spark = df.sparkSession
    short_batches(spark)
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    kept = [F.col(c).alias(f"_{i}_keep") for i, c in enumerate(keep)]
    docs = df.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"), *kept)
    place = F.when(F.col("_id").isNull(), F.xxhash64("_text")).otherwise(F.xxhash64("_id"))
    docs = docs.select(F.pmod(place, F.lit(size // CHUNK_BYTES + 1)).alias("chunk"), "*").repartition("chunk")

    anchors = docs.groupBy("chunk").applyInArrow(_anchors(window), "chunk bigint, key bigint, m bigint, several boolean")
    of_key = Window.partitionBy("key")
    anchors = anchors.select(
        "*", F.count(F.lit(1)).over(of_key).alias("chunks"), (F.sum("m").over(of_key) > HOT).alias("hot")
    )
    hits = anchors.where((F.col("chunks") > 1) | F.col("several")).select("chunk", "key", "hot")

    both = docs.groupBy("chunk").cogroup(hits.groupBy("chunk"))
    pieces = both.applyInArrow(_send(window), "key bigint, print bigint, id bigint, chunk bigint, words binary")
    dealt = pieces.repartition("key").sortWithinPartitions("key", "print", "id")
    marks = dealt.mapInArrow(_factor(window), "chunk bigint, key bigint, print bigint, mark binary")

    schema = schema_of(df, keep, "n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string")
    return docs.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_remove(window, keep), schema)
