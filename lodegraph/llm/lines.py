"""Removal of lines that many documents share.

The 128-bit hashes of the lines found in enough documents are indexed by minimal perfect hash functions, one per
shard of the hash space; the index of a line leads to its fingerprint, its document count and its last document in
three plain arrays.  Documents are dealt into chunks; the distinct lines of a chunk probe the arrays of their shard
once, and what is found returns to the chunk's documents.  Lines themselves are never joined.

A line that a third of all documents share is one row per chunk after the first combine, wherever it goes next.

Defined results: a null text is one empty line; a document's repeated line counts as one document; rows that repeat
an id count each, and all rows with the largest id keep the line; rows without an id are neither counted nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import perfect_hash
from lodegraph.llm.common import partitions_for, schema_of, short_batches, slices, stored, stream_with_side

SPACE = " \t\n\x0b\x0c\r"
#: Documents of a chunk, and indexed lines and probes of a shard, on average.
CHUNK, SHARD, PROBES = 2_000, 50_000, 200_000


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """For each line the hash of its key, or None where the key is too short to count."""
    keys: list[bytes | None] = []
    for line in text.split("\n"):
        key = line.strip(SPACE) if len(line) >= min_chars else ""
        # of bytes, lower() changes A-Z only
        keys.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None)
    return keys


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _chunk_lines(min_chars: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [{*line_keys(x or "", min_chars)} - {None} for x in batch.column(2).to_pylist()]
            sizes = [len(x) for x in found]
            halves = _halves([x for keys in found for x in keys])
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["chunk", "id", "h", "f"],
            )

    return step


def _index(rows: pa.Table) -> pa.Table:
    """The arrays of one shard."""
    h, f = (rows.column(c).to_numpy().astype(np.int64) for c in ("h", "f"))
    keys = _join(h, f)
    sizes, bits = perfect_hash.build(keys)
    at = perfect_hash.Index(sizes, bits)(keys)
    arrays = []
    for values in (f, rows.column("n").to_numpy(), rows.column("last").to_numpy()):
        placed = np.empty(len(keys), np.int64)
        placed[at] = values
        arrays.append(placed.tobytes())
    cells = [[rows.column("shard")[0].as_py()], [sizes.tobytes()], [np.packbits(bits).tobytes()], *([x] for x in arrays)]
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.table(
        [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)],
        names=["shard", "sizes", "bits", "prints", "counts", "lasts"],
    )


def _join(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Both halves of a hash as one key of the perfect hash functions."""
    return h.view(np.uint64) ^ (f.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _probe(min_docs: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, prints, counts, lasts = None, None, None, None, None
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            shards, ranks = get["shard"].to_numpy(), get["_rank"].to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(ranks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
                if a == b:
                    continue
                if ranks[a] == 0:
                    shard = shards[a]
                    sizes = np.frombuffer(get["sizes"][a].as_py(), np.int64)
                    bits = np.unpackbits(np.frombuffer(get["bits"][a].as_py(), np.uint8), count=int(sizes.sum()))
                    index = perfect_hash.Index(sizes, bits.astype(bool))
                    prints, counts, lasts = (
                        np.frombuffer(get[c][a].as_py(), np.int64) for c in ("prints", "counts", "lasts")
                    )
                    continue
                if shards[a] != shard:
                    continue  # no line of this shard is found often
                h, f = (get[c].slice(a, b - a).to_numpy() for c in ("h", "f"))
                at = index(_join(h, f))
                hit = (at >= 0) & (prints[at] == f) & (counts[at] >= min_docs)
                rows = pa.array(np.flatnonzero(hit) + a)
                yield pa.RecordBatch.from_arrays(
                    [get["chunk"].take(rows), get["h"].take(rows), get["f"].take(rows), pa.array(lasts[at[hit]])],
                    names=["chunk", "h", "f", "last"],
                )

    return step


def _drop(min_chars: int, keep: list[str]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, lasts = None, {}
        for batch in slices(batches, "_text"):
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ranks = get["_rank"].to_numpy()
            lines = np.flatnonzero(ranks == 0)
            rows = np.flatnonzero(ranks == 1)
            out: list[tuple[int, int, str]] = []
            chunks = get["chunk"].to_pylist()
            if len(lines):
                at = pa.array(lines)
                pairs = np.stack([get[c].take(at).to_numpy() for c in ("h", "f")], axis=1).astype("<i8")
                digests, last = [x.tobytes() for x in pairs], get["last"].take(at).to_pylist()
            texts, ids = get["_text"].to_pylist(), get["_id"].to_pylist()
            seen = 0
            for row in range(batch.num_rows):
                if chunks[row] != chunk:
                    chunk, lasts = chunks[row], {}
                if ranks[row] == 0:
                    lasts[digests[seen]] = last[seen]
                    seen += 1
                    continue
                text = texts[row] or ""
                if not lasts or ids[row] is None:
                    out.append((text.count("\n") + 1, 0, text))
                    continue
                kept, dropped = [], 0
                for line, key in zip(text.split("\n"), line_keys(text, min_chars), strict=True):
                    if key is not None and lasts.get(key, ids[row]) != ids[row]:
                        dropped += 1
                    else:
                        kept.append(line)
                out.append((len(kept) + dropped, dropped, "\n".join(kept)))
            at = pa.array(rows)
            columns = [get[f"_{i}_keep"].take(at) for i in range(len(keep))]
            columns += [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)]
            columns.append(pa.array([x[2] for x in out], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_lines", "n_dropped", "kept_text"])

    return step


def drop_frequent_lines(
    df: DataFrame, keep: list[str], min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns ``keep`` of each row, ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines whose key has ``min_chars`` code points and occurs in ``min_docs`` documents stay in the document with
    the largest id only.  A key is the line without white space at its ends and with A-Z in lower case.
    """
    spark = df.sparkSession
    short_batches(spark)
    width = partitions_for(spark)
    chunks = df.count() // CHUNK + 1
    kept = [F.col(c).alias(f"_{i}_keep") for i, c in enumerate(keep)]
    chunk = F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int").alias("chunk")
    docs = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), *kept).select(chunk, "*")
    kind = df.schema[key].dataType.simpleString()

    lines = docs.where("_id is not null").select("chunk", "_id", "_text")
    lines = lines.mapInArrow(_chunk_lines(min_chars), f"chunk int, id {kind}, h bigint, f bigint")
    lines = lines.groupBy("chunk", "h", "f").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    lines = stored(lines, "chunk-lines")

    often = lines.groupBy("h", "f").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    often = stored(often.where(F.col("n") >= min_docs), "frequent-lines")
    # neither the arrays nor the probes of a shard grow with the corpus
    shards = max(often.count() // SHARD, lines.count() // PROBES) + 1
    shard = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    arrays = often.select(shard, "*").groupBy("shard").applyInArrow(
        _index, "shard int, sizes binary, bits binary, prints binary, counts binary, lasts binary"
    )
    probes = lines.select(shard, "chunk", "h", "f")
    hits = stream_with_side(
        arrays, probes, "shard", width, _probe(min_docs), "chunk int, h bigint, f bigint, last bigint"
    )
    schema = schema_of(df, keep, "n_lines bigint, n_dropped bigint, kept_text string")
    return stream_with_side(hits, docs, "chunk", width, _drop(min_chars, keep), schema)
