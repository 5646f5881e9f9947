"""WARC archives: writing records, and reading them back with their segments reassembled.

Archives are text files of Spark's own writer: a record ends with two line ends, which is the separator of lines
there, so that file systems, retries and commits are Spark's.  Payloads are sent with chunked framing, and a block
longer than a segment is written as a first record and continuation records.  Reading splits files at the version
line of records, puts pieces together until a record's stated length is reached (so a payload may hold such a line),
groups continuation records by the id of the record they continue, orders them by segment number, verifies the total
length, and decodes the chunked framing.

Payloads that occur again are written as revisit records that refer to one response, see ``assign_types``.

Defined results: a null payload is empty; rows that repeat an id give a record each; a record whose segments are not
complete, whose length is not as stated or whose framing is broken comes back with ``error`` set and no payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import short_batches, slices

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads from this length on are compared with others.
REVISIT_BYTES = 1000
#: Longest block of a record, and longest chunk of the transfer framing, in bytes.
SEGMENT_BYTES, CHUNK_BYTES = 8192, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def assign_types(df: DataFrame, key: str, payload: str, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``df`` with ``_digest`` (SHA-1), ``_bytes`` and ``_refers``: of rows with equal payloads of at least
    ``min_bytes``, the key of the one with the largest key, and null in that one and in all others."""
    rows = df.withColumn("_digest", F.sha1(payload)).withColumn("_bytes", F.length(payload).cast("bigint"))
    compared = rows.where((F.col("_bytes") >= min_bytes) & F.col(key).isNotNull())
    last = compared.groupBy("_digest").agg(F.max(key).alias("_last"), F.count(F.lit(1)).alias("_n"))
    last = last.where("_n > 1").drop("_n")
    joined = rows.join(last, "_digest", "left")
    refers = F.when((F.col("_bytes") >= min_bytes) & (F.col(key) < F.col("_last")), F.col("_last"))
    return joined.withColumn("_refers", refers).drop("_last")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The payload in chunked framing; None if the framing is broken.  Chunk extensions and trailers are allowed."""
    parts, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        digits = data[at:line].split(b";")[0].strip()
        if line < 0 or not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        size, at = int(digits, 16), line + 2
        if not size:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(data[at : at + size])
        at += size + 2


def _headers(*fields: tuple[str, object]) -> bytes:
    return (VERSION + "".join(f"{n}: {v}\r\n" for n, v in fields if v is not None) + "\r\n").encode()


def records_of(key, url: str | None, payload: bytes, digest: str, refers, nonce: str, segment: int) -> list[bytes]:
    """The records of one row, without the two line ends that close each."""
    name = f"<urn:page:{'' if key is None else key}:{nonce}>"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A") or None
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = "application/http; msgtype=response"
    if refers is not None:
        block = HTTP + b"\r\n"
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE)]
        own += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("Content-Type", kind), ("Content-Length", len(block))]
        return [_headers(*own) + block]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
    if len(parts) > 1:
        first.append(("WARC-Segment-Number", 1))
    out = [_headers(*first, ("Content-Type", kind), ("Content-Length", len(parts[0]))) + parts[0]]
    for n, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", DATE)]
        own += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n)]
        own += [("WARC-Segment-Total-Length", len(block) if n == len(parts) else None), ("Content-Length", len(part))]
        out.append(_headers(*own) + part)
    return out


def write(df: DataFrame, path: str, key: str, url: str, payload: str, segment: int = SEGMENT_BYTES) -> None:
    """Write the rows of ``assign_types`` as compressed archives below ``path``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_payload"):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            records = [r for k, u, p, d, f, n in rows for r in records_of(k, u, p or b"", d, f, n, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    short_batches(df.sparkSession)
    columns = [F.col(key), F.col(url), F.col(payload).alias("_payload"), F.col("_digest"), F.col("_refers")]
    # ids need not be the same when a lost task runs again: what counts is what one task writes
    rows = df.select(*columns, F.substring(F.replace(F.uuid(), F.lit("-")), 1, 16).alias("_nonce"))
    # bytes pass through the text writer as they are
    records = rows.mapInArrow(step, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


#: Header fields in the order of the columns.
TEXTS = ("record-id", "type", "target-uri", "payload-digest", "refers-to", "segment-origin-id")
NAMES = ("record_id", "kind", "target", "digest", "refers_to", "origin", "number", "total", "block")


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, one row each, segments apart."""

    def parse(record: bytes) -> tuple | None:
        """A record that is whole; None if more has to follow."""
        head, middle, block = record.partition(b"\r\n\r\n")
        if not middle:
            return None
        f = _fields(head)
        length = f.get("content-length", "")
        if not length.isdigit():
            return (f.get("warc-record-id"), "broken", *[None] * 7)
        if len(block) < int(length) + 4:
            return None
        numbers = [int(x) if (x := f.get(f"warc-segment-{n}", "")).isdigit() else None for n in ("number", "total-length")]
        texts = [f.get(f"warc-{n}") for n in TEXTS]
        return (*texts, *numbers, block[: int(length)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, None
        mark = VERSION.encode()

        def closed() -> list[tuple]:
            return [] if held is None else [(None, "broken", *[None] * 7)]

        for batch in batches:
            out = []
            for piece, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    out += closed()
                    file, held = name, None
                    if not piece:
                        continue  # before the first record of a file
                # a piece that follows an incomplete record belongs to it, with the mark that cut it off
                held = mark + piece if held is None else held + mark + piece
                if (found := parse(held)) is not None:
                    out.append(found)
                    held = None
            columns = list(zip(*out, strict=True)) if out else [[] for _ in NAMES]
            kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(NAMES))
        if held is not None:
            arrays = [pa.array([c], k) for c, k in zip(closed()[0], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(NAMES))

    pieces = spark.read.option("lineSep", VERSION).text(path)
    # compressed files are not split, so that a task gets a file's pieces in order
    pieces = pieces.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))
    schema = ", ".join(f"{n} {k}" for n, k in zip(NAMES, ["string"] * 6 + ["bigint"] * 2 + ["binary"], strict=True))
    return pieces.mapInArrow(step, schema)


def reassemble(found: DataFrame) -> DataFrame:
    """Records with their continuation records joined: the block whole, or ``error`` where segments are missing.

    Only records in segments are shuffled, by origin; what is gathered for one is one record.
    """
    one = found.where(F.col("number").isNull()).select(*NAMES[:5], "block", F.lit(None).cast("string").alias("error"))
    parts = found.where(F.col("number").isNotNull()).withColumn("origin", F.coalesce("origin", "record_id"))
    part = F.struct("number", "total", "block", *NAMES[1:5])
    joined = parts.groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    numbers = F.transform("parts", lambda p: p["number"])
    last = F.element_at("parts", -1)
    # the bytes of the segments, end to end
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    joined = joined.select("*", block.alias("block")).select(
        F.col("origin").alias("record_id"),
        *(F.element_at("parts", 1)[n].alias(n) for n in NAMES[1:5]),
        "block",
        F.when(numbers != F.sequence(F.lit(1).cast("bigint"), F.size("parts").cast("bigint")), "segments are missing")
        .when(last["total"].isNull(), "the last segment is missing")
        .when(last["total"] != F.length("block"), "the total length is wrong")
        .alias("error"),
    )
    return one.unionByName(joined)


def payloads(found: DataFrame) -> DataFrame:
    """Reassembled records with ``payload``, ``payload_sha1`` and ``error``; revisits have no payload of their own."""

    def body(block: bytes) -> tuple[bytes | None, str | None]:
        head, middle, rest = block.partition(b"\r\n\r\n")
        if not middle:
            return None, "no end of the HTTP header"
        if "chunked" in _fields(head).get("transfer-encoding", "").lower():
            rest = unchunked(rest)
            return rest, None if rest is not None else "the chunked framing is broken"
        return rest, None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block"):
            out = []
            for kind, block, error in zip(*(batch.column(i).to_pylist() for i in (1, 5, 6)), strict=True):
                payload = None
                if error is None and kind == "response":
                    payload, error = body(block or b"")
                elif error is None and kind not in ("revisit", "warcinfo", "request", "metadata", "resource"):
                    error = "not a whole record"
                out.append((payload, payload if payload is None else hashlib.sha1(payload).hexdigest(), error))
            payload, digest, error = zip(*out, strict=True) if out else ([], [], [])
            columns = [*batch.columns[:5], pa.array(payload, pa.binary())]
            columns += [pa.array(digest, pa.string()), pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*NAMES[:5], "payload", "payload_sha1", "error"])

    rows = found.select(*NAMES[:5], "block", "error")
    schema = ", ".join(f"{n} string" for n in NAMES[:5]) + ", payload binary, payload_sha1 string, error string"
    return rows.mapInArrow(step, schema)


def key_of(record_id: str, kind: str = "bigint") -> Column:
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:([^:>]*)", 1), F.lit("")).cast(kind)


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """One row for each response, revisit or fault: key, target, payload_bytes, payload_digest, record_type,
    refers_to, payload and error.  A revisit has the digest of its payload, but neither payload nor length."""
    found = payloads(reassemble(records(spark, path)))
    found = found.where(F.col("kind").isin("response", "revisit") | F.col("error").isNotNull())
    found = found.withColumn("key", key_of("record_id", kind)).withColumn("to", key_of("refers_to", kind))
    return found.select(
        "key",
        "target",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.coalesce("payload_sha1", F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("to").alias("refers_to"),
        "payload",
        "error",
    )


def with_referred_lengths(found: DataFrame) -> DataFrame:
    """Rows of ``read`` (payloads may be left out), where a revisit has the length of the payload it refers to.

    A revisit whose response is missing, or has another digest, gets an error.
    """
    own = found.where("record_type = 'response' and error is null").select(
        F.col("key").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    )
    joined = found.join(own.distinct(), "refers_to", "left")
    lost = (F.col("record_type") == "revisit") & ~F.coalesce(F.col("_digest") == F.col("payload_digest"), F.lit(False))
    return (
        joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes"))
        .withColumn("error", F.coalesce("error", F.when(lost, "the response is missing")))
        .select(found.columns)
    )
