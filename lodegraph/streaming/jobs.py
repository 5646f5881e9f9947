"""Structured Streaming jobs.

Counts continue the open windows of the batch before; facts are merged by keyed
state.  A batch that runs again after a failure replaces its own output and
nothing else.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodegraph.streaming.anchored import anchored_hits, open_windows


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def count_hits(
    stream: DataFrame, key: str, time: str, tie: str, width: int, tie_granule: Column, folder: str
) -> StreamingQuery:
    """Anchored window counts of a stream of hits that arrives in time order.

    Each batch continues the windows left open by the batch before.  State holds open
    windows only: one whose time is over is dropped with the next batch.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = f"{folder}/state/batch={number - 1}"
        carry = spark.read.parquet(earlier) if _exists(spark, earlier) else None
        if batch.isEmpty():
            # pass the open windows on
            if carry is not None:
                carry.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
            return
        hits = anchored_hits(batch, key, time, tie, width, tie_granule, carry)
        output = f"{folder}/hits/batch={number}"
        hits.write.mode("overwrite").parquet(output)
        written = spark.read.parquet(output)
        state = open_windows(written, key, time, width)
        if carry is not None:
            # keys without a hit in this batch keep their open window
            newest = written.select(F.max(F.unix_micros(F.col(time).cast("timestamp"))).alias("m")).scalar()
            kept = carry.join(written.select(key).distinct(), key, "left_anti").where(
                F.col("carry_start") + width * 1_000_000 > newest
            )
            state = state.unionByName(kept)
        state.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


class _FirstContent(StatefulProcessor):
    """State of a key: the content that it came with first, and whether another one has been told."""

    def __init__(self, names: list[str]):
        # the content and the number of its rows stand behind the columns to hand on
        self.row, self.content = Row(*names), len(names) - 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "content string, clash boolean")

    def handleInputRows(self, key, rows, timerValues):
        state = self.first.get()
        known, clash = state if state is not None else (None, False)
        told, more, last = [], 0, None
        for row in rows:
            content, n = row[self.content :]
            last, more = row, more + n
            if known is None:
                known = content
                told.append((row, "fact"))
            elif content != known and not clash:
                clash = True
                told.append((row, "conflict"))
        if told:
            self.first.update((known, clash))
        for row, kind in told or [(last, "more")]:
            yield self.row(*row[: self.content], more, kind)
            more = 0

    def close(self) -> None:
        pass


def _once_per_batch(names: list[str], schema: T.StructType):
    """One row and their number for the rows of an Arrow batch with equal text in ``names``, before any shuffle."""

    def step(batches):
        for batch in batches:
            first: dict[tuple, int] = {}
            count: dict[tuple, int] = {}
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
            for i, row in enumerate(zip(*columns, strict=True)):
                first.setdefault(row, i)
                count[row] = count.get(row, 0) + 1
            kept = batch.take(pa.array(list(first.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(list(count.values()), pa.int64())], names=[*kept.schema.names, "_n"])

    return lambda df: df.mapInArrow(step, T.StructType([*schema, T.StructField("_n", T.LongType())]))


class Ingest:
    """The running queries of an ingest."""

    def __init__(self, queries: list[StreamingQuery]):
        self.queries = queries

    def awaitTermination(self) -> None:
        for query in self.queries:
            query.awaitTermination()


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_facts(
    stream: DataFrame, keys: list[str], scalars: list[str], evidence: list[str], folder: str
) -> Ingest:
    """Merge facts that arrive file by file; ``ingested`` reads the result, whatever the batches were.

    A key is stored with its first row; the same key with another scalar, in this or any later batch, is a conflict
    from then on.  A key or a piece of evidence that is stored is not stored again.

    What has been stored is kept as state by key, in the state store's own files below the checkpoint, so a batch
    looks up its own keys and never reads the earlier batches.  The state of a key is one content and one flag; a
    piece of evidence has its state by itself, so no key's evidence is ever in one place.  Copies within a batch are
    combined before they are shuffled.  ``n_rows`` of a fact are the rows that came for it in all batches, replays too.  Files are committed by the sink's log: a batch that runs again after a failure
    replaces its own output.
    """
    spark = stream.sparkSession
    content = F.to_json(F.struct(F.lit(1), *scalars), {"ignoreNullFields": "false"}).alias("_content")
    owner = F.to_json(F.struct(F.lit(1), *keys), {"ignoreNullFields": "false"}).alias("_owner")
    rows = stream.select(*keys, *scalars, content, owner)
    rows = rows.transform(_once_per_batch(["_owner", "_content"], rows.schema)).drop("_owner")
    told = T.StructField("n", T.LongType()), T.StructField("kind", T.StringType())
    kinds = T.StructType([*rows.schema.fields[:-2], *told])
    kept = rows.groupBy(*keys).transformWithState(
        _FirstContent(kinds.names), outputStructType=kinds, outputMode="Append", timeMode="None"
    )
    spans = stream.select(*keys, *evidence).dropDuplicates()

    def started(df: DataFrame, name: str, *parts: str) -> StreamingQuery:
        writer = df.writeStream.format("parquet").option("path", f"{folder}/{name}")
        writer = writer.option("checkpointLocation", f"{folder}/checkpoint-{name}")
        return writer.partitionBy(*parts).trigger(availableNow=True).start()

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings that it starts with
    try:
        return Ingest([started(kept, "facts", "kind"), started(spans, "evidence")])
    finally:
        spark.conf.set(PROVIDER, before)


def ingested(spark: SparkSession, folder: str, keys: list[str]) -> dict[str, DataFrame]:
    """What has been ingested: facts without a conflict, evidence, and the keys in conflict."""
    told = spark.read.parquet(f"{folder}/facts")
    scalars = [c for c in told.columns if c not in (*keys, "n", "kind")]
    # a key has one row of kind fact, and one of kind conflict at most
    merged = told.groupBy(*keys).agg(
        F.first(F.when(F.col("kind") == "fact", F.struct(F.lit(1), *scalars)), ignorenulls=True).alias("_fact"),
        F.max(F.col("kind") == "conflict").alias("_clash"),
        F.sum("n").alias("n_rows"),
    )
    return {
        "facts": merged.where("NOT _clash").select(*keys, *(F.col("_fact")[c].alias(c) for c in scalars), "n_rows"),
        "evidence": spark.read.parquet(f"{folder}/evidence"),
        "conflicts": merged.where("_clash").select(*keys),
    }
