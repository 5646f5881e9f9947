"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.session import scratch_folder

#: Bytes of text that a Python step works on at a time.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def schema_of(df: DataFrame, keep: list[str], added: str) -> T.StructType:
    """The columns ``keep`` of ``df`` and the ``added`` ones."""
    kept = [T.StructField(c, df.schema[c].dataType) for c in keep]
    return T.StructType([*kept, *T.StructType.fromDDL(added)])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that a slice holds about ``limit`` bytes of ``column``.

    A row is never cut; a longer one is a slice of its own.
    """
    for batch in batches:
        start, held = 0, 0
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


#: Rows of the batches that tasks exchange with Python: texts are long, and a batch is held several times over.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches no longer than ``BATCH_ROWS``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give memory that the last task needed back, as Python workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def stream_with_side(side: DataFrame, rows: DataFrame, key: str, partitions: int, step, schema) -> DataFrame:
    """Run ``step`` over both inputs, dealt out by ``key``; of each key the rows of ``side`` come first.

    ``step`` gets Arrow batches with the columns of both inputs (null where an input lacks one) and ``_rank``, which
    is 0 for ``side``.  Nothing gathers a key in memory: Spark sorts each partition and spills if it must.
    """
    both = side.withColumn("_rank", F.lit(0)).unionByName(
        rows.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    short_batches(side.sparkSession)
    dealt = both.repartition(partitions, key).sortWithinPartitions(key, "_rank")
    return dealt.mapInArrow(step, schema)


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below the cluster's checkpoint folder, and read again."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing reads any more, and let Spark drop the shuffles that made them."""
    for df in tables:
        spark, path = df.sparkSession, df.inputFiles()[:1]
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()  # plans that Python still holds keep their shuffles
    tables[0].sparkSession._jvm.System.gc()


#: Numbers of a row in which ``summed`` exchanges arrays.
CUT = 1 << 16


def summed(rows: DataFrame, size: int, step: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of the arrays of ``size`` counts that ``step`` makes from the rows of each task.

    The driver gets ``size`` numbers, whatever the input.
    """
    schema, n = "part int, sums binary", -(-size // CUT)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * CUT, np.uint32)
        counts[:size] = step(batches)
        for i in np.flatnonzero(counts.reshape(n, CUT).any(axis=1)):
            own = counts[i * CUT : (i + 1) * CUT].tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "sums": pa.array([own], pa.binary())})
        release()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(own, np.uint32).astype(np.int64)
        for i, own in sums.items():
            row = {"part": pa.array([i], pa.int32()), "sums": pa.array([own.tobytes()], pa.binary())}
            yield pa.RecordBatch.from_pydict(row)

    short_batches(rows.sparkSession)
    out = np.zeros(n * CUT, np.int64)
    for row in rows.mapInArrow(parts, schema).repartition("part").mapInArrow(total, schema).toArrow().to_pylist():
        out[row["part"] * CUT : (row["part"] + 1) * CUT] = np.frombuffer(row["sums"], np.int64)
    return out[:size]
