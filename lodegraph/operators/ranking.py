"""Positions and running totals inside a key, without putting a key into one task.

A window over ``partitionBy(key)`` sends every row of a hot key to one task.
Here a key is cut into *granules*: ordered slices of the sort column (a day, a
block of ids).  Granule counts are aggregated first (map-side combined), their
running total gives each granule its offset, and the window then only runs
inside one granule.  The result equals the plain window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import checkpoint


def _with_offsets(df: DataFrame, keys: list[str], granule: Column, measure: Column) -> DataFrame:
    # Struct equality treats nulls as equal, so null keys keep their rows.
    rows = df.withColumn("_k", F.struct(*keys, granule.alias("_g")))
    sizes = rows.groupBy("_k").agg(measure.alias("_n"))
    before = (
        Window.partitionBy(*[F.col(f"_k.{k}") for k in keys])
        .orderBy(F.col("_k._g"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select("_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_k")


def ranked(df: DataFrame, keys: list[str], order: list, granule: Column, out: str = "rn") -> DataFrame:
    """Add the 1-based position of each row inside its key.

    ``granule`` must not decrease along ``order`` and must be null where the
    leading order column is null.
    """
    inside = Window.partitionBy("_k").orderBy(*order)
    return (
        _with_offsets(df, keys, granule, F.count(F.lit(1)))
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_k", "_before")
    )


def running_total(
    df: DataFrame, keys: list[str], order: list, granule: Column, value: str, out: str = "total"
) -> DataFrame:
    """Add the running sum of ``value`` along ``order`` inside each key."""
    inside = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_offsets(df, keys, granule, F.sum(value))
        .withColumn(out, F.sum(value).over(inside) + F.col("_before"))
        .drop("_k", "_before")
    )


def with_slices(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Add ``_slice``, a granule for any sort columns, text included.

    Rows are range-partitioned by (keys, order) and the partition number becomes the
    granule, so a hot key spreads over as many slices as it fills.  The numbers are
    checkpointed because a range partitioning computed twice may cut elsewhere.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(count, *keys, *order).withColumn("_slice", F.spark_partition_id())
    return checkpoint(placed)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, as a map-side combined aggregate."""
    packed = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *columns)).alias("_m")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in columns])


def last_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    packed = F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *columns)).alias("_m")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in columns])
