"""Fact tables on storage, and sinks for read models.

Tables are Parquet partitioned by ``snapshot_id``; a snapshot's partition is
written once.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import schemas
from lodegraph.operators import facts


def load_facts(spark: SparkSession, folder: str, *snapshot_ids: str) -> dict[str, DataFrame]:
    """All fact tables, pruned to the partitions of the given snapshots (all when none is given).

    A table that nothing has been written to is empty.
    """
    tables = {}
    for name, schema in schemas.FACT_TABLES.items():
        path = f"{folder}/{name}"
        found = stored_already(spark, path)
        table = spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)
        tables[name] = table.where(F.col("snapshot_id").isin(*snapshot_ids)) if snapshot_ids else table
    return tables


def append_facts(table: DataFrame, folder: str, name: str, identity: list[str]) -> None:
    """Add rows to the partitions of their snapshots; rows that are stored already are not stored again.

    ``identity`` names a row within its snapshot.  A stored row with another content, or two such new rows, are a
    conflict: nothing is written then.  A rerun adds what is missing, so it may follow a failure.  A snapshot is written
    by as many tasks as its new rows need at Spark's advisory partition size, and small snapshots share a task.
    """
    key = ["snapshot_id", *identity]
    rest = [f for f in table.schema if f.name not in key]
    # maps have no order of their own
    cells = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in rest]
    new, content = table.dropDuplicates(key), F.unhex(F.sha2(F.to_json(F.struct(F.lit(1), *cells)), 256))
    both = table.select(*key, content.alias("_content"))
    path = f"{folder}/{name}"
    if stored_already(table.sparkSession, path):
        # no more ids than the table gets folders; a shuffle by snapshot would put a large one into one task
        touched = F.broadcast(table.select("snapshot_id").distinct())
        old = table.sparkSession.read.schema(table.schema).parquet(path).join(touched, "snapshot_id", "left_semi")
        both = both.unionByName(old.select(*key, content.alias("_content")))
        new = new.join(old.select(*key), key, "left_anti")
    clash = both.groupBy(*key).agg(F.min("_content").alias("a"), F.max("_content").alias("b")).where("NOT a <=> b")
    if first := clash.select(*key).first():
        raise ValueError(f"{name}: rows with one identity differ, such as {first.asDict()}")
    new.hint("rebalance", F.col("snapshot_id")).write.mode("append").partitionBy("snapshot_id").parquet(path)


def stored_already(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def merge_batches(batches: list[DataFrame], keys: list[str], scalars: list[str], evidence: list[str]):
    """Producer batches as one consolidated set: (facts, evidence, conflicts)."""
    return facts.consolidate(reduce(lambda a, b: a.unionByName(b), batches), keys, scalars, evidence)


def purge(table: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The table without the facts of failed snapshots."""
    return table.join(snapshots.where("state = 'failed'").select("snapshot_id"), "snapshot_id", "left_anti")


def orphans(stored: DataFrame, known: DataFrame, key: str, size: str) -> DataFrame:
    """Stored folders that no repository names, with their bytes."""
    return (
        stored.join(known.select(key).distinct(), key, "left_anti")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    )


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row in column ``value``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def markdown_table(rows: DataFrame, section: int, columns: list[str], order: list[Column]) -> DataFrame:
    """(section, position, line): header, rule and one line per row.

    ``position`` is the sort value of the row itself, so numbering needs no global window.
    """
    spark = rows.sparkSession
    header = "| " + " | ".join(columns) + " |"
    rule = "| " + " | ".join("---" for _ in columns) + " |"
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    body = rows.select(
        F.lit(section).alias("section"),
        F.lit(2).alias("part"),
        F.to_json(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("position"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"),
    )
    return markdown_lines(spark, section, [header, rule]).unionByName(body)


def markdown_lines(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    """Fixed lines at the head of a section."""
    parts = [
        spark.range(1).select(
            F.lit(section).alias("section"), F.lit(1).alias("part"), F.lit(f"{i:04d}").alias("position"), F.lit(t).alias("line")
        )
        for i, t in enumerate(lines)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def markdown_bullets(rows: DataFrame, section: int, text: str) -> DataFrame:
    return rows.select(
        F.lit(section).alias("section"),
        F.lit(3).alias("part"),
        F.col(text).alias("position"),
        F.concat(F.lit("- "), text).alias("line"),
    )


def write_markdown(lines: DataFrame, folder: str) -> None:
    """Write lines in report order; the files of the folder concatenate to the document."""
    lines.orderBy("section", "part", "position").select("line").write.mode("overwrite").text(folder)
