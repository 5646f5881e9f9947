"""Session settings and the reliable-checkpoint folder."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that do not depend on the cluster size.  Memory, executor counts and
# spark.checkpoint.dir are left to the cluster's own configuration.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "lodegraph", **conf: str) -> SparkSession:
    """Create a session; ``master`` is only given for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CORE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> None:
    """Make sure that reliable checkpoints have a folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
    local-mode session without that setting gets a fresh temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="lodegraph-checkpoint-")
        context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, shared by all executors."""
    import uuid

    checkpoint_root(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the checkpoint folder and read again; unlike a checkpoint it carries no constraints on."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, key: str | list[str], name: str, distinct: bool = False) -> DataFrame:
    """``df`` stored below the checkpoint folder in buckets of ``key``: joins on the key shuffle their other side only.

    With ``distinct`` equal rows are stored once; they meet in their bucket.
    ``forget`` takes the table's name out of the catalog again; its files stay, like those of ``written``.
    """
    import uuid

    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    keys = [key] if isinstance(key, str) else key
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(buckets, *keys)
    rows = rows.distinct() if distinct else rows
    writer = rows.write.bucketBy(buckets, *keys).option("path", scratch_folder(spark, name))
    writer.format("parquet").saveAsTable(table)
    spark._jvm.System.gc()  # Spark drops a shuffle once nothing holds it: the one that filled the buckets
    found = spark.table(table)
    found.dealt_name = table
    return found


def forget(df: DataFrame) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.dealt_name}")
