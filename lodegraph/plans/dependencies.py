"""Dependency graph read model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.operators import summaries
from lodegraph.plans.architecture import MANIFESTS


def dependency_nodes(declarations: DataFrame) -> DataFrame:
    """(dep_key, name, version, type, declarations) of declared dependencies.

    ``declarations``: dep_key, name, version, dependency_type, manifest_path, start_line.
    A version is given only when all declarations agree on it; null counts as a value.
    """
    rows = declarations.where("manifest_path IS NOT NULL AND manifest_path <> ''")
    return rows.groupBy("dep_key").agg(
        F.coalesce(F.min(F.struct("manifest_path", "start_line", "name"))["name"], F.first("dep_key")).alias("name"),
        summaries.single_or_null("version").alias("version"),
        summaries.single_or("dependency_type", "multiple").alias("type"),
        F.count(F.lit(1)).alias("declarations"),
    )


def dependency_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``depends_on`` edges whose target is a declared dependency."""
    wanted = edges.where("predicate = 'depends_on'")
    return wanted.join(nodes.select(F.col("dep_key").alias("object_key")), "object_key", "left_semi").select(
        "edge_id", F.col("subject_key").alias("source"), F.col("object_key").alias("target")
    )


def manifest_diagnostics(diagnostics: DataFrame, codes: tuple, names: tuple = MANIFESTS) -> DataFrame:
    """Diagnostics of the given codes about a manifest file."""
    return diagnostics.where(F.col("code").isin(*codes) & paths.basename("path").isin(*names))


def totals(nodes: DataFrame, declarations: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Dependency count, and the number of distinct manifests over declarations and diagnostics."""
    manifests = (
        declarations.select("manifest_path")
        .union(diagnostics.select("path"))
        .where("manifest_path IS NOT NULL AND manifest_path <> ''")
        .agg(F.countDistinct("manifest_path").alias("n"))
    )
    return nodes.agg(F.count(F.lit(1)).alias("dependencies")).withColumn("manifests", manifests.scalar())
