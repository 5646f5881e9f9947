"""Repository metrics in long form: one row per metric."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import summaries

# Fixed values: (metric id, unit).
METRICS = (
    ("nodes.files.total", "nodes"),
    ("nodes.symbols.total", "nodes"),
    ("nodes.dependencies.total", "nodes"),
    ("relationships.resolved.total", "relationships"),
    ("evidence.records.total", "records"),
    ("diagnostics.relationships.unresolved", "diagnostics"),
    ("diagnostics.relationships.external-references", "diagnostics"),
    ("diagnostics.relationships.local-bindings", "diagnostics"),
    ("diagnostics.relationships.ambiguous", "diagnostics"),
    ("diagnostics.source.unsupported", "diagnostics"),
    ("diagnostics.source.malformed", "diagnostics"),
    ("extraction.files.semantic", "files"),
    ("extraction.files.eligible", "files"),
    ("extraction.coverage", "ratio"),
    ("assessment.vulnerability-scanning", "status"),
)

INVENTORY = "repository-inventory"


def metrics(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, diagnostics: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(id, value, unit, state, numerator, denominator).

    ``unresolved`` is the one-row split of unresolved relationships.  Each fact table
    is aggregated once; the one-row results are then put side by side.
    """
    kind = F.col("node_kind")
    node_counts = nodes.agg(
        F.count_if(kind == "file").alias("files"),
        F.count_if(kind == "symbol").alias("symbols"),
        F.count_if(kind == "dependency").alias("dependencies"),
    )
    code = F.col("code")
    diagnostic_counts = diagnostics.agg(
        F.count_if(code == "RI-RES-AMBIGUOUS").alias("ambiguous"),
        F.count_if(code == "RI-EXT-UNSUPPORTED").alias("unsupported"),
        F.count_if(code == "RI-SRC-MALFORMED").alias("malformed"),
    )
    eligible = nodes.where("node_kind = 'file' AND language IS NOT NULL").select(
        F.regexp_replace("stable_key", "^file:", "").alias("path")
    )
    semantic = evidence.where(F.col("extractor") != INVENTORY).select("path")
    covered = summaries.coverage(eligible, semantic, "path")

    def row(df: DataFrame):
        return df.select(F.struct("*")).scalar()

    # one scalar subquery per aggregated table
    sides = nodes.sparkSession.range(1).select(
        row(node_counts).alias("n"),
        row(edges.agg(F.count(F.lit(1)).alias("all"))).alias("e"),
        row(evidence.agg(F.count(F.lit(1)).alias("all"))).alias("v"),
        row(diagnostic_counts).alias("d"),
        row(unresolved).alias("u"),
        row(covered).alias("c"),
    )
    values = (
        F.col("n.files"),
        F.col("n.symbols"),
        F.col("n.dependencies"),
        F.col("e.all"),
        F.col("v.all"),
        F.col("u.in_repo_gap"),
        F.col("u.external_reference"),
        F.col("u.local_binding") + F.col("u.non_code_asset"),
        F.col("d.ambiguous"),
        F.col("d.unsupported"),
        F.col("d.malformed"),
        F.col("c.numerator"),
        F.col("c.denominator"),
        F.col("c.ratio"),
        F.lit(None),
    )
    measured = F.when(F.col("c.denominator") > 0, "assessed").otherwise("insufficient_evidence")

    def metric(name: str, unit: str, value):
        state = {"ratio": measured, "status": F.lit("not_assessed")}.get(unit, F.lit("assessed"))
        numerator = F.col("c.numerator") if unit == "ratio" else F.lit(None)
        denominator = F.col("c.denominator") if unit == "ratio" else F.lit(None)
        return F.struct(
            F.lit(name).alias("id"),
            value.cast("double").alias("value"),
            F.lit(unit).alias("unit"),
            state.alias("state"),
            numerator.cast("long").alias("numerator"),
            denominator.cast("long").alias("denominator"),
        )

    rows = F.array(*[metric(name, unit, value) for (name, unit), value in zip(METRICS, values)])
    return sides.select(F.inline(rows))


def extractors(producers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name, version, records): declared producers beside those seen in evidence, zero where unseen."""
    from lodegraph.functions.text import producer_parts

    parts = producer_parts(F.col("producer"))
    declared = producers.select(parts["name"].alias("name"), parts["version"].alias("version")).distinct()
    seen = evidence.groupBy(F.col("extractor").alias("name"), F.col("extractor_version").alias("version")).agg(
        F.count(F.lit(1)).alias("records")
    )
    joined = declared.join(seen, ["name", "version"], "full_outer")
    return joined.withColumn("records", F.coalesce("records", F.lit(0)))
