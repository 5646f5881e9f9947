"""Findings: diagnostics that have a rule and a supporting piece of evidence."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.operators import facts, summaries

# Code -> (category, title, remediation).
RULES = {
    "RI-RES-UNRESOLVED": (
        "relationship_resolution",
        "Unresolved relationship",
        "Inspect the referenced name at this source span and make its target explicit or add extractor support"
        " for the construct.",
    ),
    "RI-RES-AMBIGUOUS": (
        "relationship_resolution",
        "Ambiguous relationship",
        "Disambiguate the referenced name at this source span so it resolves to one target.",
    ),
    "RI-EXT-UNSUPPORTED": (
        "source_extraction",
        "Unsupported source construct",
        "Rewrite the recorded construct into a supported form or extend the named extractor before relying on it"
        " for repository relationships.",
    ),
    "RI-SRC-MALFORMED": (
        "source_extraction",
        "Malformed source",
        "Store this source as valid UTF-8 before attempting line-addressed semantic extraction.",
    ),
    "RI-LIMIT-SKIP": (
        "source_extraction",
        "Source excluded by extraction limit",
        "Reduce the file below the configured extraction limit or raise the documented limit and rerun analysis.",
    ),
}

# Product severity of a stored severity, by rank.
SEVERITIES = {"fatal": "critical", "error": "high", "warning": "medium", "info": "info"}
RANKS = ("critical", "high", "medium", "low", "info")

# Category labels in display order.
CATEGORIES = {
    "architecture_boundaries": "Architecture and boundaries",
    "relationship_resolution": "Relationship resolution",
    "source_extraction": "Source extraction",
    "dependency_declarations": "Dependency declarations",
    "security_vulnerability_scanning": "Security vulnerability scanning",
    "authentication_evidence": "Authentication evidence",
    "repository_structure": "Repository structure",
    "analysis_integrity": "Analysis integrity",
}


def with_rules(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics that have a rule, with its category, title and remediation.

    The rule table is the five-row constant above, so it is broadcast.
    """
    rules = diagnostics.sparkSession.createDataFrame(
        [(code, *rule) for code, rule in RULES.items()], "code string, category string, title string, remediation string"
    )
    return diagnostics.join(F.broadcast(rules), "code")


def severity_name(stored) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.element_at(names, F.col(stored))


def severity_rank(name) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col(name)).cast("int") - 1


def build_findings(diagnostics: DataFrame, evidence: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """All findings, unfiltered.

    ``diagnostics``: key, snapshot_id, code, severity, message, producer, path, span_start,
    span_end, candidates.  ``expected``: keys of unresolved diagnostics that are no defect.
    """
    ruled = with_rules(diagnostics).join(expected.select(key), key, "left_anti")
    found = facts.support(ruled, evidence, key).where("support <> 'unsupported'")
    evidence_id = identity.stable_id(
        "evidence",
        identity.canonical_json(
            snapshotId="snapshot_id", factId="fact_id", path="path", startLine="start_line", endLine="end_line",
            extractor="extractor", extractorVersion="extractor_version",
        ),
    )
    located = found.withColumn("evidence_id", evidence_id).withColumn("severity", severity_name("severity"))
    finding_id = identity.stable_id(
        "finding",
        identity.canonical_json(
            snapshotId="snapshot_id", code="code", producer="producer", message="message", factId="fact_id",
            evidenceId="evidence_id",
        ),
    )
    return located.withColumn("finding_id", finding_id).withColumn("rank", severity_rank("severity"))


FINDING_ORDER = ("rank", "category", "path", "start_line", "code", "finding_id")
PAGE_LIMIT = 200


def finding_page(findings: DataFrame, offset: int, limit: int, **wanted: str | None) -> DataFrame:
    """One page of the matching findings in their total order, with the matching total."""
    matched = facts.filter_findings(findings, **wanted)
    return facts.page(matched, [F.col(c) for c in FINDING_ORDER], offset, limit, PAGE_LIMIT)


def category_states(findings: DataFrame, diagnostics: DataFrame, nodes: DataFrame) -> DataFrame:
    """(category, label, state, n) for every category, from the whole snapshot."""
    extraction = [code for code, rule in RULES.items() if rule[0] == "source_extraction"]

    def exists(df: DataFrame) -> Column:
        return df.limit(1).select(F.count(F.lit(1)).alias("n")).scalar() > 0

    has_extraction = exists(diagnostics.where(F.col("code").isin(*extraction)))
    has_dependency = exists(nodes.where("node_kind = 'dependency'"))
    has_file = exists(nodes.where("node_kind = 'file'"))
    states = {
        "architecture_boundaries": F.lit("partially_assessed"),
        "relationship_resolution": F.lit("assessed"),
        "source_extraction": F.when(has_extraction, "partially_assessed").otherwise("assessed"),
        "dependency_declarations": F.when(has_dependency, "partially_assessed").otherwise("insufficient_evidence"),
        "security_vulnerability_scanning": F.lit("not_assessed"),
        "authentication_evidence": F.lit("partially_assessed"),
        "repository_structure": F.when(has_file, "partially_assessed").otherwise("insufficient_evidence"),
        "analysis_integrity": F.lit("assessed"),
    }
    counted = summaries.zero_filled(list(CATEGORIES), summaries.counts(findings, "category"), "category")
    state, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in CATEGORIES:
        state = F.when(F.col("category") == name, states[name]).otherwise(state)
        label = F.when(F.col("category") == name, CATEGORIES[name]).otherwise(label)
    return counted.select("category", label.alias("label"), state.alias("state"), "n")


def headline(categories: DataFrame) -> DataFrame:
    """The category with most findings, the first in display order on a tie; no row without findings."""
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return (
        categories.where("n > 0")
        .orderBy(F.desc("n"), order)
        .limit(1)
        .select(
            "category",
            F.concat(
                F.col("n").cast("string"), F.lit(" "), F.lower(F.substring("label", 1, 1)), F.expr("substring(label, 2)"),
                F.when(F.col("n") == 1, " finding").otherwise(" findings"),
            ).alias("message"),
        )
    )


def summary(findings: DataFrame, diagnostics: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: counts by severity, file-scoped and omitted counts, overall state."""
    counts = findings.agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "info")],
        F.count_if(F.col("support") == "file_scoped").alias("file_scoped"),
    )
    total = diagnostics.select(F.count(F.lit(1)).alias("n")).scalar()
    overall = categories.agg(summaries.overall_state("state").alias("s")).scalar()
    return counts.withColumns({"omitted": total - F.col("findings"), "overall": overall})
