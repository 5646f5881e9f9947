"""Precision and recall over multisets of facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.operators.ranking import ranked


def match_counts(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fn and fp per key: both sides are stacked and counted, so there is no join."""
    stacked = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    )
    sums = stacked.groupBy(*keys).agg(F.sum("_e").alias("expected"), F.sum("_a").alias("actual"))
    return sums.select(
        *keys,
        F.least("expected", "actual").alias("tp"),
        F.greatest(F.col("expected") - F.col("actual"), F.lit(0)).alias("fn"),
        F.greatest(F.col("actual") - F.col("expected"), F.lit(0)).alias("fp"),
    )


def label_rows(
    expected: DataFrame, actual: DataFrame, keys: list[str], order: str, granule: Column, columns: list[str]
) -> DataFrame:
    """One row per expected (TP or FN) and per surplus actual (FP) occurrence.

    The first occurrences of a key on each side are the matched ones.
    """
    # a struct compares nulls as equal, so rows with null keys stay
    tp = match_counts(expected, actual, keys).select(F.struct(*keys).alias("_key"), "tp")

    def numbered(side: DataFrame) -> DataFrame:
        placed = ranked(side, keys, [F.col(order)], granule, "_rn")
        return placed.withColumn("_key", F.struct(*keys)).join(tp, "_key")

    left = numbered(expected).withColumn("label", F.when(F.col("_rn") <= F.col("tp"), "TP").otherwise("FN"))
    right = numbered(actual).where(F.col("_rn") > F.col("tp")).withColumn("label", F.lit("FP"))
    return left.select(*keys, *columns, "label").unionByName(right.select(*keys, *columns, "label"))


def counts_by(labels: DataFrame, *dimensions: str) -> DataFrame:
    """TP and FN counted by the expected row's dimension, FP by the actual row's."""
    return labels.groupBy(*dimensions).agg(
        F.count_if(F.col("label") == "TP").alias("tp"),
        F.count_if(F.col("label") == "FN").alias("fn"),
        F.count_if(F.col("label") == "FP").alias("fp"),
    )


def precision_recall(counts: DataFrame, threshold: tuple[int, int] = (95, 100)) -> DataFrame:
    """Precision and recall as exact fractions; an empty denominator scores 1.

    The threshold is compared by cross-multiplication, never as a rounded float.
    """
    top, bottom = threshold
    found, wanted = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")

    def passes(denominator: Column) -> Column:
        return (denominator == 0) | (F.col("tp") * bottom >= denominator * top)

    return counts.select(
        "*",
        F.when(found == 0, 1.0).otherwise(F.col("tp") / found).alias("precision"),
        F.when(wanted == 0, 1.0).otherwise(F.col("tp") / wanted).alias("recall"),
        passes(found).alias("precision_ok"),
        passes(wanted).alias("recall_ok"),
    )


def citation_validity(citations: DataFrame, files: DataFrame, producers: DataFrame) -> DataFrame:
    """Add ``reason``, null for a valid citation; the first broken rule is named.

    ``citations``: path, start_line, end_line, granularity, extractor, extractor_version.
    ``files``: path, line_count, and state (text, binary or malformed).  ``producers``: producer.
    """
    stored = files.select("path", F.col("line_count").alias("_lines"), F.col("state").alias("_state"))
    known = producers.select("producer").distinct().withColumn("_known", F.lit(True))
    joined = (
        citations.withColumn("producer", F.concat_ws("@", "extractor", "extractor_version"))
        .join(known, "producer", "left")
        .join(stored, "path", "left")
    )
    start, end, lines = F.col("start_line"), F.col("end_line"), F.col("_lines")
    named = (F.col("extractor") != "") & (F.col("extractor_version") != "")
    inside = (start >= 1) & (start <= end) & (end <= lines)
    normal = paths.normalize_path("path")
    reason = (
        F.when(~F.coalesce(named, F.lit(False)), "unnamed-producer")
        .when(F.col("_known").isNull(), "undeclared-producer")
        .when(normal.isNull(), "path-escape")
        .when((normal != F.col("path")) | (normal == ""), "path-not-normalized")
        .when(F.col("_state").isNull(), "missing-file")
        .when(F.col("_state") != "text", F.col("_state"))
        .when(~F.coalesce(inside, F.lit(False)), "span-out-of-range")
        .when((F.col("granularity") == "file") & ~((start == 1) & (end == lines)), "not-whole-file")
    )
    return joined.withColumn("reason", reason).drop("_lines", "_state", "_known", "producer")


def validity_ratio(checked: DataFrame) -> DataFrame:
    """Valid citations over all; no citations at all count as fully valid."""
    total, valid = F.count(F.lit(1)), F.count_if(F.col("reason").isNull())
    return checked.agg(valid.alias("valid"), total.alias("total")).withColumn(
        "validity", F.when(F.col("total") == 0, 1.0).otherwise(F.col("valid") / F.col("total"))
    )


def parity_gaps(claimed: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Claimed constructs without a covering fixture."""
    return claimed.select(key).distinct().join(covered.select(key).distinct(), key, "left_anti")


def gate_failures(counts: DataFrame, name: str) -> DataFrame:
    """One row per broken gate: any mismatch, or precision or recall under the threshold."""
    scored = precision_recall(counts)
    checks = F.array(
        F.when((F.col("fn") > 0) | (F.col("fp") > 0), F.lit("exact-match")),
        F.when(~F.col("precision_ok"), F.lit("precision")),
        F.when(~F.col("recall_ok"), F.lit("recall")),
    )
    return scored.select(name, F.explode(F.array_compact(checks)).alias("failure"))
