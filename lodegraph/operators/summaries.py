"""Aggregations over fact tables.

Every aggregate here combines map-side.  Per-group members come out as rows, not
as arrays, unless a constant bounds how many there can be.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.operators.ranking import first_per_key


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def coverage(eligible: DataFrame, covered: DataFrame, key: str, *groups: str) -> DataFrame:
    """Share of distinct eligible keys that are covered; no ratio without eligible keys."""
    base = eligible.select(*groups, key).distinct()
    marked = base.join(covered.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    totals = marked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("denominator"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("numerator")
    )
    return totals.withColumn("ratio", F.try_divide("numerator", "denominator")).withColumn(
        "state", F.when(F.col("denominator") == 0, "insufficient_evidence").otherwise("measured")
    )


def single_or_null(column: str) -> Column:
    """The value if all rows agree, else null; null counts as a value."""
    lo, hi = F.min(F.struct(column)), F.max(F.struct(column))
    return F.when(lo == hi, lo[column])


def single_or(column: str, otherwise: str) -> Column:
    """The value if all rows agree, else a fixed word; null counts as a value."""
    lo, hi = F.min(F.struct(column)), F.max(F.struct(column))
    return F.when(lo == hi, lo[column]).otherwise(otherwise)


def dominant(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per group; on a tie the one whose first row comes first."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    return first_per_key(sizes, keys, [-F.col("_n"), F.col("_first"), F.col(value)], [value])


def first_positions(df: DataFrame, keys: list[str], value: str, position: Column) -> DataFrame:
    """Distinct values per key with the position at which each first occurs."""
    return df.groupBy(*keys, value).agg(F.min(position).alias("first_at"))


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common folder prefix of all paths between two bounds, from ``/``.

    The smallest and greatest segment arrays of a set share exactly the prefix
    that the whole set shares.
    """
    pairs = F.zip_with(low, high, lambda a, b: F.struct(a.alias("value"), (a == b).alias("same")))
    kept = F.aggregate(
        pairs,
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("open")),
        lambda acc, p: F.struct(
            F.when(acc["open"] & F.coalesce(p["same"], F.lit(False)), F.concat(acc["parts"], F.array(p["value"])))
            .otherwise(acc["parts"])
            .alias("parts"),
            (acc["open"] & F.coalesce(p["same"], F.lit(False))).alias("open"),
        ),
    )
    return F.concat(F.lit("/"), F.array_join(kept["parts"], "/"))


def path_prefix(path) -> Column:
    """Aggregate: common prefix of a group's paths."""
    parts = F.split(F.trim(F.col(path), F.lit("/")), "/")
    return common_prefix(F.min(parts), F.max(parts))


def top_level_symbols(symbols: DataFrame) -> DataFrame:
    """(path, symbol): distinct top-level names per file without their ``#n`` suffix."""
    name = F.substring_index("key", "::", -1)
    return (
        symbols.where(F.col("key").contains("::"))
        .select(F.substring_index("key", "::", 1).alias("path"), F.regexp_replace(name, r"#\d+$", "").alias("symbol"))
        .where(~F.col("symbol").contains("."))
        .distinct()
    )


def inventory_totals(files: DataFrame) -> DataFrame:
    """File count, bytes and number of distinct folders."""
    folders = files.select(F.explode(paths.ancestors("path", include_root=False)).alias("folder")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn(
        "folders", folders.select(F.count(F.lit(1)).alias("n")).scalar()
    )


def merge_dependencies(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, members) of declaration and resolution rows under one key.

    ``facts``: dep_key, name, fact_kind, manifest_path, start_line, version, dependency_type.
    The display name comes from the best member: declarations before resolutions,
    then path and line.
    """
    rank = F.when(F.col("fact_kind") == "declaration", 0).otherwise(1)
    members = facts.select(
        "dep_key", "fact_kind", "manifest_path", "start_line", "version", "dependency_type"
    ).distinct()
    best = F.min(F.struct(rank.alias("r"), "manifest_path", "start_line", "name"))
    named = facts.groupBy("dep_key").agg(best.alias("b"))
    sizes = members.groupBy("dep_key").agg(
        F.count_if(F.col("fact_kind") == "declaration").alias("declarations"),
        F.count_if(F.col("fact_kind") == "resolution").alias("resolutions"),
    )
    return named.select("dep_key", F.col("b.name").alias("name")).join(sizes, "dep_key"), members


def zero_filled(spine: list, counted: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Counts for a fixed list of names, zero where absent; the list is a constant of the caller."""
    spark = counted.sparkSession
    names = reduce(lambda a, b: a.unionByName(b), [spark.range(1).select(F.lit(v).alias(key)) for v in spine])
    return names.join(counted, key, "left").select(key, F.coalesce(count, F.lit(0)).alias(count))


def overall_state(state: str) -> Column:
    """Aggregate: one assessment for a group of category states."""
    n = {s: F.count_if(F.col(state) == s) for s in ("assessed", "partially_assessed", "insufficient_evidence", "not_assessed")}
    others = n["partially_assessed"] + n["insufficient_evidence"] + n["not_assessed"]
    return (
        F.when((n["assessed"] > 0) & (others == 0), "assessed")
        .when((n["assessed"] + n["partially_assessed"]) > 0, "partially_assessed")
        .when(n["insufficient_evidence"] > 0, "insufficient_evidence")
        .otherwise("not_assessed")
    )


def degree_heat(edges: DataFrame, nodes: DataFrame, own: Column, degree_share: float = 0.6) -> DataFrame:
    """Heat of a node: its share of the greatest in-degree blended with its own value, at most 1."""
    degree = edges.groupBy(F.col("object_key").alias("stable_key")).agg(F.count(F.lit(1)).alias("dependents"))
    greatest = degree.select(F.max("dependents").alias("m")).scalar()
    joined = nodes.join(degree, "stable_key", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    share = F.col("dependents") / F.greatest(greatest, F.lit(1))
    return joined.withColumn("heat", F.least(F.lit(1.0), share * degree_share + own * (1 - degree_share)))
