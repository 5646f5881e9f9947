"""Filters, projections and joins over fact tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.operators.ranking import first_per_key


def sealed_for_owner(snapshots: DataFrame, owners: DataFrame, owner_key: str, state: str = "completed") -> DataFrame:
    """Sealed snapshots whose owner is among ``owners``; both share ``owner_key``."""
    return snapshots.where(F.col("state") == state).join(owners, owner_key)


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(F.col("node_kind").isin(*kinds))


def neighbours(edges: DataFrame, key: str) -> DataFrame:
    """Edges with the node on either end."""
    return edges.where((F.col("subject_key") == key) | (F.col("object_key") == key))


def endpoint_nodes(nodes: DataFrame, edges: DataFrame, kinds: tuple) -> DataFrame:
    """All nodes of the kinds, plus any other node that an edge touches."""
    ends = edges.select(F.explode(F.array("subject_key", "object_key")).alias("stable_key")).distinct()
    wanted = F.col("node_kind").isin(*kinds)
    return nodes.where(wanted).unionByName(nodes.where(~wanted).join(ends, "stable_key", "left_semi"))


def visible_edges(edges: DataFrame, focus: str | None = None) -> DataFrame:
    """The edges at the focus node; all edges without one."""
    return edges if focus is None else neighbours(edges, focus)


def edge_list(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the names of both ends, in their order; an end without a name goes by its key.

    Edges may come without ids; these are made where the rows have been dealt out, and sorted as bytes, which sort as
    their text does.
    """
    made = "edge_id" not in edges.columns
    named = nodes.select("stable_key", "name")
    for end, out in (("subject_key", "source"), ("object_key", "target")):
        names = named.select(F.col("stable_key").alias(end), F.col("name").alias(out))
        edges = edges.join(names, end, "left").withColumn(out, F.coalesce(out, end))
    if not made:
        return edges.orderBy("source", "target", "edge_id")
    prefix = "edge:sha256:"
    digest = F.substring(identity.edge_id("subject_key", "predicate", "object_key"), len(prefix) + 1, 64)
    # rows of equal names are split by the first digits of their ids, so ranges follow each other as the whole order does
    dealt = edges.repartitionByRange("source", "target", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"))
    listed = dealt.withColumn("_digest", F.unhex(digest)).sortWithinPartitions("source", "target", "_digest")
    return listed.withColumn("edge_id", F.concat(F.lit(prefix), F.lower(F.hex("_digest")))).drop("_digest")


# Severities from the gravest on.
SEVERITIES = ("fatal", "error", "warning", "info")


def diagnostic_list(diagnostics: DataFrame, key: str) -> DataFrame:
    """Diagnostics with ``rank``, gravest first, then by code, place and key."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1
    return diagnostics.withColumn("rank", rank).orderBy("rank", "code", "path", "span_start", key)


def node_list(nodes: DataFrame, order: Column) -> DataFrame:
    """Nodes by the order of their layer, then by name and key; nodes without a layer come last."""
    return nodes.orderBy(order.asc_nulls_last(), "name", "stable_key")


def declared_only(dependencies: DataFrame) -> DataFrame:
    """Dependencies that a manifest declares: a declaration list or, in old rows, a manifest path."""
    return dependencies.where((F.coalesce(F.size("declarations"), F.lit(0)) > 0) | F.col("manifest_path").isNotNull())


def filter_findings(findings: DataFrame, **wanted: str | None) -> DataFrame:
    """AND of the given equalities; None means any."""
    for column, value in wanted.items():
        if value is not None:
            findings = findings.where(F.col(column) == value)
    return findings


def drop_test_only(routes: DataFrame, evidence: DataFrame, key: str, role: str = "role") -> DataFrame:
    """Drop routes whose evidence lies only in test files; routes without evidence stay."""
    real = F.max((~F.col(role).eqNullSafe("test")).cast("int")).alias("_real")
    verdicts = evidence.groupBy(key).agg(real).where("_real = 0").select(key)
    return routes.join(verdicts, key, "left_anti")


def has_evidence(citations: DataFrame, evidence: DataFrame, keys: list[str], out: str = "cited") -> DataFrame:
    """Flag citations whose fact and span occur in the evidence."""
    known = evidence.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return citations.join(known, keys, "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def parent_identity(evidence: DataFrame, parents: list[tuple[str, DataFrame]]) -> DataFrame:
    """Public identity of the parent of each evidence row.

    ``evidence`` has parent_kind and parent_id; each parent table has parent_id and identity.
    """
    tagged = None
    for kind, table in parents:
        part = table.select(F.lit(kind).alias("parent_kind"), "parent_id", "identity")
        tagged = part if tagged is None else tagged.unionByName(part)
    return evidence.join(tagged, ["parent_kind", "parent_id"], "left")


def consolidate(rows: DataFrame, keys: list[str], scalars: list[str], evidence: list[str]):
    """Merge duplicates: (facts, evidence, conflicts).

    Facts carry one value per scalar; evidence is the distinct rows per key, kept
    long so that a key with very many of them stays spread; a key whose rows
    disagree on a scalar is a conflict.
    """
    ends = []
    for name in scalars:
        ends += [F.min(F.struct(name)).alias(f"_lo_{name}"), F.max(F.struct(name)).alias(f"_hi_{name}")]
    merged = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *ends)
    clash = F.lit(False)
    for name in scalars:
        clash = clash | (F.col(f"_lo_{name}") != F.col(f"_hi_{name}"))
    facts = merged.select(*keys, "n_rows", *[F.col(f"_lo_{n}.{n}").alias(n) for n in scalars], clash.alias("_clash"))
    return (
        facts.where("NOT _clash").drop("_clash"),
        rows.select(*keys, *evidence).distinct(),
        facts.where("_clash").select(*keys, "n_rows"),
    )


def support(diagnostics: DataFrame, evidence: DataFrame, key: str = "diagnostic_id") -> DataFrame:
    """First supporting evidence of each diagnostic.

    ``diagnostics``: key, path, span_start, span_end, candidates (fact ids in order of
    preference).  With a span the evidence must match path and lines; without one
    only file-granular evidence of the same path counts.
    """
    order = [F.col("extractor"), F.col("extractor_version")]
    detail = ["extractor", "extractor_version"]
    exact = first_per_key(evidence, ["fact_id", "path", "start_line", "end_line"], order, detail)
    whole = first_per_key(
        evidence.where("granularity = 'file'"),
        ["fact_id", "path"],
        [F.col("start_line"), F.col("end_line"), *order],
        ["start_line", "end_line", *detail],
    )
    options = diagnostics.where("path IS NOT NULL").select(
        key, "path", "span_start", "span_end", F.posexplode("candidates").alias("priority", "fact_id")
    )
    spanned = options.where("span_start IS NOT NULL").select(
        key, "priority", "fact_id", "path", F.col("span_start").alias("start_line"), F.col("span_end").alias("end_line")
    )
    found = spanned.join(exact, ["fact_id", "path", "start_line", "end_line"]).withColumn("support", F.lit("supported"))
    loose = options.where("span_start IS NULL").select(key, "priority", "fact_id", "path").join(whole, ["fact_id", "path"])
    hits = found.unionByName(loose.withColumn("support", F.lit("file_scoped")))
    columns = ["fact_id", "start_line", "end_line", *detail, "support"]
    chosen = first_per_key(hits, [key], [F.col("priority")], columns)
    return diagnostics.join(chosen, key, "left").withColumn("support", F.coalesce("support", F.lit("unsupported")))


def zero_filled_full_outer(declared: DataFrame, observed: DataFrame, key: str, count: str) -> DataFrame:
    """Declared and observed keys side by side; a key never observed counts zero."""
    left = declared.select(key).distinct().withColumn("declared", F.lit(True))
    return left.join(observed, key, "full_outer").select(
        key, F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce(count, F.lit(0)).alias(count)
    )


def current_revision(repositories: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Whether the latest sealed snapshot describes the repository's own revision."""
    joined = repositories.join(latest.withColumnRenamed("revision_value", "_sealed"), key, "left")
    status = (
        F.when(F.col("_sealed").isNull(), "not_available")
        .when(F.col("_sealed").eqNullSafe(F.col("revision_value")), "current")
        .otherwise("outdated")
    )
    return joined.withColumn("status", status).drop("_sealed")


def page(df: DataFrame, order: list[Column], offset: int, limit: int, ceiling: int = 100) -> DataFrame:
    """One page in a total order with the total row count beside it."""
    if not 1 <= limit <= ceiling or offset < 0:
        raise ValueError(f"limit must lie in 1..{ceiling} and offset must not be negative")
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "position") -> DataFrame:
    """First ``n`` rows of each group; Spark prunes to ``n`` per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)
