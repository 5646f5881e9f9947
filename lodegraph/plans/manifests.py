"""Revision manifests and citations: build, digest and verify, row by row over tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.functions.text import producer_parts
from lodegraph.operators import facts

FIELDS = (
    "canonical_graph_hash", "config_hash", "created_at", "extractors", "producer_set_hash", "repository_id",
    "revision_kind", "revision_ref", "revision_value", "sealed_at", "snapshot_id", "snapshot_schema_version",
)


def build(snapshots: DataFrame) -> DataFrame:
    """The manifest columns of each snapshot; ``extractors`` splits each ``name@version``."""
    split = F.transform(
        "producer_version_set",
        lambda p: F.struct(producer_parts(p)["name"].alias("name"), producer_parts(p)["version"].alias("version")),
    )

    def instant(column: str) -> Column:
        return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    return snapshots.select(
        "repository_id", "revision_kind", "revision_value", "revision_ref", "snapshot_id",
        F.col("schema_version").alias("snapshot_schema_version"), split.alias("extractors"), "producer_set_hash",
        "config_hash", "canonical_graph_hash", instant("created_at").alias("created_at"),
        instant("sealed_at").alias("sealed_at"),
    )


# Names of the manifest fields in exported JSON.
JSON_NAMES = {
    "repository_id": "repositoryId", "revision_kind": "revisionKind", "revision_value": "revisionValue",
    "revision_ref": "revisionRef", "snapshot_id": "snapshotId", "snapshot_schema_version": "snapshotSchemaVersion",
    "extractors": "extractors", "producer_set_hash": "producerSetHash", "config_hash": "configHash",
    "canonical_graph_hash": "canonicalGraphHash", "created_at": "createdAt", "sealed_at": "sealedAt",
}


def document() -> Column:
    """Canonical JSON of the manifest columns."""
    return identity.canonical_json(**{JSON_NAMES[f]: F.col(f) for f in FIELDS})


def digest() -> Column:
    return identity.sha256_of(document())


def verify(submitted: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """(submission_id, state, mismatched) of submitted manifests.

    ``submitted``: submission_id, the manifest columns and ``submitted_digest``.  ``stored``: manifest
    columns of sealed snapshots.  ``current``: repository_id, snapshot_id of the current revision.
    Altered content is a mismatch; a match with an older snapshot is superseded.
    """
    names = stored.select(*[F.col(f).alias(f"_s_{f}") for f in FIELDS])
    now = current.select("repository_id", F.col("snapshot_id").alias("_current"))
    marked = submitted.withColumn("_own", F.col("submitted_digest") == digest())
    same = (F.col("repository_id") == F.col("_s_repository_id")) & (F.col("snapshot_id") == F.col("_s_snapshot_id"))
    differing = F.array_sort(
        F.array_compact(
            F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_s_{f}")), F.lit(JSON_NAMES[f])) for f in FIELDS])
        )
    )
    # compared where the contents meet, so that they do not travel to the current revisions
    met = marked.join(names, same, "left").select(
        "submission_id", "repository_id", "_own", "_s_snapshot_id", differing.alias("_differing")
    )
    joined = met.join(now, "repository_id", "left")
    named, differing = F.col("_s_snapshot_id").isNotNull(), F.col("_differing")
    state = (
        F.when(~F.col("_own") | ~named | (F.size(differing) > 0), "mismatch")
        .when(~F.col("_s_snapshot_id").eqNullSafe(F.col("_current")), "superseded")
        .otherwise("verified")
    )
    return joined.select("submission_id", state.alias("state"), F.when(named, F.array_join(differing, ",")).alias("mismatched"))


def verify_citations(citations: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``status``: ready, or the first reason why the cited source cannot be shown.

    ``citations``: snapshot_revision, current_revision, fact_id, path, start_line, end_line,
    sealed_hash.  ``evidence``: fact_id, path, start_line, end_line.  ``sources``: path,
    is_binary, is_image, truncated, line_count, content_hash.
    """
    cited = facts.has_evidence(citations, evidence, ["fact_id", "path", "start_line", "end_line"], "_cited")
    files = sources.withColumn("_there", F.lit(True))
    joined = cited.join(files, "path", "left")
    status = (
        F.when(~F.col("snapshot_revision").eqNullSafe(F.col("current_revision")), "revision-changed")
        .when(~F.col("_cited"), "not-in-evidence")
        .when(F.col("_there").isNull(), "source-gone")
        .when(F.col("is_binary") | F.col("is_image"), "not-text")
        .when(F.col("truncated") | (F.col("end_line") > F.col("line_count")), "outside-content")
        .when(~F.coalesce(F.col("content_hash") == F.col("sealed_hash"), F.lit(False)), "content-differs")
        .otherwise("ready")
    )
    return joined.select(*citations.columns, status.alias("status"))
