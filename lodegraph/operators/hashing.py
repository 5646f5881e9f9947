"""Order-independent content hash of whole snapshots.

Each fact becomes one canonical JSON record.  Evidence and derivations are
records of their own that name their parent, so a fact with very many of them
stays spread over tasks.  Distinct record hashes are combined in a fixed tree
over their hex prefix, so that every group is small.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.functions.identity import canonical_json, sorted_struct
from lodegraph.operators.resolve import union_all

# Prefix lengths of the tree levels.  With 16**6 leaves a leaf holds some 60,000 hashes
# for a trillion records; an inner node has at most 16**3 = 4096 children.
LEVELS = (6, 3, 0)


# Records of up to so many bytes go to their leaf as text: that of canonical records takes less room in a shuffle than a hash.
SHORT = 128


def tree_digest(records: DataFrame, keys: list[str], text: str = "record") -> DataFrame:
    """One digest per key over the set of its record texts.

    Records are dealt out once, by the prefix of their hash; repeated ones go where they meet.  Hashes travel as 32 bytes.
    """
    short = F.octet_length(text) <= SHORT
    held = records.select(*keys, F.when(short, F.col(text)).alias("_t"), F.when(~short, F.unhex(F.sha2(text, 256))).alias("_h"))
    own = F.coalesce("_h", F.unhex(F.sha2("_t", 256)))
    leaf = F.substring(F.hex(own), 1, LEVELS[0])
    level = held.repartition(*keys, leaf).withColumn("_p", leaf).distinct().select(*keys, "_p", own.alias("_h"))
    for digits in LEVELS:
        if digits < LEVELS[0]:  # leaves stay where they have been dealt to
            level = level.withColumn("_p", F.substring("_p", 1, digits))
        # bytes sort as their hex text does
        hashes = F.transform(F.sort_array(F.collect_list("_h")), F.hex)
        level = level.groupBy(*keys, "_p").agg(F.unhex(F.sha2(F.lower(F.array_join(hashes, "")), 256)).alias("_h"))
    return level.select(*keys, F.concat(F.lit("sha256:"), F.lower(F.hex("_h"))).alias("digest"))


def graph_records(t: dict[str, DataFrame]) -> DataFrame:
    """(snapshot_id, record) of all facts; ids, times and moving refs take no part."""
    version = F.lit(identity.SCHEMA_VERSION)
    properties = F.map_from_entries(F.array_sort(F.map_entries("properties")))
    nodes = canonical_json(
        keep_nulls=False,
        kind=F.lit("node"),
        language="language",
        name="name",
        node_kind="node_kind",
        properties=F.when(F.size("properties") > 0, properties),
        schema_version=version,
        stable_key="stable_key",
        truth_class="truth_class",
    )
    edges = canonical_json(
        kind=F.lit("edge"),
        edge_id="edge_id",
        subject=sorted_struct(kind="subject_kind", stable_key="subject_key"),
        predicate="predicate",
        object=sorted_struct(kind="object_kind", stable_key="object_key"),
        truth_class="truth_class",
        producer="producer",
        producer_version="producer_version",
        schema_version=version,
    )
    assertions = canonical_json(
        kind=F.lit("assertion"),
        assertion_id="assertion_id",
        subject=sorted_struct(kind="subject_kind", stable_key="subject_key"),
        predicate="predicate",
        value="value",
        truth_class="truth_class",
        producer="producer",
        producer_version="producer_version",
        schema_version=version,
    )
    observations = canonical_json(
        observation_id="observation_id",
        observed_kind="observed_kind",
        subject=sorted_struct(kind="subject_kind", stable_key="subject_key"),
        referent_text="referent_text",
        ordinal="ordinal",
    )
    evidence = canonical_json(
        parent=sorted_struct(kind="parent_kind", id="parent_id"),
        path="path",
        start_line="start_line",
        end_line="end_line",
        granularity=F.coalesce("granularity", F.lit("span")),
        extractor="extractor",
        extractor_version="extractor_version",
    )
    derivations = canonical_json(
        parent=sorted_struct(kind="parent_kind", id="parent_id"),
        reference=sorted_struct(kind="ref_kind", identity="ref_identity"),
    )
    diagnostics = canonical_json(
        code="code",
        category="category",
        severity="severity",
        message="message",
        producer="producer",
        path="path",
        span=F.when(F.col("span_start").isNotNull(), sorted_struct(start_line="span_start", end_line="span_end")),
        subject="subject_key",
        object="object_key",
        details="details",
    )
    records = {
        "nodes": nodes,
        "edges": edges,
        "assertions": assertions,
        "observations": observations,
        "evidence": evidence,
        "derivations": derivations,
        "diagnostics": diagnostics,
    }
    return union_all([t[name].select("snapshot_id", record.alias("record")) for name, record in records.items()])


def graph_hash(t: dict[str, DataFrame]) -> DataFrame:
    """(snapshot_id, canonical_graph_hash) from facts and the snapshot's own fixed inputs."""
    inputs = canonical_json(
        config_hash="config_hash",
        producer_version_set=identity.set_array("producer_version_set"),
        revision=sorted_struct(kind="revision_kind", value="revision_value"),
        schema_version="schema_version",
    )
    heads = t["snapshots"].select("snapshot_id", inputs.alias("record"))
    return tree_digest(heads.unionByName(graph_records(t)), ["snapshot_id"]).withColumnRenamed(
        "digest", "canonical_graph_hash"
    )
