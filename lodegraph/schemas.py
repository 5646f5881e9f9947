"""Fixed schemas of the fact tables; never inferred on read.

Every table carries ``snapshot_id`` and is stored partitioned by it.
"""

SNAPSHOTS = (
    "snapshot_id string, repository_id string, revision_kind string, revision_value string, revision_ref string,"
    " schema_version string, producer_version_set array<string>, producer_set_hash string, config_hash string,"
    " state string, canonical_graph_hash string, created_at timestamp, sealed_at timestamp"
)
NODES = (
    "snapshot_id string, stable_key string, node_kind string, name string, language string, truth_class string,"
    " properties map<string,string>"
)
EDGES = (
    "snapshot_id string, edge_id string, subject_kind string, subject_key string, predicate string,"
    " object_kind string, object_key string, truth_class string, producer string, producer_version string"
)
ASSERTIONS = (
    "snapshot_id string, assertion_id string, subject_kind string, subject_key string, predicate string,"
    " value struct<classification:string,confidence:string>, truth_class string, producer string, producer_version string"
)
OBSERVATIONS = (
    "snapshot_id string, observation_id string, observed_kind string, subject_kind string, subject_key string,"
    " referent_text string, ordinal int"
)
EVIDENCE = (
    "snapshot_id string, parent_kind string, parent_id string, path string, start_line int, end_line int,"
    " logical_line_count int, granularity string, extractor string, extractor_version string"
)
DERIVATIONS = "snapshot_id string, parent_kind string, parent_id string, ref_kind string, ref_identity string"
DIAGNOSTICS = (
    "snapshot_id string, code string, category string, severity string, message string, path string,"
    " span_start int, span_end int, producer string, subject_key string, object_key string,"
    " details struct<observation_id:string,candidates:array<string>>"
)

FACT_TABLES = {
    "nodes": NODES,
    "edges": EDGES,
    "assertions": ASSERTIONS,
    "observations": OBSERVATIONS,
    "evidence": EVIDENCE,
    "derivations": DERIVATIONS,
    "diagnostics": DIAGNOSTICS,
}
SUPPORTED_VERSION = "ri.v1"
