"""Seal rules as violation queries.

Each rule takes fact tables of any number of snapshots and returns the rows that
break it as (snapshot_id, rule, key, detail).  A snapshot may seal when none of
its rows appear.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import identity, paths
from lodegraph.operators import cycles
from lodegraph.operators.resolve import union_all

SHA256 = "^sha256:[0-9a-f]{64}$"


def _violations(df: DataFrame, rule: str, key, detail="") -> DataFrame:
    key = key if isinstance(key, Column) else F.col(key)
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select("snapshot_id", F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.alias("detail"))


def producer_rows(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, producer) of the declared producers."""
    return snapshots.select("snapshot_id", F.explode("producer_version_set").alias("producer")).distinct()


def producer_set(snapshots: DataFrame) -> DataFrame:
    """The declared producers are sorted and distinct and hash to the stored value; V1."""
    declared = F.col("producer_version_set")
    detail = (
        F.when(declared != identity.set_array(declared), "not normalized")
        .when(~F.col("producer_set_hash").eqNullSafe(identity.producer_set_hash(declared)), "hash differs")
        .when(~F.coalesce(F.col("config_hash").rlike(SHA256), F.lit(False)), "config hash malformed")
        .when(~identity.revision_is_valid("revision_kind", "revision_value", "revision_ref"), "revision malformed")
    )
    return _violations(snapshots.withColumn("_d", detail).where("_d IS NOT NULL"), "V1", "snapshot_id", F.col("_d"))


def fatal(diagnostics: DataFrame) -> DataFrame:
    """No fatal diagnostic; V2."""
    return _violations(diagnostics.where("severity = 'fatal'"), "V2", "code")


def one_root(snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exactly one repository node, keyed repo:root; V3."""
    roots = (
        nodes.where("node_kind = 'repository'")
        .groupBy("snapshot_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("stable_key").alias("_key"))
    )
    joined = snapshots.select("snapshot_id").join(roots, "snapshot_id", "left")
    bad = joined.where("_n IS NULL OR _n <> 1 OR _key <> 'repo:root'")
    return _violations(bad, "V3", "snapshot_id", F.coalesce("_n", F.lit(0)).cast("string"))


def keys_normalized(nodes: DataFrame) -> DataFrame:
    """Stable keys equal their normalized form; V4."""
    good = paths.normalize_stable_key("node_kind", "stable_key").eqNullSafe(F.col("stable_key"))
    return _violations(nodes.where(~good), "V4", "stable_key")


def undeclared(rows: DataFrame, producers: DataFrame, name: Column) -> DataFrame:
    """Rows whose producer the snapshot does not declare."""
    keyed = rows.withColumn("producer", name)
    return keyed.join(producers, ["snapshot_id", "producer"], "left_anti")


def stored_evidence(evidence: DataFrame, producers: DataFrame) -> DataFrame:
    """Evidence is complete, inside its file, on a normalized path and from a declared producer; V5."""
    normal = paths.normalize_path("path")
    inside = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (
        F.col("end_line") <= F.col("logical_line_count")
    )
    detail = (
        F.when(F.coalesce("extractor", F.lit("")) == "", "extractor missing")
        .when(F.coalesce("extractor_version", F.lit("")) == "", "extractor version missing")
        .when(~F.coalesce(F.col("granularity").isin("span", "file"), F.lit(False)), "granularity")
        .when(normal.isNull(), "path escapes")
        .when(normal == "", "path empty")
        .when(normal != F.col("path"), "path not normalized")
        .when(~F.coalesce(inside, F.lit(False)), "span")
    )
    bad = evidence.withColumn("_d", detail).where("_d IS NOT NULL")
    unknown = undeclared(evidence, producers, F.concat_ws("@", "extractor", "extractor_version"))
    return _violations(bad, "V5", "parent_id", F.col("_d")).unionByName(
        _violations(unknown, "V5", "parent_id", "producer not declared")
    )


def _parents(evidence: DataFrame, kind: str, key: str) -> DataFrame:
    return evidence.where(F.col("parent_kind") == kind).select("snapshot_id", F.col("parent_id").alias(key))


def nodes_have_evidence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observed nodes have evidence; V6."""
    seen = _parents(evidence, "node", "stable_key").distinct()
    bad = nodes.where("truth_class = 'observed'").join(seen, ["snapshot_id", "stable_key"], "left_anti")
    return _violations(bad, "V6", "stable_key")


def observations_sound(snapshots: DataFrame, nodes: DataFrame, observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """One evidence row, a subject of the right kind, and an id that recomputes; V7."""
    fields = ["path", "start_line", "end_line", "extractor", "extractor_version"]
    spans = (
        evidence.where("parent_kind = 'observation'")
        .groupBy("snapshot_id", F.col("parent_id").alias("observation_id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*fields)).alias("_e"))
    )
    kinds = nodes.select("snapshot_id", F.col("stable_key").alias("subject_key"), F.col("node_kind").alias("_kind"))
    joined = (
        observations.join(spans, ["snapshot_id", "observation_id"], "left")
        .join(kinds, ["snapshot_id", "subject_key"], "left")
        # one small row per snapshot
        .join(snapshots.select("snapshot_id", "revision_kind", "revision_value"), "snapshot_id")
    )
    recomputed = identity.observation_id(
        "revision_kind",
        "revision_value",
        "observed_kind",
        "subject_kind",
        "subject_key",
        "referent_text",
        "ordinal",
        {f: F.col(f"_e.{f}") for f in fields},
    )
    detail = (
        F.when(F.coalesce("_n", F.lit(0)) != 1, "evidence count")
        .when(~F.col("_kind").eqNullSafe(F.col("subject_kind")), "subject")
        .when(recomputed != F.col("observation_id"), "identity")
    )
    return _violations(joined.withColumn("_d", detail).where("_d IS NOT NULL"), "V7", "observation_id", F.col("_d"))


def edges_sound(
    nodes: DataFrame, edges: DataFrame, evidence: DataFrame, derivations: DataFrame, producers: DataFrame
) -> DataFrame:
    """Endpoints exist, the id recomputes, there is evidence, an observation and a declared producer; V8."""

    made = identity.edge_id("subject_key", "predicate", "object_key")
    # an id that recomputes does not travel: the rest of the edge gives it again
    tag = F.when(F.col("edge_id").eqNullSafe(made), F.lit("=")).otherwise(F.concat(F.lit("!"), "edge_id"))
    short = edges.withColumn("_tag", tag).drop("edge_id")
    key = F.when(F.col("_tag") == "=", made).otherwise(F.substring("_tag", 2, 2_147_483_647))

    def ends(side: str) -> DataFrame:
        found = nodes.select(
            "snapshot_id", F.col("stable_key").alias(f"{side}_key"), F.col("node_kind").alias(f"{side}_kind")
        )
        return short.join(found, ["snapshot_id", f"{side}_key", f"{side}_kind"], "left_anti")

    wrong_id = edges.where(F.col("edge_id") != made)
    unknown = undeclared(edges, producers, F.concat_ws("@", "producer", "producer_version"))
    parts = (
        (ends("subject"), key, "subject"),
        (ends("object"), key, "object"),
        (wrong_id, "edge_id", "identity"),
        (unknown, "edge_id", "producer not declared"),
    )
    unsupported = _unsupported(short, key, evidence, derivations)
    return union_all([*(_violations(df, "V8", name, detail) for df, name, detail in parts), unsupported])


def _met(key: Column | str) -> list[Column]:
    """What a fact of a snapshot meets by: two 64-bit hashes of both, null if one is."""
    key = F.col(key) if isinstance(key, str) else key
    known = F.col("snapshot_id").isNotNull() & key.isNotNull()
    return [F.when(known, F.xxhash64(F.lit(salt), "snapshot_id", key)).alias(f"_met{salt}") for salt in (0, 1)]


def _unsupported(edges: DataFrame, key: Column, evidence: DataFrame, derivations: DataFrame) -> DataFrame:
    """V8 rows of edges without evidence or without an observation, one for each row of the edge.

    Evidence and derivations travel as the 16 bytes of ``_met``: among 10^9 ids the chance that any two meet by mistake
    is below 10^-20.  Edges are dealt out by the same hashes, which are made of the rest of the edge on both sides.
    """
    named = "parent_kind = 'edge' AND parent_id IS NOT NULL AND snapshot_id IS NOT NULL"
    sources = derivations.where(named).where("ref_kind = 'observation'")
    known = evidence.where(named).select(*_met("parent_id"), F.lit(False).alias("_source"))
    known = known.unionByName(sources.select(*_met("parent_id"), F.lit(True).alias("_source")))
    met = ["_met0", "_met1"]
    known = known.groupBy(*met).agg(F.bool_or(~F.col("_source")).alias("_seen"), F.bool_or("_source").alias("_source"))
    rest = edges.select("snapshot_id", "subject_key", "predicate", "object_key", "_tag").repartition(*_met(key))
    joined = rest.select("*", *_met(key)).join(known, met, "left")
    lacking = F.array_compact(
        F.array(
            F.when(~F.coalesce("_seen", F.lit(False)), F.lit("no evidence")),
            F.when(~F.coalesce("_source", F.lit(False)), F.lit("no source observation")),
        )
    )
    return _violations(joined.withColumn("_d", F.explode(lacking)), "V8", key, F.col("_d"))


def recomputed_assertion_ids(assertions: DataFrame, derivations: DataFrame) -> DataFrame:
    """(snapshot_id, assertion_id, recomputed) for assertions that have derivations.

    The id hashes one document that lists all references.  It is hashed piece by piece in sorted order, so that no
    list is ever held as a whole, however long it is.
    """
    key = ["snapshot_id", "assertion_id"]
    references = (
        derivations.where("parent_kind = 'assertion'")
        .select("snapshot_id", F.col("parent_id").alias("assertion_id"), "ref_kind", "ref_identity")
        .distinct()
    )
    rest = identity.canonical_json(
        predicate="predicate",
        producer="producer",
        producer_version="producer_version",
        schema_version=F.lit(identity.SCHEMA_VERSION),
        subject=identity.sorted_struct(kind="subject_kind", stable_key="subject_key"),
        truth_class="truth_class",
        value="value",
    )
    pieces = (
        references.join(assertions.select(*key, rest.alias("_rest")), key)
        .select(
            *key,
            "_rest",
            identity.reference_rank("ref_kind").alias("_rank"),
            "ref_identity",
            identity.reference_json("ref_kind", "ref_identity").alias("_text"),
        )
        .repartition(*key)
        .sortWithinPartitions(*key, "_rank", "ref_identity")
    )

    def hash_runs(batches):
        owner, digest, tail = None, None, None

        def closed():
            digest.update(("]," + tail[1:]).encode())
            return (*owner, "assertion:sha256:" + digest.hexdigest())

        for batch in batches:
            done = []
            owners = batch["snapshot_id"].str.cat(batch["assertion_id"], sep="\0")
            starts = (owners != owners.shift()).to_numpy().nonzero()[0].tolist()
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                # a run of references of one assertion, which may have begun in the batch before
                text = ",".join(batch["_text"].iloc[start:end])
                first = (batch["snapshot_id"].iloc[start], batch["assertion_id"].iloc[start])
                if first == owner:
                    digest.update(("," + text).encode())
                    continue
                if owner is not None:
                    done.append(closed())
                owner, tail = first, batch["_rest"].iloc[start]
                digest = hashlib.sha256(('{"derived_from":[' + text).encode())
            yield pd.DataFrame(done, columns=["snapshot_id", "assertion_id", "recomputed"])
        if owner is not None:
            yield pd.DataFrame([closed()], columns=["snapshot_id", "assertion_id", "recomputed"])

    return pieces.mapInPandas(hash_runs, "snapshot_id string, assertion_id string, recomputed string")


def assertions_sound(
    nodes: DataFrame, assertions: DataFrame, derivations: DataFrame, producers: DataFrame
) -> DataFrame:
    """Subject exists, there is a derivation, the id recomputes, the producer is declared; V9."""
    key = ["snapshot_id", "assertion_id"]
    subjects = nodes.select(
        "snapshot_id", F.col("stable_key").alias("subject_key"), F.col("node_kind").alias("subject_kind")
    )
    no_subject = assertions.join(subjects, ["snapshot_id", "subject_key", "subject_kind"], "left_anti")
    fresh = recomputed_assertion_ids(assertions, derivations)
    checked = assertions.join(fresh, key, "left")
    unknown = undeclared(assertions, producers, F.concat_ws("@", "producer", "producer_version"))
    parts = (
        (no_subject, "subject"),
        (checked.where("recomputed IS NULL"), "no derivation"),
        (checked.where("recomputed <> assertion_id"), "identity"),
        (unknown, "producer not declared"),
    )
    return union_all([_violations(df, "V9", "assertion_id", detail) for df, detail in parts])


def fact_identities(nodes: DataFrame, edges: DataFrame, assertions: DataFrame, observations: DataFrame) -> DataFrame:
    """(snapshot_id, ref_kind, ref_identity) of everything a derivation may name."""
    sources = (
        ("node", nodes, "stable_key"),
        ("edge", edges, "edge_id"),
        ("assertion", assertions, "assertion_id"),
        ("observation", observations, "observation_id"),
    )
    return union_all(
        [df.select("snapshot_id", F.lit(kind).alias("ref_kind"), F.col(c).alias("ref_identity")) for kind, df, c in sources]
    ).distinct()


def references_resolve(derivations: DataFrame, identities: DataFrame) -> DataFrame:
    """Every derivation names an existing fact; V10."""
    dangling = derivations.join(identities, ["snapshot_id", "ref_kind", "ref_identity"], "left_anti")
    return _violations(dangling, "V10", "parent_id", F.concat_ws(":", "ref_kind", "ref_identity"))


def derivation_cycles(derivations: DataFrame) -> DataFrame:
    """(snapshot_id, fact, component) of every derived fact on a cycle; the component goes by its first fact."""
    links = derivations.where("ref_kind IN ('edge', 'assertion')").select(
        F.struct("snapshot_id", F.concat_ws(":", "parent_kind", "parent_id").alias("fact")).alias("source"),
        F.struct("snapshot_id", F.concat_ws(":", "ref_kind", "ref_identity").alias("fact")).alias("target"),
    )
    found = cycles.components(links)
    return found.select("node.snapshot_id", F.col("node.fact").alias("fact"), F.col("component.fact").alias("component"))


def derivations_acyclic(derivations: DataFrame) -> DataFrame:
    """The derivation graph has no cycle; V11."""
    return _violations(derivation_cycles(derivations), "V11", "fact", "cycle")


def diagnostics_sound(diagnostics: DataFrame, producers: DataFrame) -> DataFrame:
    """Declared producer, and span ends both present or both absent; V12."""
    half = diagnostics.where(F.col("span_start").isNull() != F.col("span_end").isNull())
    unknown = undeclared(diagnostics, producers, F.col("producer"))
    return _violations(half, "V12", "code", "half a span").unionByName(
        _violations(unknown, "V12", "code", "producer not declared")
    )


EVIDENCE_IDENTITY = (
    "parent_kind", "parent_id", "path", "start_line", "end_line", "granularity", "extractor", "extractor_version",
)


def line_counts_agree(evidence: DataFrame) -> DataFrame:
    """Equal evidence carries one line count; V13."""
    count = F.col("logical_line_count")
    bad = evidence.groupBy("snapshot_id", *EVIDENCE_IDENTITY).agg(F.min(count).alias("_lo"), F.max(count).alias("_hi"))
    return _violations(bad.where("_lo <> _hi"), "V13", "parent_id")


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; V14."""
    repeated = rows.groupBy("snapshot_id", *keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _violations(repeated, "V14", F.concat_ws("|", *keys), F.col("_n").cast("string"))


def seal_violations(t: dict[str, DataFrame]) -> DataFrame:
    """All rules over the tables named as in ``schemas`` plus ``snapshots``."""
    producers = producer_rows(t["snapshots"])
    identities = fact_identities(t["nodes"], t["edges"], t["assertions"], t["observations"])
    return union_all(
        [
            producer_set(t["snapshots"]),
            fatal(t["diagnostics"]),
            one_root(t["snapshots"], t["nodes"]),
            keys_normalized(t["nodes"]),
            stored_evidence(t["evidence"], producers),
            nodes_have_evidence(t["nodes"], t["evidence"]),
            observations_sound(t["snapshots"], t["nodes"], t["observations"], t["evidence"]),
            edges_sound(t["nodes"], t["edges"], t["evidence"], t["derivations"], producers),
            assertions_sound(t["nodes"], t["assertions"], t["derivations"], producers),
            references_resolve(t["derivations"], identities),
            derivations_acyclic(t["derivations"]),
            diagnostics_sound(t["diagnostics"], producers),
            line_counts_agree(t["evidence"]),
            unique(t["nodes"], ["stable_key"]),
            unique(t["edges"], ["edge_id"]),
            unique(t["edges"], ["subject_key", "predicate", "object_key"]),
            unique(t["assertions"], ["assertion_id"]),
            unique(t["observations"], ["observation_id"]),
        ]
    )


def observed_producers(t: dict[str, DataFrame]) -> DataFrame:
    """(snapshot_id, producer) that the facts themselves name."""
    named = [
        t["evidence"].select("snapshot_id", F.concat_ws("@", "extractor", "extractor_version").alias("producer")),
        t["edges"].select("snapshot_id", F.concat_ws("@", "producer", "producer_version").alias("producer")),
        t["assertions"].select("snapshot_id", F.concat_ws("@", "producer", "producer_version").alias("producer")),
        t["diagnostics"].select("snapshot_id", "producer"),
    ]
    return union_all([n.distinct() for n in named]).distinct()
