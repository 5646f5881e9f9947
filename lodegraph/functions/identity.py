"""Content identities: canonical JSON text and the ids hashed from it.

``to_json`` over a struct whose fields are written in alphabetical order is the
canonical form: compact, keys sorted, no floats.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = "ri.v1"
UNIT_SEPARATOR = "\x1f"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def sha256_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_json(keep_nulls: bool = True, **fields: Column) -> Column:
    """Canonical JSON object of the given fields; nulls are written or left out."""
    struct = F.struct(*[_col(fields[name]).alias(name) for name in sorted(fields)])
    return F.to_json(struct, {"ignoreNullFields": "false" if keep_nulls else "true"})


def sorted_struct(**fields) -> Column:
    return F.struct(*[_col(fields[name]).alias(name) for name in sorted(fields)])


def edge_id(subject, predicate, obj) -> Column:
    triple = F.concat_ws(UNIT_SEPARATOR, _col(subject), _col(predicate), _col(obj))
    return F.concat(F.lit("edge:"), sha256_of(triple))


def observation_id(
    revision_kind, revision_value, observed_kind, subject_kind, subject_key, referent_text, ordinal, evidence: dict
) -> Column:
    """Id of a raw sighting.  ``evidence`` maps path, start_line, end_line, extractor, extractor_version."""
    document = canonical_json(
        evidence=sorted_struct(**{k: v for k, v in evidence.items() if k != "granularity"}),
        observed_kind=observed_kind,
        ordinal=ordinal,
        referent_text=referent_text,
        revision=sorted_struct(kind=revision_kind, value=revision_value),
        schema_version=F.lit(SCHEMA_VERSION),
        subject=sorted_struct(kind=subject_kind, stable_key=subject_key),
    )
    return F.concat(F.lit("obs:"), sha256_of(document))


# Order of reference kinds and the field that carries each identity.
REFERENCE_RANK = {"observation": 0, "node": 1, "edge": 2, "assertion": 3}
REFERENCE_FIELD = {
    "observation": "observation_id",
    "node": "stable_key",
    "edge": "edge_id",
    "assertion": "assertion_id",
}


def reference_rank(kind) -> Column:
    chain = F.lit(None).cast("int")
    for name, rank in REFERENCE_RANK.items():
        chain = F.when(_col(kind) == name, rank).otherwise(chain)
    return chain


def reference_json(kind, identity) -> Column:
    """One tagged reference as canonical JSON, for example ``{"edge_id":"..","kind":"edge"}``."""
    chain = F.lit(None).cast("string")
    for name, field in REFERENCE_FIELD.items():
        text = canonical_json(**{field: _col(identity), "kind": F.lit(name)})
        chain = F.when(_col(kind) == name, text).otherwise(chain)
    return chain


def derived_from_json(references: Column) -> Column:
    """JSON array of an array of (kind, identity) structs: distinct, by rank then identity."""
    keyed = F.transform(
        references,
        lambda r: F.struct(
            reference_rank(r["kind"]).alias("rank"),
            r["identity"].alias("identity"),
            reference_json(r["kind"], r["identity"]).alias("text"),
        ),
    )
    texts = F.transform(F.array_sort(F.array_distinct(keyed)), lambda r: r["text"])
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def assertion_id(
    subject_kind, subject_key, predicate, value: Column, truth_class, producer, producer_version, derived_from: Column
) -> Column:
    """Id of an inferred property; ``derived_from`` is JSON text, ``value`` a struct with sorted fields."""
    rest = canonical_json(
        predicate=predicate,
        producer=producer,
        producer_version=producer_version,
        schema_version=F.lit(SCHEMA_VERSION),
        subject=sorted_struct(kind=subject_kind, stable_key=subject_key),
        truth_class=truth_class,
        value=value,
    )
    # "derived_from" sorts before every other key, so it opens the object.
    document = F.concat(F.lit('{"derived_from":'), derived_from, F.lit(","), rest.substr(F.lit(2), F.length(rest)))
    return F.concat(F.lit("assertion:"), sha256_of(document))


def set_array(column) -> Column:
    return F.array_sort(F.array_distinct(_col(column)))


def config_hash(config: Column, set_fields: tuple = ()) -> Column:
    """Hash of a configuration struct; arrays named in ``set_fields`` are sets, others keep their order.

    A null configuration hashes like an empty one.
    """
    if set_fields:
        for name in set_fields:
            config = config.withField(name, F.array_sort(F.array_distinct(config[name])))
    return sha256_of(F.coalesce(F.to_json(config, {"ignoreNullFields": "false"}), F.lit("{}")))


def producer_set_hash(producers) -> Column:
    return sha256_of(F.to_json(set_array(producers)))


def stable_id(prefix: str, document: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.sha2(document, 256))


def revision_is_valid(kind, value, ref) -> Column:
    """Git revisions are 40 hex digits, archives ``sha256:`` and 64; a ref starts with refs/."""
    git = (_col(kind) == "git") & _col(value).rlike("^[0-9a-f]{40}$") & (_col(ref).isNull() | _col(ref).startswith("refs/"))
    archive = (_col(kind) == "upload") & _col(value).rlike("^sha256:[0-9a-f]{64}$") & _col(ref).isNull()
    return F.coalesce(git | archive, F.lit(False))
