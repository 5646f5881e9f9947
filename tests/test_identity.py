"""Published digests and order rules of the content identities."""

from pyspark.sql import functions as F

from lodegraph.functions import identity


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def strings(*values):
    return F.array(*[F.lit(v) for v in values])


def test_edge_digest(spark):
    value = one(
        spark,
        identity.edge_id(
            F.lit("src/auth/service.ts::AuthService.login"), F.lit("calls"), F.lit("src/auth/tokens.ts::issueToken")
        ),
    )
    assert value == "edge:sha256:90594a4734e993838e2db11f9d3bb5ede0cab2f1c70730ca8c4ab407c93bd69e"


def test_observation_digest(spark):
    evidence = {
        "path": F.lit("src/auth/service.ts"),
        "start_line": F.lit(41),
        "end_line": F.lit(41),
        "extractor": F.lit("typescript-ast"),
        "extractor_version": F.lit("1.0.0"),
        "granularity": F.lit("span"),
    }
    value = one(
        spark,
        identity.observation_id(
            F.lit("git"),
            F.lit("9f1d0c7a2b6e4c5d8f3a1b0c7d9e2f4a6b8c0d1e"),
            F.lit("call"),
            F.lit("symbol"),
            F.lit("src/auth/service.ts::AuthService.login"),
            F.lit("issueToken"),
            F.lit(1),
            evidence,
        ),
    )
    assert value == "obs:sha256:ad475fae87c8121b76673172a560885335661f68ea90e4b5fa661be9b884f24a"


def test_assertion_digest(spark):
    references = F.array(
        F.struct(F.lit("node").alias("kind"), F.lit("mod:app/services").alias("identity")),
        F.struct(
            F.lit("edge").alias("kind"),
            F.lit("edge:sha256:e20b7e1135e0535ffb7c19cb2066a0645d9e980d2071816ddfc967431b774807").alias("identity"),
        ),
        F.struct(F.lit("node").alias("kind"), F.lit("mod:app/services").alias("identity")),
    )
    # the published vector lists the edge first although nodes rank before edges
    text = one(spark, identity.derived_from_json(references))
    assert text.index("node") < text.index('"kind":"edge"')
    value = identity.sorted_struct(classification=F.lit("business-logic-layer"), confidence=F.lit("heuristic"))
    digest = one(
        spark,
        identity.assertion_id(
            F.lit("module"),
            F.lit("mod:app/services"),
            F.lit("classified_as"),
            value,
            F.lit("inferred"),
            F.lit("architecture-classifier"),
            F.lit("1.0.0"),
            identity.derived_from_json(references),
        ),
    )
    assert digest == "assertion:sha256:c081743f9923c3f5036ebda30de9be443deb58002b6bfa1102f388e64a024d57"


def test_config_digests(spark):
    config = F.struct(
        strings("architecture-classifier").alias("classifiers"),
        strings("typescript-ast", "python-ast", "repository-inventory").alias("extractors"),
        F.lit(524288).alias("max_file_bytes"),
        strings("route-resolver", "import-resolver", "reference-resolver").alias("resolvers"),
    )
    digest = one(spark, identity.config_hash(config, ("extractors", "resolvers", "classifiers")))
    assert digest == "sha256:48e96ba328a03db38556f22d2831d171b82e1ce9287c575328de4bc249da1abe"
    empty = one(spark, identity.config_hash(F.lit(None).cast("struct<a:string>")))
    assert empty == "sha256:44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"


def test_revision_rules(spark):
    rows = [
        ("git", "a" * 40, None, True),
        ("git", "a" * 40, "refs/heads/x", True),
        ("git", "A" * 40, None, False),
        ("git", "a" * 40, "main", False),
        ("upload", "sha256:" + "0" * 64, None, True),
        ("upload", "sha256:" + "0" * 64, "refs/x", False),
        ("svn", "1", None, False),
        (None, "1", None, False),
    ]
    df = spark.createDataFrame(rows, "kind string, value string, ref string, want boolean")
    got = df.select("want", identity.revision_is_valid("kind", "value", "ref").alias("got")).collect()
    assert all(r.want == r.got for r in got)
