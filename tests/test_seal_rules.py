"""Every seal rule with a passing snapshot and one violation each; hashes ignore order."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from lodegraph import schemas
from lodegraph.functions import identity
from lodegraph.operators import cycles, hashing, quality

NOW = datetime.datetime(2024, 1, 1)
REVISION = "0" * 40


@pytest.fixture(scope="module")
def sound(spark):
    """One snapshot that satisfies every rule."""
    producers = ["ast@1", "resolver@1", "roles@1"]
    snapshots = spark.createDataFrame(
        [("s", "r", "git", REVISION, "refs/heads/x", "ri.v1", producers, "", "", "building", None, NOW, None)], schemas.SNAPSHOTS
    )
    snapshots = snapshots.withColumn("producer_set_hash", identity.producer_set_hash("producer_version_set")).withColumn(
        "config_hash", identity.config_hash(F.lit(None).cast("struct<a:string>"))
    )
    nodes = spark.createDataFrame(
        [
            ("s", "repo:root", "repository", "repository", None, "observed", None),
            ("s", "file:a.py", "file", "a.py", "Python", "observed", {"z": "1", "b": "2"}),
            ("s", "a.py::f", "symbol", "f", "Python", "observed", {}),
        ],
        schemas.NODES,
    )
    fields = {"path": F.lit("a.py"), "start_line": F.lit(2), "end_line": F.lit(2), "extractor": F.lit("ast"), "extractor_version": F.lit("1")}
    ids = spark.range(1).select(
        identity.observation_id(
            F.lit("git"), F.lit(REVISION), F.lit("call"), F.lit("file"), F.lit("file:a.py"), F.lit("f"), F.lit(1), fields
        ).alias("o"),
        identity.edge_id(F.lit("file:a.py"), F.lit("calls"), F.lit("a.py::f")).alias("e"),
    ).first()
    references = F.array(
        F.struct(F.lit("edge").alias("kind"), F.lit(ids.e).alias("identity")),
        F.struct(F.lit("node").alias("kind"), F.lit("a.py::f").alias("identity")),
    )
    value = identity.sorted_struct(classification=F.lit("service"), confidence=F.lit("heuristic"))
    assertion = spark.range(1).select(
        identity.assertion_id(
            F.lit("symbol"), F.lit("a.py::f"), F.lit("classified_as"), value, F.lit("inferred"), F.lit("roles"), F.lit("1"),
            identity.derived_from_json(references),
        ).alias("a")
    ).first().a
    span = ("a.py", 2, 2, 3, "span", "ast", "1")
    return {
        "snapshots": snapshots,
        "nodes": nodes,
        "edges": spark.createDataFrame(
            [("s", ids.e, "file", "file:a.py", "calls", "symbol", "a.py::f", "resolved", "resolver", "1")], schemas.EDGES
        ),
        "observations": spark.createDataFrame([("s", ids.o, "call", "file", "file:a.py", "f", 1)], schemas.OBSERVATIONS),
        "assertions": spark.createDataFrame(
            [("s", assertion, "symbol", "a.py::f", "classified_as", ("service", "heuristic"), "inferred", "roles", "1")],
            schemas.ASSERTIONS,
        ),
        "evidence": spark.createDataFrame(
            [("s", "node", k, *span) for k in ("repo:root", "file:a.py", "a.py::f")]
            + [("s", "observation", ids.o, *span), ("s", "edge", ids.e, "a.py", 2, 2, 3, "span", "resolver", "1")],
            schemas.EVIDENCE,
        ),
        "derivations": spark.createDataFrame(
            [
                ("s", "edge", ids.e, "observation", ids.o),
                ("s", "assertion", assertion, "edge", ids.e),
                ("s", "assertion", assertion, "node", "a.py::f"),
            ],
            schemas.DERIVATIONS,
        ),
        "diagnostics": spark.createDataFrame(
            [("s", "RI-RES-UNRESOLVED", "resolution", "warning", "m", "a.py", 2, 2, "resolver@1", None, None, (ids.o, []))],
            schemas.DIAGNOSTICS,
        ),
    }


def rules(tables):
    return {r.rule for r in quality.seal_violations(tables).select("rule").distinct().collect()}


def test_sound_snapshot_seals(sound):
    assert rules(sound) == set()


def changed(sound, table, column, value, where="true"):
    df = sound[table]
    new = F.when(F.expr(where), value if not isinstance(value, (str, int)) else F.lit(value)).otherwise(F.col(column))
    return {**sound, table: df.withColumn(column, new)}


CASES = {
    "V1": lambda s: changed(s, "snapshots", "producer_set_hash", "sha256:0"),
    "V2": lambda s: changed(s, "diagnostics", "severity", "fatal"),
    "V3": lambda s: {**s, "nodes": s["nodes"].where("node_kind <> 'repository'")},
    "V4": lambda s: changed(s, "nodes", "stable_key", "file:./a.py", "node_kind = 'file'"),
    "V5": lambda s: changed(s, "evidence", "end_line", 9, "parent_kind = 'edge'"),
    "V6": lambda s: {**s, "evidence": s["evidence"].where("parent_id <> 'repo:root'")},
    "V7": lambda s: changed(s, "observations", "ordinal", 2),
    "V8": lambda s: {**s, "derivations": s["derivations"].where("parent_kind <> 'edge'")},
    "V9": lambda s: changed(s, "assertions", "predicate", "renamed"),
    "V10": lambda s: changed(s, "derivations", "ref_identity", "gone", "ref_kind = 'node'"),
    "V12": lambda s: changed(s, "diagnostics", "span_end", F.lit(None)),
    "V14": lambda s: {**s, "nodes": s["nodes"].unionByName(s["nodes"].where("node_kind = 'file'"))},
}


@pytest.mark.parametrize("rule", sorted(CASES))
def test_rule_is_broken(sound, rule):
    assert rule in rules(CASES[rule](sound))


def test_line_count_conflict(sound):
    other = sound["evidence"].where("parent_kind = 'edge'").withColumn("logical_line_count", F.lit(7))
    rows = quality.line_counts_agree(sound["evidence"].unionByName(other)).collect()
    assert [r.rule for r in rows] == ["V13"]


def test_cycle_and_dag(spark, sound):
    schema = "source string, target string"
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "a")], schema)
    assert cycles.links_on_cycles(dag).count() == 0
    ring = dag.unionByName(spark.createDataFrame([("c", "a"), ("x", "x")], schema))
    assert {tuple(r) for r in cycles.links_on_cycles(ring).collect()} == {("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "x")}
    edge = sound["edges"].first().edge_id
    assertion = sound["assertions"].first().assertion_id
    back = spark.createDataFrame([("s", "edge", edge, "assertion", assertion)], schemas.DERIVATIONS)
    rows = quality.derivations_acyclic(sound["derivations"].unionByName(back)).collect()
    assert {r.rule for r in rows} == {"V11"} and len(rows) == 2


def test_long_reference_lists_hash_alike(spark):
    """The streamed hash of long reference lists equals the built-in one."""
    schema = schemas.DERIVATIONS
    refs = [("s", "assertion", f"a{i}", kind, f"{kind}{j:03d}é") for i in range(7) for j in range(40) for kind in ("node", "edge", "observation")]
    derivations = spark.createDataFrame(refs, schema)
    assertions = spark.createDataFrame(
        [("s", f"a{i}", "symbol", f"k{i}", "p", ("c", "h"), "inferred", "x", "1") for i in range(7)], schemas.ASSERTIONS
    )
    listed = F.collect_list(F.struct(F.col("ref_kind").alias("kind"), F.col("ref_identity").alias("identity")))
    texts = derivations.groupBy(F.col("parent_id").alias("assertion_id")).agg(listed.alias("refs"))
    built_in = identity.assertion_id(
        "subject_kind", "subject_key", "predicate", "value", "truth_class", "producer", "producer_version",
        identity.derived_from_json(F.col("refs")),
    )
    want = {tuple(r) for r in assertions.join(texts, "assertion_id").select("snapshot_id", "assertion_id", built_in).collect()}
    streamed = {tuple(r) for r in quality.recomputed_assertion_ids(assertions, derivations).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        cut = {tuple(r) for r in quality.recomputed_assertion_ids(assertions, derivations).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want == streamed == cut and len(want) == 7


def test_graph_hash_ignores_order_and_duplicates(spark, sound):
    first = hashing.graph_hash(sound).first().canonical_graph_hash
    shuffled = {name: df.unionByName(df).repartition(3).orderBy(F.rand(5)) for name, df in sound.items() if name != "snapshots"}
    assert hashing.graph_hash({**shuffled, "snapshots": sound["snapshots"]}).first().canonical_graph_hash == first
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert hashing.graph_hash(sound).first().canonical_graph_hash == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    other = changed(sound, "nodes", "name", "renamed", "node_kind = 'symbol'")
    assert hashing.graph_hash(other).first().canonical_graph_hash != first


def test_snapshots_do_not_share_a_hash(sound):
    def renamed(df):
        return df.withColumn("snapshot_id", F.lit("t"))

    both = {name: df.unionByName(renamed(df)) for name, df in sound.items()}
    rows = hashing.graph_hash(both).collect()
    # the snapshot id itself takes no part in the hash
    assert len(rows) == 2 and rows[0].canonical_graph_hash == rows[1].canonical_graph_hash


def test_edge_support_meets_once(spark):
    """Repeated edges, ids of other forms and null ids, as by one anti-join for each rule."""
    good = "edge:sha256:" + "ab" * 32
    ids = [good, good, good.upper(), good + "\n", "edge:sha256:" + "0f" * 32, "e1", "", None]
    edges = spark.createDataFrame(
        [("s" if i % 3 else None, x, "n", "a", "imports", "n", "b", "p", "1") for i, x in enumerate(ids * 2)],
        "snapshot_id string, edge_id string, subject_kind string, subject_key string, predicate string, object_kind string,"
        " object_key string, producer string, producer_version string",
    )
    evidence = spark.createDataFrame(
        [("s", "edge", good), ("s", "edge", good), ("s", "edge", None), (None, "edge", "e1"), ("s", "node", "e1"), ("s", "edge", "")],
        "snapshot_id string, parent_kind string, parent_id string",
    )
    derivations = evidence.select("*", F.lit("observation").alias("ref_kind")).where("parent_id <> ''")
    nodes = spark.createDataFrame([("s", "a", "n")], "snapshot_id string, stable_key string, node_kind string")
    producers = spark.createDataFrame([("s", "p@1")], "snapshot_id string, producer string")
    want = []
    for rows, detail in ((evidence, "no evidence"), (derivations, "no source observation")):
        known = {(r.snapshot_id, r.parent_id) for r in rows.collect() if r.parent_kind == "edge"}
        for e in edges.collect():
            if None in (e.snapshot_id, e.edge_id) or (e.snapshot_id, e.edge_id) not in known:
                want.append((str(e.snapshot_id), str(e.edge_id), detail))
    found = quality.edges_sound(nodes, edges, evidence, derivations, producers)
    got = [(str(r.snapshot_id), str(r.key), r.detail) for r in found.where("detail LIKE 'no %'").collect()]
    assert sorted(got) == sorted(want)
    # the ends and the producer are looked up; evidence and observations are not joined one after the other
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 3


def test_tree_digest_deals_out_each_record_once_as_bytes(spark):
    records = spark.createDataFrame([("a", f"r{i % 40}") for i in range(80)] + [("b", "x")], "k string, record string")
    want = {}
    for key in ("a", "b"):
        level = {hashlib.sha256(r.record.encode()).hexdigest() for r in records.collect() if r.k == key}
        level = [(h, h) for h in level]
        for digits in hashing.LEVELS:
            groups = {}
            for prefix, h in level:
                groups.setdefault(prefix[:digits], []).append(h)
            level = [(p, hashlib.sha256("".join(sorted(hs)).encode()).hexdigest()) for p, hs in groups.items()]
        want[key] = "sha256:" + level[0][1]
    found = hashing.tree_digest(records, ["k"])
    assert {r.k: r.digest for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan and "RepartitionByExpression" in plan


def test_digest_query_sets_no_number_of_partitions(spark):
    from lodegraph.queries import catalog

    found = catalog.QUERIES["h2_digest_ignores_order"](spark, "/root/testdata/sf0.001")
    assert "hashpartitioning(reverse" in (plan := found._jdf.queryExecution().sparkPlan().toString()) or "REPARTITION_BY_COL" in plan
    assert "REPARTITION_BY_NUM" not in plan
    assert [r.same for r in found.collect()] == [True] * 3


def exchanged(df):
    """Column names of each exchange of the plan when no side of a join is sent to all tasks."""
    spark, name = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        nodes, found = [df.select("*")._jdf.queryExecution().executedPlan().initialPlan()], []
    finally:
        spark.conf.set(name, before)
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_edge_ids_that_recompute_do_not_travel(spark):
    """Ids that recompute, that do not, and none, in rows that break each part of the rule."""
    rows = [("s", f"a{i % 5}", "n", "imports", "n", f"b{i % 7}", "p", str(i % 3)) for i in range(60)]
    names = ["snapshot_id", "subject_key", "subject_kind", "predicate", "object_kind", "object_key", "producer", "producer_version"]
    edges = spark.createDataFrame(rows, names)
    made = identity.edge_id("subject_key", "predicate", "object_key")
    other = F.when(F.col("object_key") == "b1", None).when(F.col("object_key") == "b2", F.concat(F.lit("="), made)).otherwise(made)
    edges = edges.withColumn("edge_id", other)
    ids = sorted({r.edge_id for r in edges.collect() if r.edge_id})
    evidence = spark.createDataFrame([("s", "edge", x) for x in ids[::2]], "snapshot_id string, parent_kind string, parent_id string")
    derivations = spark.createDataFrame(
        [("s", "edge", x, "observation") for x in ids[::3]],
        "snapshot_id string, parent_kind string, parent_id string, ref_kind string",
    )
    nodes = spark.createDataFrame(
        [("s", f"a{i}", "n") for i in range(4)] + [("s", f"b{i}", "n") for i in range(1, 7)],
        "snapshot_id string, stable_key string, node_kind string",
    )
    producers = spark.createDataFrame([("s", "p@0"), ("s", "p@1")], "snapshot_id string, producer string")
    want = []
    for e in edges.collect():
        own = "edge:sha256:" + hashlib.sha256("\x1f".join((e.subject_key, e.predicate, e.object_key)).encode()).hexdigest()
        found = [("subject", e.subject_key == "a4"), ("object", e.object_key == "b0")]
        found += [("identity", e.edge_id not in (None, own)), ("producer not declared", e.producer_version == "2")]
        found += [("no evidence", e.edge_id not in ids[::2]), ("no source observation", e.edge_id not in ids[::3])]
        want += [(str(e.edge_id), detail) for detail, bad in found if bad]
    found = quality.edges_sound(nodes, edges, evidence, derivations, producers)
    assert sorted((str(r.key), r.detail) for r in found.collect()) == sorted(want)
    sent = [names for names in exchanged(found) if "subject_key" in names]
    wide = [names for names in sent if "edge_id" in names or "_id" in names]
    # only the producer's look-up, which the session sends to all tasks, has whole rows
    assert len(sent) >= 3 and len(wide) <= 1


def test_the_edge_query_stores_line_edges_once(spark):
    from lodegraph.queries import bindings

    folder = "/root/testdata/sf0.001"
    rows = bindings.edges(spark, folder, distinct=False).drop("edge_id").distinct()
    assert sorted(rows.collect()) == sorted(bindings.edges(spark, folder).drop("edge_id").collect())


def test_tree_digest_shuffles_records_once_and_short_ones_as_text(spark):
    """Records around the length up to which text travels, repeated ones, and a key with one record."""
    texts = [f"r{i % 40}" for i in range(80)] + [c * n for c in "xé" for n in range(60, 140)] + ["y" * 500] * 2
    records = spark.createDataFrame([("a", t) for t in texts] + [("b", "z")], "k string, record string")
    want = {}
    for key, own in (("a", texts), ("b", ["z"])):
        level = [(h, h) for h in {hashlib.sha256(t.encode()).hexdigest() for t in own}]
        for digits in hashing.LEVELS:
            groups = {}
            for prefix, h in level:
                groups.setdefault(prefix[:digits], []).append(h)
            level = [(p, hashlib.sha256("".join(sorted(hs)).encode()).hexdigest()) for p, hs in groups.items()]
        want[key] = "sha256:" + level[0][1]
    found = hashing.tree_digest(records, ["k"])
    assert {r.k: r.digest for r in found.collect()} == want
    # records to leaves, leaves to their nodes, nodes to the root; neither leaves nor prefixes are dealt out again
    sent = exchanged(found)
    assert len(sent) == 3 and ["k", "_t", "_h"] in sent
