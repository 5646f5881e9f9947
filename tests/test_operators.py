"""Operators on small literal tables and against brute force."""

import random
from collections import Counter, deque

from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.operators import facts, lineage, ranking, resolve, scoring, traversal
from lodegraph.plans import guards


def edge_table(spark, pairs, predicate="imports"):
    return spark.createDataFrame(
        [(s, predicate, o, f"{s}>{o}") for s, o in pairs], "subject_key string, predicate string, object_key string, edge_id string"
    )


def test_ranked_equals_plain_window(spark):
    rng = random.Random(1)
    # one key holds most of the rows, one key is null
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    got = {r.id: (r.rn, r.total) for r in ranking.running_total(
        ranking.ranked(df, ["k"], ["t", "id"], F.floor(F.col("t") / 7), "rn"), ["k"], ["t", "id"], F.floor(F.col("t") / 7), "id", "total"
    ).collect()}
    seen, sums = Counter(), Counter()
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        seen[k] += 1
        sums[k] += i
        assert got[i] == (seen[k], sums[k])
    assert len(got) == 600


def test_slices_number_a_hot_text_key(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else "cold", f"same/long/prefix/{rng.randrange(300):04d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, path string, id int")
    sliced = ranking.with_slices(df, ["k"], ["path"], 6)
    assert sliced.where("k = 'hot'").select("_slice").distinct().count() > 2
    got = {r.id: r.rn for r in ranking.ranked(sliced, ["k"], ["path", "id"], F.col("_slice")).collect()}
    seen = Counter()
    for k, _, i in sorted(rows):
        seen[k] += 1
        assert got[i] == seen[k]


def test_impact_limit_applies_to_the_finished_walk(spark):
    edges = edge_table(spark, [(f"n{i:03d}", "root") for i in range(100)] + [("z", "n000"), ("zz", "z")])
    rows = traversal.impact(edges, "root", "inbound").collect()
    assert len(rows) == 102 and not rows[0].limit_reached and max(r.depth for r in rows) == 3
    rows = traversal.impact(edges, "root", "inbound", limit=101).collect()
    assert len(rows) == 101 and rows[0].limit_reached and {r.depth for r in rows} == {1, 2}
    assert not traversal.impact(edges, "root", "inbound", depth=1, limit=100).first().limit_reached


def test_impact_diamond_self_edge_and_predicates(spark):
    edges = edge_table(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "a")]).unionByName(
        edge_table(spark, [("a", "x")], "calls")
    )
    rows = {(r.depth, r.node_key, r.edge_id) for r in traversal.impact(edges, "a", "outbound").collect()}
    assert rows == {(1, "b", "a>b"), (1, "c", "a>c"), (2, "d", "b>d")}
    assert traversal.impact(edges, "nothing", "outbound").count() == 0


def test_subtree_against_search(spark):
    rng = random.Random(2)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)}
    roots = ["n0", "n1", "n2"]
    want = set()
    for root in roots:
        seen, queue = {root}, deque([root])
        while queue:
            at = queue.popleft()
            for s, o in pairs:
                if s == at and o not in seen:
                    seen.add(o)
                    queue.append(o)
        want |= {(root, n) for n in seen} | {(root, s) for s, o in pairs if o == root}
    df = traversal.subtree(edge_table(spark, sorted(pairs)), spark.createDataFrame([(r,) for r in roots], "root string"))
    assert {tuple(r) for r in df.collect()} == want


def test_span_tie_and_nesting(spark):
    spans = spark.createDataFrame(
        [("f", 1, 100, "outer"), ("f", 10, 20, "a"), ("f", 10, 20, "b"), ("f", 30, 40, "c"), ("f", 31, 39, "d"), ("g", 5, 5, "one")],
        "path string, start int, end int, name string",
    )
    points = spark.createDataFrame(
        [("f", 15, 15), ("f", 35, 35), ("f", 30, 30), ("f", 50, 60), ("g", 5, 5), ("g", 6, 6), ("f", 15, 35)],
        "path string, start int, end int",
    )
    got = {(r.path, r.start, r.end): r.name for r in resolve.smallest_containing(points, spans).collect()}
    assert got == {
        ("f", 15, 15): None, ("f", 35, 35): "d", ("f", 30, 30): "c", ("f", 50, 60): "outer", ("g", 5, 5): "one",
        ("f", 15, 35): "outer",
    }


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    spans = [("p", s, s + rng.randrange(60), f"s{i}") for i, s in enumerate(rng.randrange(200) for _ in range(80))]
    points = sorted({("p", t, t + rng.randrange(3)) for t in (rng.randrange(220) for _ in range(120))})
    want = {}
    for p, a, z in points:
        inside = sorted((e - s, n) for _, s, e, n in spans if s <= a and e >= z)
        if inside:
            tie = len(inside) > 1 and inside[0][0] == inside[1][0]
            want[(p, a, z)] = None if tie else inside[0][1]
    schema = "path string, start int, end int"
    got = resolve.smallest_containing(spark.createDataFrame(points, schema), spark.createDataFrame(spans, schema + ", name string"))
    assert {(r.path, r.start, r.end): r.name for r in got.collect()} == want


def test_resolve_unique_hot_key(spark):
    observations = spark.createDataFrame([(i, "hot") for i in range(50)] + [(50, "one"), (51, "none")], "id int, k string")
    candidates = spark.createDataFrame([("hot", f"t{i}") for i in range(40)] + [("one", "x"), ("one", "x")], "k string, target string")
    rows = {r.id: (r.code, r.target) for r in resolve.resolve_unique(observations, candidates, ["k"]).collect()}
    assert len(rows) == 52
    assert rows[0] == (resolve.AMBIGUOUS, None) and rows[50] == (None, "x") and rows[51] == (resolve.UNRESOLVED, None)
    assert resolve.ambiguous_candidates(observations, candidates, ["k"]).count() == 40


def test_relative_candidates(spark):
    df = spark.createDataFrame(
        [("./x", "a/b.ts"), ("../x.ts", "a/b/c.ts"), (".pkg.name", "a/b.py"), ("..m", "a/b/c.py"), ("../../../x", "a/b.ts"), (".", "a/b.py")],
        "spec string, path string",
    )
    got = {(r.spec, r.path): set(r.c) for r in df.select("spec", "path", resolve.relative_candidates("spec", "path").alias("c")).collect()}
    forms = (".ts", ".tsx", ".py", "/index.ts", "/index.tsx", "/__init__.py")
    assert got[("./x", "a/b.ts")] == {f"a/x{f}" for f in forms}
    assert got[("../x.ts", "a/b/c.ts")] == {"a/x.ts"}
    assert got[(".pkg.name", "a/b.py")] == {f"a/pkg{f}" for f in forms} | {f"a/pkg/name{f}" for f in forms}
    assert got[("..m", "a/b/c.py")] == {f"a/m{f}" for f in forms}
    assert got[("../../../x", "a/b.ts")] == set() and got[(".", "a/b.py")] == set()


def test_import_layouts(spark):
    files = spark.createDataFrame([(p,) for p in ("src/click/__init__.py", "src/click/core.py", "app.py", "lib/app.py")], "path string")
    assert {r.root for r in resolve.source_roots(files).collect()} == {"", "src"}
    imports = spark.createDataFrame(
        [("x.py", "click.core"), ("x.py", "app"), ("x.py", "click.core.Thing"), ("x.py", "foo_bar"), ("x.py", "gone")],
        "source_path string, specifier string",
    )
    declared = spark.createDataFrame([("dep:pypi:foo-bar",)], "dep_key string")
    bindings = spark.createDataFrame([("x.py", "click.core", "Thing")], "source_path string, specifier string, imported string")
    got = {r.specifier: (r.tier, r.code, r.target) for r in resolve.resolve_imports(imports, files, declared, bindings).collect()}
    assert got["click.core"] == (1, None, "file:src/click/core.py")
    assert got["app"] == (1, None, "file:app.py")
    assert got["click.core.Thing"] == (1, None, "file:src/click/core.py")
    assert got["foo_bar"] == (2, None, "dep:pypi:foo-bar")
    assert got["gone"] == (None, resolve.UNRESOLVED, None)


def test_shadow_is_null_safe(spark):
    schema = "id int, name string, line int"
    calls = spark.createDataFrame([(1, "f", None), (2, "f", 3), (3, None, 3)], schema)
    marks = spark.createDataFrame([(9, "f", None), (8, None, 3)], schema)
    got = {r.id: r.message for r in resolve.suppress_shadowed(calls, marks, ["name", "line"]).collect()}
    assert got == {1: resolve.SHADOWED, 2: None, 3: resolve.SHADOWED}


def test_support_prefers_first_candidate(spark):
    diagnostics = spark.createDataFrame(
        [("d1", "p", 4, 5, ["o", "s"]), ("d2", "p", None, None, ["o", "s"]), ("d3", None, None, None, ["o"]), ("d4", "p", 9, 9, ["o"])],
        "diagnostic_id string, path string, span_start int, span_end int, candidates array<string>",
    )
    evidence = spark.createDataFrame(
        [("s", "p", 4, 5, "span", "a", "1"), ("o", "p", 4, 5, "span", "b", "1"), ("o", "p", 4, 5, "span", "a", "2"), ("s", "p", 1, 9, "file", "a", "1")],
        "fact_id string, path string, start_line int, end_line int, granularity string, extractor string, extractor_version string",
    )
    got = {r.diagnostic_id: (r.support, r.fact_id, r.extractor) for r in facts.support(diagnostics, evidence).collect()}
    assert got == {
        "d1": ("supported", "o", "a"), "d2": ("file_scoped", "s", "a"), "d3": ("unsupported", None, None), "d4": ("unsupported", None, None),
    }


def test_consolidate_null_conflict(spark):
    df = spark.createDataFrame([("k", None, "e"), ("k", "x", "e"), ("m", None, "e"), ("m", None, "f")], "k string, v string, e string")
    merged, spans, clashes = facts.consolidate(df, ["k"], ["v"], ["e"])
    assert [r.k for r in clashes.collect()] == ["k"] and [r.k for r in merged.collect()] == ["m"] and spans.count() == 3


def test_visible_edges_switch(spark):
    edges = edge_table(spark, [("a", "b"), ("c", "d")])
    assert facts.visible_edges(edges).count() == 2
    assert facts.visible_edges(edges, "a").count() == 1


def test_scores(spark):
    schema = "k string, id int"
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], schema)
    actual = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], schema)
    got = {r.k: (r.tp, r.fn, r.fp) for r in scoring.match_counts(expected, actual, ["k"]).collect()}
    assert got == {"a": (2, 1, 0), "b": (0, 1, 0), "c": (0, 0, 1)}
    labels = scoring.label_rows(expected, actual, ["k"], "id", F.floor(F.col("id") / 2), ["id"])
    # keys on one side only must not lose their rows
    assert Counter(r.label for r in labels.collect()) == {"TP": 2, "FN": 2, "FP": 1}
    empty = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (95, 5, 5)], "tp long, fn long, fp long")
    rows = scoring.precision_recall(empty).collect()
    assert [(r.precision, r.recall) for r in rows[:2]] == [(1.0, 1.0), (0.0, 1.0)]
    assert rows[2].precision_ok and rows[2].recall_ok


def test_lineage_delete(spark):
    rows = spark.createDataFrame(
        [(1, "o", "2024-01-01 00:00:00"), (2, "o", "2024-02-01 00:00:00"), (3, "p", "2024-01-01 00:00:00")], "id int, k string, t string"
    ).withColumn("t", F.to_timestamp("t"))
    members, lineages = lineage.sequence_lineages(rows, ["k"], "t", "id")
    assert {r.id: r.sequence_no for r in members.collect()} == {1: 1, 2: 2, 3: 1}
    after = lineage.after_delete(members, lineages, rows.where("id IN (2, 3)"), ["k"], "id")
    assert {r.k: (r.latest, r.next_sequence) for r in after.collect()} == {"o": (1, 3), "p": (None, 2)}


def test_guard_chain_prunes_and_keeps_first_parent(spark):
    graph = spark.createDataFrame(
        [
            ("r", "routes_to", "h", "1"), ("t", "routes_to", "h", "2"), ("h", "injects", "g", "3"), ("h", "injects", "n", "4"),
            ("g", "calls", "b", "5"), ("g", "calls", "a", "6"), ("a", "calls", "m", "7"), ("b", "calls", "m", "8"),
            ("b", "calls", "dead", "9"), ("m", "calls", "g", "10"), ("m", "calls", "s", "11"),
        ],
        "subject_key string, predicate string, object_key string, edge_id string",
    )
    roles = spark.createDataFrame([("g", guards.GUARD), ("m", "model"), ("s", "service")], "key string, role string")
    parts = guards.explain(graph, roles, spark.createDataFrame([("t",)], "key string"), spark.createDataFrame([("r",), ("g",), ("m",), ("s",)], "key string"))
    assert [tuple(r) for r in parts["chains"].collect()] == [("r", "h", "g")]
    hops = {(r.subject_key, r.object_key) for r in parts["hops"].collect()}
    assert hops == {("g", "a"), ("a", "m"), ("m", "s")}
    assert {(r.kind, r.key) for r in parts["claims"].collect()} == {("route", "r"), ("middleware", "g"), ("model", "m"), ("service", "s")}


def test_guard_hops_as_from_a_queue(spark):
    """Random graphs with parallel calls, cycles and several guards against a serial walk with a queue."""
    import random
    from collections import deque

    draw, keys = random.Random(11), [f"n{i}" for i in range(60)]
    calls = [(draw.choice(keys), draw.choice(keys)) for _ in range(110)]
    calls += calls[:20] + [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("n3", "c0"), ("lone", "lone")]
    calls = [(s, "calls", o, f"e{i:03}") for i, (s, o) in enumerate(calls)]
    found, targets = ["n0", "n1", "n2", "n3", "lone", "none"], set(draw.sample(keys, 8)) | {"c20"}
    want = set()
    for guard in found:
        parent, queue = {}, deque([guard])
        while queue:
            at = queue.popleft()
            for o, e in sorted((o, e) for s, _, o, e in calls if s == at):
                if o != guard and o not in parent:
                    parent[o] = (at, e)
                    queue.append(o)
        for node in targets & set(parent):
            while node != guard:
                want.add((guard, parent[node][0], node, parent[node][1]))
                node = parent[node][0]
    graph = spark.createDataFrame(calls, "subject_key string, predicate string, object_key string, edge_id string")
    roles = spark.createDataFrame([(t, "model") for t in targets], "key string, role string")
    levels = guards.guard_paths(graph, spark.createDataFrame([(g,) for g in found * 2], "guard string"))
    assert len(levels) >= 20 and all("array" not in t for level in levels for _, t in level.dtypes)
    hops = guards.used_hops(levels, roles)
    got = [(r.guard, r.subject_key, r.object_key, r.edge_id) for r in hops.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    nothing = guards.used_hops(guards.guard_paths(graph.where("false"), spark.createDataFrame([("g",)], "guard string")), roles)
    assert nothing.columns == hops.columns and nothing.collect() == []


def test_list_orders(spark):
    nodes = spark.createDataFrame([("b", "x", 1), ("a", "x", 1), ("c", None, None), ("d", "w", 2)], "stable_key string, name string, layer int")
    assert [r.stable_key for r in facts.node_list(nodes, F.col("layer")).collect()] == ["a", "b", "d", "c"]
    edges = edge_table(spark, [("c", "a"), ("d", "b"), ("a", "d")])
    listed = facts.edge_list(nodes, edges).collect()
    assert [(r.source, r.target) for r in listed] == [("c", "x"), ("w", "x"), ("x", "w")]
    rows = [(1, "info", "A", "p", 1), (2, "fatal", "B", "p", 1), (3, "fatal", "A", "p", None), (4, "fatal", "A", "p", 1)]
    diagnostics = spark.createDataFrame(rows, "id int, severity string, code string, path string, span_start int")
    assert [r.id for r in facts.diagnostic_list(diagnostics, "id").collect()] == [3, 4, 2, 1]


def test_sources_of_lineages(spark):
    cases = {
        "https://github.com/Own/Repo.git": "github.com/own/repo", " git@GITHUB.com:a/b.c ": "github.com/a/b.c",
        "https://github.com/a/b/": "github.com/a/b", "http://github.com/a/b": None, "https://github.com/a/b/c": None,
        "https://github.com/a..b/c": None, "git@github.com:a/b/": None, "": None,
    }
    from lodegraph.operators import lineage

    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", lineage.source_key("url").alias("k"))
    assert {r.url: r.k for r in df.collect()} == cases


def test_walks_make_the_published_ids_of_edges_without_ids(spark):
    edges = edge_table(spark, [("a", "b"), ("b", "c")])
    named = edges.withColumn("edge_id", identity.edge_id("subject_key", "predicate", "object_key"))
    got, want = (sorted(map(tuple, traversal.impact(e, "a", "outbound").collect())) for e in (edges.drop("edge_id"), named))
    assert got == want and len(got) == 2
    calls = edge_table(spark, [("g", "b"), ("b", "m")], "calls").drop("edge_id")
    levels = guards.guard_paths(calls, spark.createDataFrame([("g",)], "guard string"))
    hops = guards.used_hops(levels, spark.createDataFrame([("m", "model")], "key string, role string"))
    assert {(r.subject_key, r.object_key, r.depth) for r in hops.collect()} == {("g", "b", 1), ("b", "m", 2)}


def test_edge_list_makes_ids_after_its_joins(spark):
    rows = edge_table(spark, [(f"n{i % 7}", f"n{i % 5}") for i in range(35)])
    named = rows.withColumn("edge_id", identity.edge_id("subject_key", "predicate", "object_key"))
    nodes = spark.createDataFrame([(f"n{i}", f"same{i % 2}") for i in range(6)], "stable_key string, name string")
    columns = "source", "target", "edge_id"
    got, want = (facts.edge_list(nodes, e).select(*columns).collect() for e in (rows.drop("edge_id"), named))
    assert got == want == sorted(want)


def test_edge_list_deals_out_rows_of_equal_names_without_their_ids(spark):
    rows = edge_table(spark, [(f"a{i}", f"b{i % 9}") for i in range(400)])
    named = rows.withColumn("edge_id", identity.edge_id("subject_key", "predicate", "object_key"))
    nodes = spark.createDataFrame([(f"a{i}", "same") for i in range(400)] + [(f"b{i}", "too") for i in range(9)], "stable_key string, name string")
    listed = facts.edge_list(nodes, rows.drop("edge_id")).select("source", "target", "edge_id")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        placed = listed.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, before)
    assert len({r.part for r in placed}) > 1
    assert [r.edge_id for r in placed] == sorted(r.edge_id for r in named.collect())
    plan = listed._jdf.queryExecution().optimizedPlan()
    while "Repartition" not in plan.nodeName():
        plan = plan.children().apply(0)
    sent = [plan.output().apply(i).name() for i in range(plan.output().size())]
    assert sorted(sent) == ["object_key", "predicate", "source", "subject_key", "target"]
