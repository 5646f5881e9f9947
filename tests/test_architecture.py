"""Module graph: folders stay folders until pairs are asked for."""

import pytest

from lodegraph.plans import architecture

EDGES = "edge_id string, subject_kind string, subject_key string, predicate string, object_kind string, object_key string"


@pytest.fixture
def stored(monkeypatch):
    """Row counts of everything that the plans store."""
    counts, store = [], architecture.checkpoint

    def counted(df):
        kept = store(df)
        counts.append(kept.count())
        return kept

    monkeypatch.setattr(architecture, "checkpoint", counted)
    return counts


def lifted(spark, edges, evidence, members, unknown=()):
    known = {m for _, m in members} | {"dep:npm:x"}
    return (
        spark.createDataFrame(edges, EDGES),
        spark.createDataFrame(evidence, "edge_id string, path string"),
        spark.createDataFrame([], "stable_key string, path string"),
        spark.createDataFrame([(p, None, m) for p, m in members], "path string, role string, module_id string"),
        spark.createDataFrame([(n,) for n in sorted(known - set(unknown))], "node_id string"),
    )


def test_edges_of_a_folder_do_not_meet_its_modules_one_by_one(spark, stored):
    n = 30
    edges = [(f"e{i}", "module", "mod:a/b", "imports", "file", f"file:docs/{i}.md") for i in range(n)]
    members = [(f"a/b/{i}.py", f"module:{i}") for i in range(n)] + [(f"docs/{i}.md", "module:docs") for i in range(n)]
    tables = lifted(spark, edges, [], members)
    both, diagnostics = architecture.lift_edges(*tables)
    assert diagnostics.count() == 0 and max(stored) <= 2 * n
    assert both.count() == n * n
    found = {tuple(r) for r in architecture.adjacency(architecture.module_pairs(*tables)).collect()}
    assert max(stored) <= 2 * n
    want = {(f"module:{i}", "dependency", "module:docs") for i in range(n)}
    assert found == want | {(o, "dependent", s) for s, _, o in want}


def test_folders_that_share_modules(spark):
    """Nested and separate folders of one edge, self pairs, unknown nodes, and folders without known modules."""
    edges = [
        ("r1", "repository", "repo:root", "depends_on", "dependency", "dep:npm:x"),
        ("r2", "repository", "repo:root", "depends_on", "dependency", "dep:npm:y"),
        ("r3", "repository", "repo:root", "depends_on", "dependency", "dep:npm:x"),
        ("m1", "module", "mod:a", "imports", "module", "mod:a"),
        ("m2", "module", "mod:gone", "imports", "module", "mod:a"),
        ("m3", "module", "mod:none", "imports", "file", "file:a/1.py"),
        ("f1", "file", "file:a/1.py", "imports", "file", "file:a/1.py"),
    ]
    evidence = [("r1", "a/package.json"), ("r1", "a/b/package.json"), ("r1", "c/package.json"), ("r2", "a/package.json"), ("r3", "package.json")]
    members = [("a/1.py", "module:1"), ("a/b/2.py", "module:2"), ("c/3.py", "module:1"), ("gone/4.py", "module:gone")]
    tables = lifted(spark, edges, evidence, members, unknown=["module:gone"])
    both, diagnostics = architecture.lift_edges(*tables)
    want = [
        ("m1", "imports", "module:1", "module:2"),
        ("m1", "imports", "module:2", "module:1"),
        ("r1", "depends_on", "module:1", "dep:npm:x"),
        ("r1", "depends_on", "module:2", "dep:npm:x"),
    ]
    assert sorted(tuple(r) for r in both.select("edge_id", "predicate", "source", "target").collect()) == want
    assert sorted((r.edge_id, r.code) for r in diagnostics.collect()) == [
        ("m2", "ARCH-REL-ENDPOINT-UNMAPPED"), ("m3", "ARCH-REL-ENDPOINT-UNMAPPED"), ("r2", "ARCH-REL-ENDPOINT-UNMAPPED"), ("r3", "ARCH-REL-REPO-SCOPED"),
    ]
    pairs = sorted(tuple(r) for r in architecture.module_pairs(*tables).collect())
    assert pairs == sorted({w[2:] for w in want})
