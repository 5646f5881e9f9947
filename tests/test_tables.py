"""Stored tables: partition pruning, rewrites, sinks; and plans that must keep their shape."""

import re

import pytest
from pyspark.sql import functions as F

from lodegraph import schemas
from lodegraph.queries import catalog
from lodegraph.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_load_prunes_partitions_and_columns(spark, tmp_path):
    folder = str(tmp_path)
    nodes = spark.createDataFrame(
        [(s, f"file:{i}", "file", str(i), None, "observed", None) for s in ("s1", "s2", "s3") for i in range(3)], schemas.NODES
    )
    tables.append_facts(nodes, folder, "nodes", ["stable_key"])
    for name, schema in schemas.FACT_TABLES.items():
        if name != "nodes":
            # an empty write leaves only the schema
            spark.createDataFrame([], schema).drop("snapshot_id").write.parquet(f"{folder}/{name}/snapshot_id=none")
    loaded = tables.load_facts(spark, folder, "s2")
    assert loaded["nodes"].count() == 3 and loaded["edges"].count() == 0
    text = plan(loaded["nodes"].select("stable_key").where("node_kind = 'file'"))
    assert "PartitionFilters: []" not in text
    assert "PushedFilters: [IsNotNull(node_kind), EqualTo(node_kind,file)]" in text
    assert "ReadSchema: struct<stable_key:string,node_kind:string>" in text


def test_rewriting_a_snapshot_keeps_the_others(spark, tmp_path):
    folder = str(tmp_path)

    def rows(snapshot, count):
        return spark.createDataFrame(
            [(snapshot, f"file:{i}", "file", str(i), None, "observed", None) for i in range(count)], schemas.NODES
        )

    tables.append_facts(rows("s1", 2).unionByName(rows("s2", 2)), folder, "nodes", ["stable_key"])
    tables.append_facts(rows("s2", 5).where("stable_key <> 'file:0'"), folder, "nodes", ["stable_key"])
    tables.append_facts(rows("s2", 5), folder, "nodes", ["stable_key"])
    stored = spark.read.schema(schemas.NODES).parquet(f"{folder}/nodes")
    assert {r.snapshot_id: r["count"] for r in stored.groupBy("snapshot_id").count().collect()} == {"s1": 2, "s2": 5}
    changed = rows("s2", 7).withColumn("node_kind", F.lit("symbol"))
    with pytest.raises(ValueError, match="rows with one identity differ"):
        tables.append_facts(changed, folder, "nodes", ["stable_key"])
    assert spark.read.schema(schemas.NODES).parquet(f"{folder}/nodes").count() == 7


def test_stored_rows_of_one_snapshot_do_not_meet_in_one_task(spark, tmp_path, monkeypatch):
    folder, plans = str(tmp_path), []
    rows = spark.range(4000).select(
        F.concat(F.lit("s"), F.when(F.col("id") < 2000, 1).otherwise(2)).alias("snapshot_id"),
        F.concat(F.lit("file:"), "id").alias("stable_key"),
        F.lit("file").alias("node_kind"),
    )
    first = type(rows).first

    def looked(df):
        plans.append(plan(df))
        return first(df)

    monkeypatch.setattr(type(rows), "first", looked)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        # a snapshot is written by more tasks the more rows it has
        tables.append_facts(rows.where("snapshot_id = 's1'"), folder, "nodes", ["stable_key"])
        split = list((tmp_path / "nodes" / "snapshot_id=s1").glob("part-*"))
        tables.append_facts(rows, folder, "nodes", ["stable_key"])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(plans) == 2 and not any(re.search(r"SortMergeJoin[^\n]*\[snapshot_id#\d+\]", p) for p in plans)
    stored = spark.read.parquet(f"{folder}/nodes")
    assert {r.snapshot_id: r["count"] for r in stored.groupBy("snapshot_id").count().collect()} == {"s1": 2000, "s2": 2000}
    assert len(split) > 16


def test_markdown_file_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int")
    lines = tables.markdown_lines(spark, 1, ["# T", ""]).unionByName(tables.markdown_table(rows, 2, ["name", "n"], [F.col("name")]))
    lines = lines.unionByName(tables.markdown_bullets(rows.select("name"), 3, "name"))
    tables.write_markdown(lines, str(tmp_path / "out"))
    written = [line for part in sorted((tmp_path / "out").glob("part-*")) for line in part.read_text().splitlines()]
    assert written == ["# T", "", "| name | n |", "| --- | --- |", "| a | 1 |", "| b | 2 |", "- a", "- b"]


def test_purge_takes_failed_only(spark):
    table = spark.createDataFrame([("f1",), ("f2",), ("ok",), ("ok",)], "snapshot_id string")
    states = spark.createDataFrame([("f1", "failed"), ("f2", "failed"), ("ok", "completed"), ("gone", "failed")], "snapshot_id string, state string")
    assert sorted(r[0] for r in tables.purge(table, states).collect()) == ["ok", "ok"]


def test_no_query_uses_a_cartesian_product(spark):
    names = ("r1_unique_candidate", "r9_three_tiers", "j8_r11_smallest_containing_span", "j11_first_support", "b1_multiset_match", "r6_absolute_import_files", "v7_observations", "v8_edges", "v9_assertions")
    for name in names:
        text = plan(catalog.QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_hot_paths_have_no_python(spark):
    for name in ("r1_unique_candidate", "w2_occurrence_ordinal", "h1_tree_digest", "f1_f2_normalize_path", "c1_c4_file_role_and_layer"):
        text = plan(catalog.QUERIES[name](spark, FOLDER))
        assert "Python" not in text and "InPandas" not in text, name
