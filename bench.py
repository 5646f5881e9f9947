"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs over the whole tables into a sink that reads all rows: once for ``queries``, a second time for
``warm``.  ``duckdb`` has the seconds that the query's SQL check takes on the same files.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodegraph.queries import catalog  # noqa: E402
from lodegraph.session import build_session  # noqa: E402

HEADLINE = (
    "a1_count_by_predicate",
    "a3_label_coverage",
    "a6_merged_dependencies",
    "a11_dominant_language",
    "b1_multiset_match",
    "b3_b4_scores_by_dimension",
    "c1_c4_file_role_and_layer",
    "c5_c6_c7_c8_c9_dispositions",
    "f1_f2_normalize_path",
    "f17_edge_id",
    "g1_impact_inbound",
    "g4_guard_hops",
    "h1_tree_digest",
    "j3_evidence_per_parent",
    "j8_r11_smallest_containing_span",
    "j9_consolidate_facts",
    "j11_first_support",
    "m2_dependency_nodes",
    "m3_review_findings",
    "m4_j14_j15_lifted_edges",
    "r1_unique_candidate",
    "r7_resolve_imports",
    "r9_three_tiers",
    "s9_requirements",
    "t1_anchored_windows_hour",
    "v8_edges",
    "w2_occurrence_ordinal",
    "w5_lineage_sequence",
)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels".split()


def duck(folder: str, cpus: str):
    import duckdb

    connection = duckdb.connect(config={"threads": cpus})
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine and its Python workers before the first timing
    spark.read.parquet(f"{folder}/region.parquet").count()
    wanted = sys.argv[1:]
    seconds, warm, checks = {}, {}, {}
    connection = duck(folder, cpus)

    def timed(run) -> float:
        begin = time.perf_counter()
        run()
        return round(time.perf_counter() - begin, 3)

    for name in HEADLINE:
        if wanted and name not in wanted:
            continue

        def run(name=name) -> None:
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

        seconds[name], warm[name] = timed(run), timed(run)
        checks[name] = timed(lambda name=name: connection.execute(catalog.CHECKS[name]).fetchall())
        print(name, seconds[name], warm[name], checks[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "warm": warm,
                "duckdb": checks,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
