"""Graph walks."""

from pyspark.sql import functions as F

from lodegraph.operators import traversal
from lodegraph.plans import guards
from lodegraph.queries import bindings as b
from lodegraph.queries.registry import query
from lodegraph.session import written


def _impact_sql(start: str, near: str, far: str) -> str:
    """Levels of the walk; the test graph has fewer than seven."""
    head = b.ctes("edges") + f""", use AS (SELECT * FROM edges WHERE predicate IN ('depends_on','imports')),
 l0 AS (SELECT '{start}' AS node_key, 0 AS depth)"""
    body, seen = "", "SELECT node_key FROM l0"
    for i in range(1, 8):
        body += f""",
 l{i} AS (SELECT node_key, {i} AS depth, edge_id FROM (
   SELECT {far} AS node_key, edge_id,
     row_number() OVER (PARTITION BY {far} ORDER BY subject_key, predicate, object_key, edge_id) AS r
   FROM use WHERE {near} IN (SELECT node_key FROM l{i - 1}) AND {far} NOT IN ({seen})) WHERE r=1)"""
        seen += f" UNION ALL SELECT node_key FROM l{i}"
    rows = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, 8))
    return f"""{head}{body} SELECT depth, node_key, edge_id, false AS limit_reached FROM ({rows})"""


def _plain_edges(spark, folder):
    """Edges without their ids, which the operators make for the rows that they return."""
    return b.edges(spark, folder).drop("edge_id")


@query("g1_impact_inbound", _impact_sql("region:0", "object_key", "subject_key"))
def impact_inbound(spark, folder):
    return traversal.impact(_plain_edges(spark, folder), "region:0", "inbound")


@query("g1_impact_outbound", _impact_sql("order:1", "subject_key", "object_key"))
def impact_outbound(spark, folder):
    return traversal.impact(_plain_edges(spark, folder), "order:1", "outbound")


@query(
    "g2_impact_both",
    "SELECT 'inbound' AS direction, * FROM (" + _impact_sql("nation:3", "object_key", "subject_key") + ") UNION ALL SELECT 'outbound', * FROM (" + _impact_sql("nation:3", "subject_key", "object_key") + ")",
)
def impact_both(spark, folder):
    return traversal.impact_both(b.nodes(spark, folder), _plain_edges(spark, folder), "nation:3")


@query(
    "g3_subtree",
    b.ctes("edges", recursive=True)
    + """, roots AS (SELECT stable_key AS root FROM (SELECT 'supplier:'||s_suppkey AS stable_key FROM supplier UNION ALL SELECT 'nation:'||n_nationkey FROM nation)),
      link AS (SELECT DISTINCT subject_key AS s, object_key AS o FROM edges),
      r AS (SELECT root, root AS node FROM roots UNION SELECT r.root, o FROM r JOIN link ON s=node)
      SELECT root, node FROM r UNION SELECT o, s FROM link WHERE o IN (SELECT root FROM roots)""",
)
def subtree(spark, folder):
    roots = b.nodes(spark, folder).where("node_kind IN ('supplier', 'nation')").select(F.col("stable_key").alias("root"))
    return traversal.subtree(b.edges(spark, folder), roots)


def _guard_graph(spark, folder):
    """Orders route to customers, customers inject nations, nations call suppliers, suppliers call parts."""
    edges = _plain_edges(spark, folder)

    def pick(subject, obj, predicate, flip):
        rows = edges.where((F.col("subject_kind") == subject) & (F.col("object_kind") == obj))
        ends = ("object_key", "subject_key") if flip else ("subject_key", "object_key")
        return rows.select(
            F.col(ends[0]).alias("subject_key"), F.lit(predicate).alias("predicate"), F.col(ends[1]).alias("object_key")
        )

    # sealed edges are a stored table that every level of the walk scans
    graph = written(
        pick("order", "customer", "routes_to", False)
        .unionByName(pick("customer", "nation", "injects", False))
        .unionByName(pick("supplier", "nation", "calls", True))
        .unionByName(pick("part", "supplier", "calls", True)),
        "guard-graph",
    )
    nations = b.table(spark, folder, "nation").where("n_regionkey < 3")
    parts = b.table(spark, folder, "part").where("p_type = 'PROMO'")
    roles = nations.select(F.concat(F.lit("nation:"), "n_nationkey").alias("key"), F.lit(guards.GUARD).alias("role")).unionByName(
        parts.select(
            F.concat(F.lit("part:"), "p_partkey").alias("key"),
            F.when(F.col("p_size") > 25, "service").otherwise("model").alias("role"),
        )
    )
    tests = (
        b.table(spark, folder, "customer")
        .where("c_mktsegment = 'MACHINERY'")
        .select(F.concat(F.lit("customer:"), "c_custkey").alias("key"))
    )
    evidenced = b.nodes(spark, folder).where("node_kind <> 'supplier'").select(F.col("stable_key").alias("key"))
    return graph, roles, tests, evidenced


_GUARD_SQL = """guard AS (SELECT n_nationkey FROM nation WHERE n_regionkey<3),
  anc AS (SELECT DISTINCT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey=o_custkey JOIN guard ON n_nationkey=c_nationkey WHERE c_mktsegment<>'MACHINERY'),
  used AS (SELECT DISTINCT c_nationkey AS g FROM anc),
  d2 AS (SELECT g, l_partkey AS p, min('supplier:'||s_suppkey) AS s FROM used JOIN supplier ON s_nationkey=g JOIN lineitem ON l_suppkey=s_suppkey GROUP BY ALL),
  hit AS (SELECT d2.*, p_size FROM d2 JOIN part ON p_partkey=p WHERE p_type='PROMO'),
  hop AS (SELECT 'nation:'||g AS guard, 'nation:'||g AS subject_key, s AS object_key, 1 AS depth FROM hit GROUP BY ALL UNION ALL SELECT 'nation:'||g, s, 'part:'||p, 2 FROM hit)"""


@query(
    "g4_guard_anchors",
    f"WITH {_GUARD_SQL} SELECT 'order:'||o_orderkey AS route, 'customer:'||c_custkey AS handler, 'nation:'||c_nationkey AS guard FROM anc",
)
def guard_anchors(spark, folder):
    graph, roles, tests, _ = _guard_graph(spark, folder)
    return guards.anchors(graph, roles, tests)


@query("g4_guard_hops", f"WITH {_GUARD_SQL} SELECT guard, subject_key, object_key, depth FROM hop")
def guard_hops(spark, folder):
    graph, roles, tests, _ = _guard_graph(spark, folder)
    found = guards.anchors(graph, roles, tests)
    return guards.used_hops(guards.guard_paths(graph, found), roles)


@query(
    "g5_m6_guard_claims",
    f"""WITH {_GUARD_SQL} SELECT DISTINCT 'route' AS kind, 'order:'||o_orderkey AS key, 'observed' AS confidence FROM anc UNION SELECT 'middleware','nation:'||c_nationkey,'heuristic' FROM anc
      UNION SELECT CASE WHEN p_size>25 THEN 'service' ELSE 'model' END,'part:'||p,'heuristic' FROM hit""",
)
def guard_claims(spark, folder):
    return guards.explain(*_guard_graph(spark, folder))["claims"]


@query(
    "g5_m6_guard_relationships",
    f"""WITH {_GUARD_SQL} SELECT 'order:'||o_orderkey AS subject_key, 'routes_to' AS predicate, 'customer:'||c_custkey AS object_key FROM anc
      UNION SELECT 'customer:'||c_custkey,'injects','nation:'||c_nationkey FROM anc UNION SELECT subject_key,'calls',object_key FROM hop""",
)
def guard_relationships(spark, folder):
    return guards.explain(*_guard_graph(spark, folder))["relationships"]


@query(
    "c3_j7_guard_role",
    b.ctes("nodes") + """SELECT stable_key FROM nodes WHERE node_kind='part' AND stable_key IN (SELECT 'part:'||l_partkey FROM lineitem WHERE l_returnflag='R') AND regexp_matches(name||stable_key,'red.*token|gold|(?i)verify|credential|(?i)RED widget')""",
)
def guard_role(spark, folder):
    from lodegraph.functions.roles import is_guard_name

    injected = (
        b.table(spark, folder, "lineitem")
        .where("l_returnflag = 'R'")
        .select(F.concat(F.lit("part:"), "l_partkey").alias("stable_key"))
        .distinct()
    )
    named = b.nodes(spark, folder).where("node_kind = 'part'").join(injected, "stable_key", "left_semi")
    # "red widget" is renamed so that some targets carry a guard word
    spoken = F.replace("name", F.lit("red widget"), F.lit("Verify_user"))
    return named.where(is_guard_name(spoken)).select("stable_key")


@query(
    "g6_defined_in_tests",
    b.ctes("ev") + "SELECT DISTINCT fact_id FROM ev WHERE fact_id NOT IN (SELECT fact_id FROM ev WHERE extractor='F' AND extractor_version='R')",
)
def defined_outside_tests(spark, folder):
    evidence = b.evidence(spark, folder)
    tests = evidence.where("extractor = 'F' AND extractor_version = 'R'").select("fact_id").distinct()
    return evidence.select("fact_id").distinct().join(tests, "fact_id", "left_anti")
