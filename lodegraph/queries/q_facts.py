"""Filters, joins, pages and set operations over fact tables."""

from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.operators import facts
from lodegraph.operators.ranking import ranked
from lodegraph.queries import bindings as b
from lodegraph.queries.registry import query


@query(
    "p1_j1_sealed_for_owner",
    "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderstatus='F' AND c_mktsegment='BUILDING'",
)
def sealed_for_owner(spark, folder):
    snapshots = b.table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("building").alias("state"),
    )
    owners = b.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return facts.sealed_for_owner(snapshots, owners, "c_custkey").drop("state")


@query("p2_nodes_of_kind", b.ctes("nodes") + "SELECT stable_key, name FROM nodes WHERE node_kind IN ('part','supplier')")
def nodes_of_kind(spark, folder):
    return facts.of_kind(b.nodes(spark, folder), "part", "supplier").select("stable_key", "name")


@query(
    "p3_evidence_listing",
    b.ctes("ev") + "SELECT fact_id, path, start_line, end_line, extractor, extractor_version FROM ev WHERE extractor='O' AND extractor_version='N'",
)
def evidence_listing(spark, folder):
    return b.evidence(spark, folder).where("extractor = 'O' AND extractor_version = 'N'")


@query(
    "p4_neighbours",
    b.ctes("edges") + "SELECT subject_key, predicate, object_key FROM edges WHERE subject_key='supplier:7' OR object_key='supplier:7'",
)
def neighbours(spark, folder):
    return facts.neighbours(b.edges(spark, folder), "supplier:7").select("subject_key", "predicate", "object_key")


@query(
    "p5_j6_endpoint_nodes",
    b.ctes("nodes", "edges") + """SELECT node_kind, stable_key FROM nodes WHERE node_kind IN ('region','order') UNION ALL
      SELECT node_kind, stable_key FROM nodes WHERE node_kind NOT IN ('region','order') AND stable_key IN (SELECT subject_key FROM edges WHERE predicate='calls' UNION SELECT object_key FROM edges WHERE predicate='calls')""",
)
def endpoint_nodes(spark, folder):
    calls = b.edges(spark, folder).where("predicate = 'calls'")
    return facts.endpoint_nodes(b.nodes(spark, folder), calls, ("region", "order")).select("node_kind", "stable_key")


@query(
    "p6_json_declarations",
    """SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS start_line, CAST(NULL AS VARCHAR) AS version, event_type AS name FROM events""",
)
def json_declarations(spark, folder):
    # a wrong type becomes null: k is a number, so it is a line and never a version text
    parsed = F.try_parse_json("props")
    line = F.try_variant_get(parsed, "$.k", "bigint")
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.k", "variant")) == "STRING"
    return b.table(spark, folder, "events").select(
        "event_id",
        line.alias("start_line"),
        F.when(is_text, F.try_variant_get(parsed, "$.k", "string")).alias("version"),
        F.col("event_type").alias("name"),
    )


@query(
    "p7_declared_only",
    b.ctes("decl") + """SELECT dep_key, count(*) FILTER (WHERE fact_kind='declaration') AS n FROM decl GROUP BY dep_key HAVING count(*) FILTER (WHERE fact_kind='declaration')>0
      OR min(CASE WHEN version='A' THEN manifest_path END) IS NOT NULL""",
)
def declared_only(spark, folder):
    grouped = (
        b.declarations(spark, folder)
        .groupBy("dep_key")
        .agg(
            F.count_if(F.col("fact_kind") == "declaration").alias("n"),
            F.min(F.when(F.col("version") == "A", F.col("manifest_path"))).alias("manifest_path"),
        )
        .withColumn("declarations", F.when(F.col("n") > 0, F.array("n")).otherwise(F.array().cast("array<bigint>")))
    )
    return facts.declared_only(grouped).select("dep_key", "n")


@query(
    "p8_p9_findings_filter",
    b.ctes("diag") + "SELECT event_id, path FROM diag WHERE code='RI-SRC-MALFORMED' AND severity='error' AND regexp_extract(path,'[^:]*$') IN ('3','28','53','78','103','128')",
)
def findings_filter(spark, folder):
    rows = facts.filter_findings(b.diagnostics(spark, folder), code="RI-SRC-MALFORMED", severity="error", path=None)
    manifest = F.substring_index("path", ":", -1).isin("3", "28", "53", "78", "103", "128")
    return rows.where(manifest).select("event_id", "path")


@query(
    "p12_drop_test_only_routes",
    b.ctes("ev") + """SELECT 'order:'||o_orderkey AS fact_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM ev WHERE fact_id='order:'||o_orderkey)
      OR EXISTS (SELECT 1 FROM ev WHERE fact_id='order:'||o_orderkey AND NOT (extractor='F' AND extractor_version='R'))""",
)
def drop_test_only_routes(spark, folder):
    routes = b.table(spark, folder, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("fact_id"))
    role = F.when((F.col("extractor") == "F") & (F.col("extractor_version") == "R"), "test")
    return facts.drop_test_only(routes, b.evidence(spark, folder).withColumn("role", role), "fact_id")


@query(
    "p15_visible_edges",
    b.ctes("edges") + "SELECT edge_id FROM edges WHERE subject_key='nation:3' OR object_key='nation:3'",
)
def visible_edges(spark, folder):
    return facts.visible_edges(b.edges(spark, folder), "nation:3").select("edge_id")


@query(
    "j2_has_evidence_reference",
    b.ctes("ev") + """SELECT o_orderkey, EXISTS (SELECT 1 FROM ev WHERE fact_id='order:'||o_orderkey AND path='part:'||o_custkey) AS cited FROM orders""",
)
def has_evidence_reference(spark, folder):
    citations = b.table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("order:"), "o_orderkey").alias("fact_id"),
        F.concat(F.lit("part:"), "o_custkey").alias("path"),
    )
    return facts.has_evidence(citations, b.evidence(spark, folder), ["fact_id", "path"]).select("o_orderkey", "cited")


@query(
    "j3_evidence_per_parent",
    b.ctes("ev") + """SELECT fact_id, path, start_line, end_line, extractor, extractor_version, row_number() OVER (PARTITION BY fact_id ORDER BY path,start_line,end_line,extractor,extractor_version) AS position FROM ev""",
)
def evidence_per_parent(spark, folder):
    rows = b.evidence(spark, folder)
    order = ["path", "start_line", "end_line", "extractor", "extractor_version"]
    # a prefix of the path never decreases along path order
    return ranked(rows, ["fact_id"], order, F.substring("path", 1, 7), "position")


@query(
    "j4_derivations_per_edge",
    """SELECT edge, ref_kind, ref, row_number() OVER (PARTITION BY edge ORDER BY ref_rank, ref) AS position FROM (
      SELECT DISTINCT 'order:'||l_orderkey AS edge, CASE l_linestatus WHEN 'O' THEN 'observation' ELSE 'node' END AS ref_kind, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS ref_rank, 'part:'||l_partkey AS ref FROM lineitem)""",
)
def derivations_per_edge(spark, folder):
    kind = F.when(F.col("l_linestatus") == "O", "observation").otherwise("node")
    rows = (
        b.table(spark, folder, "lineitem")
        .select(
            F.concat(F.lit("order:"), "l_orderkey").alias("edge"),
            kind.alias("ref_kind"),
            F.concat(F.lit("part:"), "l_partkey").alias("ref"),
        )
        .distinct()
        .withColumn("ref_rank", identity.reference_rank("ref_kind"))
    )
    granule = F.concat(F.col("ref_rank").cast("string"), F.substring("ref", 1, 7))
    return ranked(rows, ["edge"], ["ref_rank", "ref"], granule, "position").drop("ref_rank")


@query(
    "j5_identity_of_evidence_parent",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linestatus WHEN 'O' THEN 'node:'||p_name ELSE 'edge:'||o_orderpriority END AS identity
      FROM lineitem JOIN part ON p_partkey=l_partkey JOIN orders ON o_orderkey=l_orderkey""",
)
def identity_of_parent(spark, folder):
    open_line = F.col("l_linestatus") == "O"
    evidence = b.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(open_line, "node").otherwise("edge").alias("parent_kind"),
        F.when(open_line, F.col("l_partkey")).otherwise(F.col("l_orderkey")).alias("parent_id"),
    )
    nodes = b.table(spark, folder, "part").select(
        F.col("p_partkey").alias("parent_id"), F.concat(F.lit("node:"), "p_name").alias("identity")
    )
    edges = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("parent_id"), F.concat(F.lit("edge:"), "o_orderpriority").alias("identity")
    )
    return facts.parent_identity(evidence, [("node", nodes), ("edge", edges)]).drop("parent_kind", "parent_id")


_LINES_SQL = "l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey FROM lineitem)"


@query(
    "j9_consolidate_facts",
    f"WITH {_LINES_SQL} SELECT l_orderkey, l_linenumber, count(*) AS n_rows, min(l_returnflag) AS l_returnflag FROM l GROUP BY ALL HAVING count(DISTINCT l_returnflag)=1",
)
def consolidate_facts(spark, folder):
    rows = b.table(spark, folder, "lineitem")
    return facts.consolidate(rows, ["l_orderkey", "l_linenumber"], ["l_returnflag"], ["l_partkey"])[0]


@query(
    "j9_consolidate_evidence",
    f"WITH {_LINES_SQL} SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM l",
)
def consolidate_evidence(spark, folder):
    rows = b.table(spark, folder, "lineitem")
    return facts.consolidate(rows, ["l_orderkey", "l_linenumber"], ["l_returnflag"], ["l_partkey"])[1]


@query(
    "j9_consolidate_conflicts",
    f"WITH {_LINES_SQL} SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM l GROUP BY ALL HAVING count(DISTINCT l_returnflag)>1",
)
def consolidate_conflicts(spark, folder):
    rows = b.table(spark, folder, "lineitem")
    return facts.consolidate(rows, ["l_orderkey", "l_linenumber"], ["l_returnflag"], ["l_partkey"])[2]


def support_inputs(spark, folder):
    """(diagnostics, evidence): errors are diagnosed, all other events are their evidence."""
    user = F.col("user_id").cast("string")
    diagnostics = b.diagnostics(spark, folder).withColumn(
        "candidates",
        F.array(
            F.concat(F.lit("obs:"), user),
            F.concat(F.lit("subject:"), user),
            F.concat(F.lit("object:"), user),
            F.concat(F.lit("file:user:"), user),
        ),
    )
    kind = F.col("event_type")
    prefix = F.when(kind == "view", "obs:").when(kind == "click", "subject:").otherwise("file:user:")
    evidence = (
        b.table(spark, folder, "events")
        .where("event_type <> 'error'")
        .select(
            F.concat(prefix, user).alias("fact_id"),
            F.concat(F.lit("user:"), user).alias("path"),
            (b.k_of_props() + 1).alias("start_line"),
            (b.k_of_props() + 1).alias("end_line"),
            F.when(kind == "signup", "file").otherwise("span").alias("granularity"),
            kind.alias("extractor"),
            F.col("event_id").cast("string").alias("extractor_version"),
        )
    )
    return diagnostics, evidence


SUPPORT_SQL = """sev AS (SELECT CASE event_type WHEN 'view' THEN 'obs:' WHEN 'click' THEN 'subject:' ELSE 'file:user:' END||user_id AS fact_id, 'user:'||user_id AS path,
   CAST(json_extract(props,'$.k') AS INT)+1 AS line, CASE event_type WHEN 'signup' THEN 'file' ELSE 'span' END AS granularity, event_type AS extractor, CAST(event_id AS VARCHAR) AS extractor_version FROM events WHERE event_type<>'error'),
  opt AS (SELECT event_id, path, span_start, span_end, unnest([0,1,2,3]) AS pr, unnest(['obs:'||user_id,'subject:'||user_id,'object:'||user_id,'file:user:'||user_id]) AS fact_id FROM diag),
  hit AS (SELECT o.event_id, o.pr, o.fact_id, line, extractor, extractor_version, CASE WHEN span_start IS NULL THEN 'file_scoped' ELSE 'supported' END AS support,
     row_number() OVER (PARTITION BY o.event_id ORDER BY pr, line, extractor, extractor_version) AS r
    FROM opt o JOIN sev s ON s.fact_id=o.fact_id AND s.path=o.path AND ((span_start=line AND span_end=line) OR (span_start IS NULL AND granularity='file'))),
  sup AS (SELECT d.*, h.fact_id, h.line, h.extractor, h.extractor_version, coalesce(h.support,'unsupported') AS support FROM diag d LEFT JOIN hit h ON h.event_id=d.event_id AND r=1)"""


@query(
    "j11_first_support",
    b.ctes("diag") + f", {SUPPORT_SQL} SELECT event_id, support, fact_id, line AS start_line, extractor, extractor_version FROM sup",
)
def first_support(spark, folder):
    diagnostics, evidence = support_inputs(spark, folder)
    return facts.support(diagnostics, evidence, "event_id").select(
        "event_id", "support", "fact_id", "start_line", "extractor", "extractor_version"
    )


@query(
    "j13_declared_and_observed_producers",
    """WITH d AS (SELECT DISTINCT p_brand AS producer FROM part), o AS (SELECT 'Brand#'||(l_suppkey%30) AS producer, count(*) AS n FROM lineitem GROUP BY ALL)
      SELECT coalesce(d.producer,o.producer) AS producer, d.producer IS NOT NULL AS declared, coalesce(n,0) AS n FROM d FULL JOIN o USING (producer)""",
)
def producers_side_by_side(spark, folder):
    declared = b.table(spark, folder, "part").select(F.col("p_brand").alias("producer"))
    observed = (
        b.table(spark, folder, "lineitem")
        .groupBy(F.concat(F.lit("Brand#"), F.col("l_suppkey") % 30).alias("producer"))
        .agg(F.count("*").alias("n"))
    )
    return facts.zero_filled_full_outer(declared, observed, "producer", "n")


@query(
    "k1_page_of_orders",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200",
)
def page_of_orders(spark, folder):
    rows = b.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return facts.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 200, 100)


@query(
    "k2_canonical_edge_page",
    b.ctes("edges") + "SELECT subject_key, predicate, object_key, edge_id, (SELECT count(*) FROM edges) AS total FROM edges ORDER BY subject_key, predicate, object_key, edge_id LIMIT 50",
)
def canonical_edge_page(spark, folder):
    order = ["subject_key", "predicate", "object_key", "edge_id"]
    return facts.page(b.edges(spark, folder).select(*order), [F.col(c) for c in order], 0, 50)


@query(
    "k5_k6_first_files_per_folder",
    b.ctes("files") + """SELECT folder, path, position, n-least(n,4) AS more FROM (SELECT split_part(path,'/',1) AS folder, path, row_number() OVER (PARTITION BY split_part(path,'/',1) ORDER BY path) AS position, count(*) OVER (PARTITION BY split_part(path,'/',1)) AS n FROM files) WHERE position<=4""",
)
def first_files_per_folder(spark, folder):
    rows = b.files(spark, folder).select(F.substring_index("path", "/", 1).alias("folder"), "path")
    sizes = rows.groupBy("folder").agg(F.count("*").alias("n"))
    shown = facts.top_per_group(rows, ["folder"], [F.col("path")], 4)
    return shown.join(sizes, "folder").select("folder", "path", "position", (F.col("n") - F.least("n", F.lit(4))).alias("more"))


@query(
    "k8_edge_list_view",
    b.ctes("edges") + "SELECT object_kind, predicate, subject_key, object_key FROM edges ORDER BY object_kind, predicate, subject_key DESC, object_key",
)
def edge_list_view(spark, folder):
    columns = ["object_kind", "predicate", "subject_key", "object_key"]
    order = [F.asc("object_kind"), F.asc("predicate"), F.desc("subject_key"), F.asc("object_key")]
    return b.edges(spark, folder).select(*columns).orderBy(*order)


@query(
    "k8_edge_list_by_names",
    b.ctes("edges", "nodes") + """SELECT e.edge_id, coalesce(s.name, e.subject_key) AS source, coalesce(o.name, e.object_key) AS target
      FROM edges e LEFT JOIN nodes s ON s.stable_key=e.subject_key LEFT JOIN nodes o ON o.stable_key=e.object_key""",
)
def edge_list_by_names(spark, folder):
    # edges of line items become distinct where they are dealt out by their subject for its name
    edges = b.edges(spark, folder, distinct=False).select("subject_key", "predicate", "object_key")
    edges = edges.repartition("subject_key").distinct()
    return facts.edge_list(b.nodes(spark, folder), edges).select("edge_id", "source", "target")


@query(
    "k8_k2_node_list",
    b.ctes("nodes") + """SELECT stable_key, name, CASE node_kind WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'order' THEN 3 END AS layer FROM nodes""",
)
def node_list(spark, folder):
    layers = F.array(*map(F.lit, ("region", "nation", "customer", "order")))
    place = F.array_position(layers, F.col("node_kind"))
    nodes = b.nodes(spark, folder).withColumn("layer", F.when(place > 0, (place - 1).cast("int")))
    return facts.node_list(nodes, F.col("layer")).select("stable_key", "name", "layer")


@query(
    "k8_k2_diagnostic_list",
    b.ctes("diag") + """SELECT event_id, code, path, span_start, CASE severity WHEN 'fatal' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS rank FROM diag""",
)
def diagnostic_list(spark, folder):
    return facts.diagnostic_list(b.diagnostics(spark, folder), "event_id").select(
        "event_id", "code", "path", "span_start", "rank"
    )


@query(
    "u1_set_operations",
    """SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
      UNION ALL SELECT 'any', doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""",
)
def set_operations(spark, folder):
    documents = b.table(spark, folder, "documents").select("doc_id")
    labels = b.table(spark, folder, "labels").select("doc_id")
    sides = (
        ("both", documents.intersect(labels)),
        ("unlabelled", documents.subtract(labels)),
        ("any", documents.union(labels).distinct()),
    )
    tagged = [df.select(F.lit(name).alias("side"), "doc_id") for name, df in sides]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "u2_concatenated_diagnostics",
    b.ctes("diag") + ", a AS (SELECT code, path, 'events' AS producer FROM diag UNION ALL SELECT 'RI-LABEL-TOXIC','doc:'||doc_id,'labels' FROM labels WHERE toxic=1) SELECT producer, code, count(*) AS n, count(DISTINCT path) AS paths FROM a GROUP BY ALL",
)
def concatenated_diagnostics(spark, folder):
    events = b.diagnostics(spark, folder).select("code", "path", F.lit("events").alias("producer"))
    labels = (
        b.table(spark, folder, "labels")
        .where("toxic = 1")
        .select(
            F.lit("RI-LABEL-TOXIC").alias("code"),
            F.concat(F.lit("doc:"), "doc_id").alias("path"),
            F.lit("labels").alias("producer"),
        )
    )
    return (
        events.unionByName(labels)
        .groupBy("producer", "code")
        .agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))
    )
