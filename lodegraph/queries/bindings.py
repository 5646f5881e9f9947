"""Views that give the driver tables the shapes the operators work on.

Every view exists twice: as a DataFrame function and, for the checks, as SQL text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.identity import edge_id

PART_TYPES = ("ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def edges(spark, folder, distinct: bool = True) -> DataFrame:
    """All edges.  Without ``distinct`` those of line items repeat, for a caller that makes rows distinct after a shuffle."""

    def branch(df, subject, predicate, obj):
        (subject_kind, subject_col), (object_kind, object_col) = subject, obj
        return df.select(
            F.lit(subject_kind).alias("subject_kind"),
            _key(subject_kind, subject_col).alias("subject_key"),
            F.lit(predicate).alias("predicate"),
            F.lit(object_kind).alias("object_kind"),
            _key(object_kind, object_col).alias("object_key"),
        )

    lines = table(spark, folder, "lineitem")

    def pairs(*columns):
        found = lines.select(*columns)
        return found.distinct() if distinct else found

    parts = [
        branch(table(spark, folder, "nation"), ("nation", "n_nationkey"), "depends_on", ("region", "n_regionkey")),
        branch(table(spark, folder, "supplier"), ("supplier", "s_suppkey"), "depends_on", ("nation", "s_nationkey")),
        branch(table(spark, folder, "customer"), ("customer", "c_custkey"), "depends_on", ("nation", "c_nationkey")),
        branch(table(spark, folder, "orders"), ("order", "o_orderkey"), "imports", ("customer", "o_custkey")),
        branch(pairs("l_orderkey", "l_partkey"), ("order", "l_orderkey"), "imports", ("part", "l_partkey")),
        branch(pairs("l_partkey", "l_suppkey"), ("part", "l_partkey"), "calls", ("supplier", "l_suppkey")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.withColumn("edge_id", edge_id("subject_key", "predicate", "object_key"))


def nodes(spark, folder) -> DataFrame:
    def branch(name, kind, key, label):
        return table(spark, folder, name).select(
            F.lit(kind).alias("node_kind"), _key(kind, key).alias("stable_key"), F.col(label).cast("string").alias("name")
        )

    return (
        branch("region", "region", "r_regionkey", "r_name")
        .unionByName(branch("nation", "nation", "n_nationkey", "n_name"))
        .unionByName(branch("supplier", "supplier", "s_suppkey", "s_name"))
        .unionByName(branch("customer", "customer", "c_custkey", "c_name"))
        .unionByName(branch("part", "part", "p_partkey", "p_name"))
        .unionByName(branch("orders", "order", "o_orderkey", "o_orderpriority"))
    )


def k_of_props():
    return F.get_json_object("props", "$.k").cast("int")


def observations(spark, folder) -> DataFrame:
    types = F.array(*[F.lit(t) for t in PART_TYPES])
    return table(spark, folder, "events").select(
        F.col("event_id").alias("observation_id"),
        F.concat(F.lit("Brand#"), F.col("user_id") % 25 + 1).alias("brand"),
        F.element_at(types, (F.col("event_id") % 6 + 1).cast("int")).alias("type"),
        (k_of_props() % 50 + 1).alias("size"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("path"),
        (k_of_props() + 1).alias("line"),
    )


def declarations(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("dep:pypi:"), "l_partkey", F.lit("-"), "l_suppkey").alias("dep_key"),
        F.concat(F.lit("order:"), "l_orderkey").alias("manifest_path"),
        F.col("l_linenumber").alias("start_line"),
        F.col("l_returnflag").alias("version"),
        F.when(F.col("l_discount") < 0.05, "production").otherwise("development").alias("dependency_type"),
        F.when(F.col("l_linestatus") == "O", "declaration").otherwise("resolution").alias("fact_kind"),
    )


def diagnostics(spark, folder) -> DataFrame:
    codes = ("RI-RES-UNRESOLVED", "RI-RES-AMBIGUOUS", "RI-EXT-UNSUPPORTED", "RI-SRC-MALFORMED", "RI-OTHER")
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("user_id") % 5 + 1).cast("int"))
    value = F.col("value")
    span = F.when(F.col("event_id") % 4 != 0, k_of_props() + 1)
    return (
        table(spark, folder, "events")
        .where(F.col("event_type") == "error")
        .select(
            "event_id",
            "user_id",
            code.alias("code"),
            F.when(value < 15, "info").when(value < 35, "warning").when(value < 100, "error").otherwise("fatal").alias("severity"),
            F.concat(F.lit("user:"), F.col("user_id")).alias("path"),
            span.alias("span_start"),
            span.alias("span_end"),
        )
    )


def evidence(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("order:"), "l_orderkey").alias("fact_id"),
        F.concat(F.lit("part:"), "l_partkey").alias("path"),
        F.col("l_linenumber").alias("start_line"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5).alias("end_line"),
        F.col("l_linestatus").alias("extractor"),
        F.col("l_returnflag").alias("extractor_version"),
    )


def revisions(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("revision_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderpriority").alias("branch"),
        F.col("o_orderdate").alias("created_at"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("revision_value"),
        F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice")).cast("long").alias("size"),
    )


def jobs(spark, folder) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("repository_id"),
        F.when(status == "O", "queued").when(status == "P", "running").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_add("HOUR", (F.col("o_orderkey") % 72).cast("int"), F.col("o_orderdate")).alias("lease_expires_at"),
        (F.col("o_orderkey") % 7).alias("attempt"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("next_attempt_at"),
    )


def named_documents(spark, folder) -> DataFrame:
    """documents with a repository path, one row per document."""
    doc = F.col("doc_id")
    name = (
        F.when(doc % 7 == 0, F.lit("__init__.py"))
        .when(doc % 5 == 1, F.concat(F.lit("service_"), doc, F.lit(".ts")))
        .when(doc % 5 == 2, F.concat(F.lit("user_model_"), doc, F.lit(".py")))
        .when(doc % 5 == 3, F.concat(F.lit("routes/r"), doc, F.lit(".py")))
        .when(doc % 5 == 4, F.concat(F.lit("README_"), doc, F.lit(".md")))
        .otherwise(F.concat(F.lit("m"), doc, F.lit(".py")))
    )
    return table(spark, folder, "documents").withColumn("path", F.concat_ws("/", "source", "lang", name))


def files(spark, folder) -> DataFrame:
    """Distinct paths with their size."""
    return named_documents(spark, folder).groupBy("path").agg(F.max("n_chars").alias("size"))


def imports(spark, folder) -> DataFrame:
    """(source_path, specifier) pairs seen in FILES."""
    doc = F.col("doc_id")
    named = named_documents(spark, folder)
    is_ts = F.col("path").endswith(".ts")
    is_model = F.col("path").contains("/user_model_")
    relative = named.where(is_ts).select("path", F.concat(F.lit("./service_"), doc + 20).alias("specifier"))
    dotted = named.where(is_model).select(
        "path", F.explode(F.array(F.concat("lang", F.lit(".user_model_"), doc + 20), F.col("lang"))).alias("specifier")
    )
    package = named.select(
        "path", F.when(is_ts, "react").when(is_model, "Foo_Bar").otherwise("requests").alias("specifier")
    )
    return (
        relative.unionByName(dotted)
        .unionByName(package)
        .select(F.col("path").alias("source_path"), "specifier")
        .distinct()
    )


def declared_packages(spark, folder) -> DataFrame:
    """Dependency keys declared for FILES: one npm and one PyPI package per language."""
    langs = table(spark, folder, "documents").select("lang").distinct()
    return langs.select(
        F.explode(
            F.array(F.lit("dep:npm:react"), F.lit("dep:pypi:foo-bar"), F.concat(F.lit("dep:pypi:"), "lang"))
        ).alias("dep_key")
    ).distinct()


_EDGE_SQL = """
  SELECT 'nation' AS subject_kind, 'nation:'||n_nationkey AS subject_key, 'depends_on' AS predicate,
         'region' AS object_kind, 'region:'||n_regionkey AS object_key FROM nation
  UNION ALL SELECT 'supplier','supplier:'||s_suppkey,'depends_on','nation','nation:'||s_nationkey FROM supplier
  UNION ALL SELECT 'customer','customer:'||c_custkey,'depends_on','nation','nation:'||c_nationkey FROM customer
  UNION ALL SELECT 'order','order:'||o_orderkey,'imports','customer','customer:'||o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'order','order:'||l_orderkey,'imports','part','part:'||l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'part','part:'||l_partkey,'calls','supplier','supplier:'||l_suppkey FROM lineitem
"""

SQL = {
    "e0": _EDGE_SQL,
    "edges": """SELECT *, 'edge:sha256:'||sha256(subject_key||chr(31)||predicate||chr(31)||object_key) AS edge_id FROM e0""",
    "nodes": """
  SELECT 'region' AS node_kind, 'region:'||r_regionkey AS stable_key, r_name AS name FROM region
  UNION ALL SELECT 'nation','nation:'||n_nationkey,n_name FROM nation
  UNION ALL SELECT 'supplier','supplier:'||s_suppkey,s_name FROM supplier
  UNION ALL SELECT 'customer','customer:'||c_custkey,c_name FROM customer
  UNION ALL SELECT 'part','part:'||p_partkey,p_name FROM part
  UNION ALL SELECT 'order','order:'||o_orderkey,o_orderpriority FROM orders""",
    "obs": """
  SELECT event_id AS observation_id, 'Brand#'||(user_id%25+1) AS brand,
    ['ECONOMY','SMALL','STANDARD','MEDIUM','LARGE','PROMO'][CAST(event_id%6+1 AS INT)] AS type,
    CAST(json_extract(props,'$.k') AS INT)%50+1 AS size, 'user:'||user_id AS path,
    CAST(json_extract(props,'$.k') AS INT)+1 AS line FROM events""",
    "decl": """
  SELECT 'dep:pypi:'||l_partkey||'-'||l_suppkey AS dep_key, 'order:'||l_orderkey AS manifest_path,
    l_linenumber AS start_line, l_returnflag AS version,
    CASE WHEN l_discount < 0.05 THEN 'production' ELSE 'development' END AS dependency_type,
    CASE WHEN l_linestatus='O' THEN 'declaration' ELSE 'resolution' END AS fact_kind FROM lineitem""",
    "diag": """
  SELECT event_id, user_id,
    ['RI-RES-UNRESOLVED','RI-RES-AMBIGUOUS','RI-EXT-UNSUPPORTED','RI-SRC-MALFORMED','RI-OTHER'][CAST(user_id%5+1 AS INT)] AS code,
    CASE WHEN value<15 THEN 'info' WHEN value<35 THEN 'warning' WHEN value<100 THEN 'error' ELSE 'fatal' END AS severity,
    'user:'||user_id AS path,
    CASE WHEN event_id%4<>0 THEN CAST(json_extract(props,'$.k') AS INT)+1 END AS span_start,
    CASE WHEN event_id%4<>0 THEN CAST(json_extract(props,'$.k') AS INT)+1 END AS span_end
  FROM events WHERE event_type='error'""",
    "ev": """
  SELECT 'order:'||l_orderkey AS fact_id, 'part:'||l_partkey AS path, l_linenumber AS start_line,
    l_linenumber + CAST(trunc(l_quantity) AS INT)%5 AS end_line, l_linestatus AS extractor, l_returnflag AS extractor_version
  FROM lineitem""",
    "rev": """
  SELECT o_orderkey AS revision_id, o_custkey AS owner_id, o_orderpriority AS branch, o_orderdate AS created_at,
    sha256(CAST(o_orderkey AS VARCHAR)) AS revision_value, o_orderstatus AS status,
    CAST(round(o_totalprice) AS BIGINT) AS size FROM orders""",
    "job": """
  SELECT o_orderkey AS job_id, o_custkey AS repository_id,
    CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
    o_orderdate AS created_at, o_orderdate + to_hours(CAST(o_orderkey%72 AS INT)) AS lease_expires_at,
    o_orderkey%7 AS attempt, CASE WHEN o_orderpriority<>'5-LOW' THEN o_orderdate END AS next_attempt_at FROM orders""",
    "named": """
  SELECT *, source||'/'||lang||'/'||CASE WHEN doc_id%7=0 THEN '__init__.py' WHEN doc_id%5=1 THEN 'service_'||doc_id||'.ts'
    WHEN doc_id%5=2 THEN 'user_model_'||doc_id||'.py' WHEN doc_id%5=3 THEN 'routes/r'||doc_id||'.py'
    WHEN doc_id%5=4 THEN 'README_'||doc_id||'.md' ELSE 'm'||doc_id||'.py' END AS path FROM documents""",
    "files": """SELECT path, max(n_chars) AS size FROM named GROUP BY path""",
    "imports": """
  SELECT DISTINCT path AS source_path, specifier FROM (
    SELECT path, './service_'||(doc_id+20) AS specifier FROM named WHERE path LIKE '%.ts'
    UNION ALL SELECT path, lang||'.user_model_'||(doc_id+20) FROM named WHERE contains(path,'/user_model_')
    UNION ALL SELECT path, lang FROM named WHERE contains(path,'/user_model_')
    UNION ALL SELECT path, CASE WHEN path LIKE '%.ts' THEN 'react' WHEN contains(path,'/user_model_') THEN 'Foo_Bar'
      ELSE 'requests' END FROM named)""",
    "declared": """
  SELECT DISTINCT unnest(['dep:npm:react','dep:pypi:foo-bar','dep:pypi:'||lang]) AS dep_key FROM documents""",
}

_NEEDS = {"edges": ["e0"], "files": ["named"], "imports": ["named"]}


def ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause holding the named views and what they need; further CTEs may follow a comma."""
    ordered: list[str] = []
    for name in names:
        for item in [*_NEEDS.get(name, []), name]:
            if item not in ordered:
                ordered.append(item)
    keyword = "WITH RECURSIVE " if recursive else "WITH "
    return keyword + ", ".join(f"{n} AS ({SQL[n]})" for n in ordered)
