"""Aggregations, sequences and job reports over whole tables."""

from pyspark.sql import functions as F

from lodegraph.functions import paths, roles
from lodegraph.operators import lineage, summaries
from lodegraph.operators.ranking import ranked, running_total, with_slices
from lodegraph.queries import bindings as b
from lodegraph.queries.q_functions import _ROLE_SQL
from lodegraph.queries.registry import query


@query("a1_count_by_predicate", b.ctes("edges") + "SELECT predicate, count(*) AS n FROM edges GROUP BY predicate")
def count_by_predicate(spark, folder):
    return summaries.counts(b.edges(spark, folder), "predicate")


@query("a1_count_by_code_and_severity", b.ctes("diag") + "SELECT code, severity, count(*) AS n FROM diag GROUP BY ALL")
def count_by_code(spark, folder):
    return summaries.counts(b.diagnostics(spark, folder), "code", "severity")


@query("a2_count_by_extractor", b.ctes("ev") + "SELECT extractor, extractor_version, count(*) AS n FROM ev GROUP BY ALL")
def count_by_extractor(spark, folder):
    return summaries.counts(b.evidence(spark, folder), "extractor", "extractor_version")


@query(
    "a3_label_coverage",
    """SELECT lang, count(*) AS denominator, count(l.doc_id) AS numerator, count(l.doc_id)/count(*) AS ratio, 'measured' AS state
      FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang""",
)
def label_coverage(spark, folder):
    documents = b.table(spark, folder, "documents").select("doc_id", "lang")
    return summaries.coverage(documents, b.table(spark, folder, "labels"), "doc_id", "lang")


def _dependency_facts(spark, folder):
    return b.declarations(spark, folder).withColumn("name", F.concat_ws("@", "dep_key", "version"))


@query(
    "a6_merged_dependencies",
    b.ctes("decl") + """, m AS (SELECT DISTINCT dep_key, fact_kind, manifest_path, start_line, version, dependency_type FROM decl)
      SELECT dep_key, (SELECT d.dep_key||'@'||version FROM decl d WHERE d.dep_key=m.dep_key ORDER BY CASE fact_kind WHEN 'declaration' THEN 0 ELSE 1 END, manifest_path, start_line, version LIMIT 1) AS name,
        count(*) FILTER (WHERE fact_kind='declaration') AS declarations, count(*) FILTER (WHERE fact_kind='resolution') AS resolutions FROM m GROUP BY dep_key""",
)
def merged_dependencies(spark, folder):
    return summaries.merge_dependencies(_dependency_facts(spark, folder))[0]


@query(
    "a6_dependency_members",
    b.ctes("decl") + "SELECT DISTINCT dep_key, fact_kind, manifest_path, start_line, version, dependency_type FROM decl",
)
def dependency_members(spark, folder):
    return summaries.merge_dependencies(_dependency_facts(spark, folder))[1]


@query("a7_evidence_by_producer", b.ctes("decl") + "SELECT dep_key, fact_kind, count(*) AS n FROM decl GROUP BY ALL")
def evidence_by_producer(spark, folder):
    return summaries.counts(b.declarations(spark, folder), "dep_key", "fact_kind")


@query(
    "a8_single_version_or_null",
    b.ctes("decl") + """, v AS (SELECT dep_key, CASE version WHEN 'N' THEN NULL ELSE version END AS version, dependency_type FROM decl)
      SELECT dep_key, CASE WHEN count(DISTINCT coalesce(version,'?'))=1 THEN max(version) END AS version, CASE WHEN count(DISTINCT dependency_type)=1 THEN max(dependency_type) ELSE 'multiple' END AS type FROM v GROUP BY dep_key""",
)
def single_version(spark, folder):
    rows = b.declarations(spark, folder).withColumn("version", F.nullif("version", F.lit("N")))
    return rows.groupBy("dep_key").agg(
        summaries.single_or_null("version").alias("version"),
        summaries.single_or("dependency_type", "multiple").alias("type"),
    )


@query(
    "a9_manifest_count",
    b.ctes("decl", "diag") + "SELECT count(DISTINCT p) AS manifests FROM (SELECT manifest_path AS p FROM decl UNION ALL SELECT path FROM diag)",
)
def manifest_count(spark, folder):
    manifests = b.declarations(spark, folder).select("manifest_path").distinct()
    return (
        manifests.union(b.diagnostics(spark, folder).select("path").distinct())
        .agg(F.countDistinct("manifest_path").alias("manifests"))
    )


@query(
    "a10_version_conflicts",
    b.ctes("decl") + """, f AS (SELECT dep_key, version, min(manifest_path||'|'||start_line) AS first_at FROM decl GROUP BY ALL)
      SELECT dep_key, string_agg(version, ',' ORDER BY first_at, version) AS versions, count(*)>1 AS conflict FROM f GROUP BY dep_key""",
)
def version_conflicts(spark, folder):
    position = F.concat_ws("|", "manifest_path", "start_line")
    firsts = summaries.first_positions(b.declarations(spark, folder), ["dep_key"], "version", position)
    # at most three distinct return flags per key
    ordered = F.array_sort(F.collect_list(F.struct("first_at", "version")))
    return (
        firsts.groupBy("dep_key")
        .agg(ordered.alias("v"))
        .select(
            "dep_key",
            F.array_join(F.transform("v", lambda x: x["version"]), ",").alias("versions"),
            (F.size("v") > 1).alias("conflict"),
        )
    )


@query(
    "a11_dominant_language",
    """SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r=1""",
)
def dominant_language(spark, folder):
    return summaries.dominant(b.table(spark, folder, "documents"), ["source"], "lang", "doc_id")


@query(
    "a12_modules",
    b.ctes("files") + f""", r AS (SELECT path, size, {_ROLE_SQL} AS role FROM files), m AS (SELECT *, 'module:'||CASE role WHEN 'route' THEN 'api' WHEN 'service' THEN 'services' WHEN 'model' THEN 'domain'
        WHEN 'documentation' THEN 'documentation' ELSE split_part(path,'/',1) END AS module_id FROM r)
      SELECT module_id, count(*) AS files, min(path) AS first_path, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY module_id""",
)
def modules(spark, folder):
    return (
        b.files(spark, folder)
        .withColumn("role", roles.file_role("path"))
        .groupBy(roles.module_id("path", "role", F.lit(False)).alias("module_id"))
        .agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.sum("size").alias("bytes"))
    )


@query(
    "a13_common_path_prefix",
    b.ctes("files") + """, p AS (SELECT source, lang, path FROM named) SELECT source, CASE WHEN count(DISTINCT lang)=1 THEN '/'||source||'/'||min(lang) ELSE '/'||source END AS prefix FROM p GROUP BY source
      UNION ALL SELECT 'all', CASE WHEN count(DISTINCT source)=1 THEN '/'||min(source) ELSE '/' END FROM p
      UNION ALL SELECT source||lang, CASE WHEN count(DISTINCT path)=1 THEN '/'||min(path) WHEN bool_and(contains(path,'/routes/')) THEN '/'||source||'/'||lang||'/routes' ELSE '/'||source||'/'||lang END FROM p GROUP BY source, lang""",
)
def common_path_prefix(spark, folder):
    named = b.named_documents(spark, folder).select("source", "lang", "path")
    groups = F.explode(F.array(F.col("source"), F.lit("all"), F.concat("source", "lang"))).alias("source")
    return named.select(groups, "path").groupBy("source").agg(summaries.path_prefix("path").alias("prefix"))


@query(
    "a14_top_level_symbols",
    """WITH s AS (SELECT 'f'||p_size||'.py::'||p_name||CASE WHEN p_type='PROMO' THEN '.inner' WHEN p_type='SMALL' THEN '#'||p_partkey ELSE '' END AS key FROM part)
      SELECT DISTINCT split_part(key,'::',1) AS path, regexp_replace(split_part(key,'::',2),'#[0-9]+$','') AS symbol FROM s WHERE NOT contains(split_part(key,'::',2),'.')""",
)
def top_level_symbols(spark, folder):
    ending = (
        F.when(F.col("p_type") == "PROMO", ".inner")
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("#"), "p_partkey"))
        .otherwise("")
    )
    key = F.concat(F.lit("f"), "p_size", F.lit(".py::"), "p_name", ending)
    return summaries.top_level_symbols(b.table(spark, folder, "part").select(key.alias("key")))


@query(
    "a15_category_counts",
    b.ctes("diag") + """, c AS (SELECT CASE WHEN code LIKE 'RI-RES%' THEN 'relationship_resolution' WHEN code<>'RI-OTHER' THEN 'source_extraction' END AS category FROM diag)
      SELECT category, (SELECT count(*) FROM c WHERE c.category=s.category) AS n FROM (SELECT unnest(['relationship_resolution','source_extraction','dependency_declarations']) AS category) s""",
)
def category_counts(spark, folder):
    code = F.col("code")
    category = F.when(code.startswith("RI-RES"), "relationship_resolution").when(code != "RI-OTHER", "source_extraction")
    counted = summaries.counts(b.diagnostics(spark, folder).withColumn("category", category), "category")
    return summaries.zero_filled(
        ["relationship_resolution", "source_extraction", "dependency_declarations"], counted, "category"
    )


@query(
    "a16_overall_state",
    b.ctes("diag") + """, s AS (SELECT user_id, CASE severity WHEN 'info' THEN 'assessed' WHEN 'warning' THEN 'partially_assessed' WHEN 'error' THEN 'insufficient_evidence' ELSE 'not_assessed' END AS state FROM diag)
      SELECT user_id, CASE WHEN bool_and(state='assessed') THEN 'assessed' WHEN bool_or(state IN ('assessed','partially_assessed')) THEN 'partially_assessed' WHEN bool_or(state='insufficient_evidence') THEN 'insufficient_evidence' ELSE 'not_assessed' END AS overall FROM s GROUP BY user_id""",
)
def overall_state(spark, folder):
    severity = F.col("severity")
    state = (
        F.when(severity == "info", "assessed")
        .when(severity == "warning", "partially_assessed")
        .when(severity == "error", "insufficient_evidence")
        .otherwise("not_assessed")
    )
    return (
        b.diagnostics(spark, folder)
        .withColumn("state", state)
        .groupBy("user_id")
        .agg(summaries.overall_state("state").alias("overall"))
    )


@query(
    "a17_inventory_totals",
    b.ctes("files") + """SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, (SELECT count(DISTINCT f) FROM (SELECT split_part(path,'/',1) AS f FROM files UNION ALL SELECT split_part(path,'/',1)||'/'||split_part(path,'/',2) FROM files
       UNION ALL SELECT regexp_replace(path,'/[^/]*$','') FROM files)) AS folders FROM files""",
)
def inventory_totals(spark, folder):
    return summaries.inventory_totals(b.files(spark, folder))


@query(
    "a18_cross_layer_relationships",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS layer FROM orders), p AS (SELECT p_partkey, p_type AS layer FROM part), l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
      SELECT o.layer AS source_layer, p.layer AS target_layer, count(*) AS n FROM l JOIN o ON o_orderkey=l_orderkey JOIN p ON p_partkey=l_partkey WHERE o.layer<>p.layer GROUP BY ALL""",
)
def cross_layer(spark, folder):
    from lodegraph.plans.architecture import cross_layer_counts

    layers = (
        b.table(spark, folder, "orders")
        .select(F.concat(F.lit("order:"), "o_orderkey").alias("key"), F.col("o_orderpriority").alias("layer"))
        .unionByName(
            b.table(spark, folder, "part").select(
                F.concat(F.lit("part:"), "p_partkey").alias("key"), F.col("p_type").alias("layer")
            )
        )
    )
    links = b.edges(spark, folder).where("subject_kind = 'order' AND object_kind = 'part'")
    return cross_layer_counts(links, layers)


@query(
    "a19_layer_rollup",
    b.ctes("files") + f""", r AS (SELECT path, {_ROLE_SQL} AS role FROM files), l AS (SELECT split_part(path,'/',1) AS module, CASE WHEN role IN ('entrypoint','controller','route') THEN 'presentation' WHEN role='service' THEN 'business-logic'
       WHEN role IN ('model','dto','interface','enum') THEN 'domain' WHEN role IN ('repository','configuration','test','middleware') THEN 'infrastructure' ELSE 'shared' END AS layer FROM r)
      SELECT layer, CASE layer WHEN 'presentation' THEN 0 WHEN 'business-logic' THEN 1 WHEN 'domain' THEN 2 WHEN 'infrastructure' THEN 3 ELSE 4 END AS position, count(DISTINCT module) AS modules, count(*) AS files FROM l GROUP BY ALL""",
)
def layer_rollup(spark, folder):
    return (
        b.files(spark, folder)
        # the role is its own column first, so that the layer rules do not repeat the role patterns
        .withColumn("role", roles.file_role("path"))
        .select(F.substring_index("path", "/", 1).alias("module"), roles.layer("role").alias("layer"))
        .groupBy("layer")
        .agg(F.countDistinct("module").alias("modules"), F.count("*").alias("files"))
        .withColumn("position", roles.layer_order("layer"))
    )


@query("a20_dependency_types", b.ctes("decl") + "SELECT dependency_type, count(*) AS n, count(DISTINCT dep_key) AS dependencies FROM decl GROUP BY ALL")
def dependency_types(spark, folder):
    return (
        b.declarations(spark, folder)
        .groupBy("dependency_type")
        .agg(F.count("*").alias("n"), F.countDistinct("dep_key").alias("dependencies"))
    )


@query("a21_next_sequence", "SELECT conv_id, max(turn)+1 AS next_sequence FROM conversations GROUP BY conv_id")
def next_sequence(spark, folder):
    return b.table(spark, folder, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_sequence"))


@query(
    "a22_dashboard_totals",
    b.ctes("rev") + "SELECT count(*) AS repositories, count(*) FILTER (WHERE status='F') AS completed, CAST(sum(size) AS BIGINT) AS total_size FROM rev",
)
def dashboard_totals(spark, folder):
    return b.revisions(spark, folder).agg(
        F.count("*").alias("repositories"),
        F.count_if(F.col("status") == "F").alias("completed"),
        F.sum("size").alias("total_size"),
    )


@query(
    "a23_headline_category",
    b.ctes("diag") + """ SELECT severity, code, n FROM (SELECT severity, code, count(*) AS n, row_number() OVER (PARTITION BY severity ORDER BY count(*) DESC, code) AS r FROM diag GROUP BY severity, code) WHERE r=1""",
)
def headline_category(spark, folder):
    from lodegraph.operators.ranking import first_per_key

    counted = summaries.counts(b.diagnostics(spark, folder), "severity", "code")
    return first_per_key(counted, ["severity"], [-F.col("n"), F.col("code")], ["code", "n"])


@query(
    "a24_node_heat",
    b.ctes("nodes", "edges") + """, d AS (SELECT object_key, count(*) AS n FROM edges GROUP BY 1), m AS (SELECT max(n) AS m FROM d)
      SELECT stable_key, coalesce(n,0) AS dependents, round(least(1.0, coalesce(n,0)/greatest(m,1)*0.6 + CASE WHEN length(name)>8 THEN 0.4 ELSE 0 END),9) AS heat FROM nodes LEFT JOIN d ON object_key=stable_key, m""",
)
def node_heat(spark, folder):
    own = F.when(F.length("name") > 8, 1.0).otherwise(0.0)
    heat = summaries.degree_heat(b.edges(spark, folder), b.nodes(spark, folder), own)
    return heat.select("stable_key", "dependents", F.round("heat", 9).alias("heat"))


@query("a25_covered_paths", b.ctes("ev") + "SELECT DISTINCT path FROM ev WHERE extractor<>'F'")
def covered_paths(spark, folder):
    return b.evidence(spark, folder).where("extractor <> 'F'").select("path").distinct()


# --- sequences ---------------------------------------------------------------


@query(
    "w2_occurrence_ordinal",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem""",
)
def occurrence_ordinal(spark, folder):
    lines = b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    month = F.date_trunc("month", "l_shipdate")
    return ranked(lines, ["l_orderkey", "l_linenumber"], order, month, "ordinal").drop("l_extendedprice")


def _snapshots(spark, folder):
    return b.revisions(spark, folder).select(
        F.col("owner_id").alias("repository_id"),
        F.col("revision_id").alias("snapshot_id"),
        "revision_value",
        F.when(F.col("status") == "F", "completed").otherwise("building").alias("state"),
        F.col("created_at").cast("timestamp").alias("sealed_at"),
    )


_LATEST_SQL = "latest AS (SELECT owner_id AS repository_id, revision_id AS snapshot_id, revision_value FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, revision_id) AS r FROM rev WHERE status='F') WHERE r=1)"


@query("w3_latest_sealed_snapshot", b.ctes("rev") + f", {_LATEST_SQL} SELECT * FROM latest")
def latest_sealed(spark, folder):
    return lineage.latest_sealed(_snapshots(spark, folder), "repository_id", ["snapshot_id", "revision_value"])


@query(
    "j12_current_revision_status",
    b.ctes("rev") + f""", {_LATEST_SQL}, cur AS (SELECT owner_id AS repository_id, arg_max(revision_value, (created_at, revision_id)) AS revision_value FROM rev GROUP BY 1)
      SELECT cur.repository_id, CASE WHEN l.revision_value IS NULL THEN 'not_available' WHEN l.revision_value=cur.revision_value THEN 'current' ELSE 'outdated' END AS status FROM cur LEFT JOIN latest l USING (repository_id)""",
)
def current_revision(spark, folder):
    from lodegraph.operators import facts

    snapshots = _snapshots(spark, folder)
    repositories = snapshots.groupBy("repository_id").agg(
        F.max(F.struct("sealed_at", "snapshot_id", "revision_value"))["revision_value"].alias("revision_value")
    )
    latest = lineage.latest_sealed(snapshots, "repository_id", ["revision_value"])
    return facts.current_revision(repositories, latest, "repository_id").select("repository_id", "status")


@query(
    "w4_duplicate_symbol_keys",
    """SELECT p_partkey, CASE WHEN n=1 THEN p_name ELSE p_name||'#'||n END AS key, n>1 AS duplicate FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""",
)
def duplicate_symbol_keys(spark, folder):
    parts = b.table(spark, folder, "part").select("p_partkey", "p_name")
    placed = ranked(parts, ["p_name"], ["p_partkey"], F.shiftright("p_partkey", 16), "n")
    key = F.when(F.col("n") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("#"), "n"))
    return placed.select("p_partkey", key.alias("key"), (F.col("n") > 1).alias("duplicate"))


_KEYS = ["owner_id", "branch"]
_MEMBERS_SQL = "mem AS (SELECT revision_id, owner_id, branch, created_at, status, row_number() OVER (PARTITION BY owner_id, branch ORDER BY created_at, revision_id) AS sequence_no FROM rev)"


def _lineages(spark, folder):
    revisions = b.revisions(spark, folder).select("revision_id", *_KEYS, "created_at", "status", "revision_value")
    return lineage.sequence_lineages(revisions, _KEYS, "created_at", "revision_id")


@query("w5_lineage_sequence", b.ctes("rev") + f", {_MEMBERS_SQL} SELECT revision_id, sequence_no FROM mem")
def lineage_sequence(spark, folder):
    return _lineages(spark, folder)[0].select("revision_id", "sequence_no")


@query(
    "w5_lineage_pointers",
    b.ctes("rev") + f", {_MEMBERS_SQL} SELECT owner_id, branch, arg_max(revision_id, sequence_no) AS latest, arg_min(revision_id, sequence_no) AS first, count(*)+1 AS next_sequence FROM mem GROUP BY ALL",
)
def lineage_pointers(spark, folder):
    return _lineages(spark, folder)[1]


@query(
    "w5_eligible_lineages",
    """WITH r AS (SELECT o_orderkey AS revision_id, o_custkey AS owner_id, o_orderdate AS created_at, o_orderpriority AS name,
        CASE WHEN o_orderkey%5=0 THEN 'upload' ELSE 'github' END AS source, CASE WHEN o_orderkey%11=0 THEN 'archive' ELSE 'git' END AS kind,
        CASE WHEN o_orderkey%7=0 THEN 'short' ELSE sha1(CAST(o_orderkey AS VARCHAR)) END AS value,
        CASE o_orderstatus WHEN 'O' THEN 'refs/heads/main' WHEN 'F' THEN 'refs/tags/v1' ELSE 'HEAD' END AS ref,
        o_orderkey%4 AS form FROM orders),
      e AS (SELECT *, 'github.com/own/repo-'||owner_id%3 AS source_key FROM r WHERE source='github' AND kind='git' AND value<>'short' AND ref<>'HEAD' AND form<>3)
      SELECT owner_id, source_key, ref AS revision_ref, arg_max(revision_id, (created_at, revision_id)) AS latest, arg_min(revision_id, (created_at, revision_id)) AS first,
        count(*)+1 AS next_sequence, arg_min(name, (created_at, revision_id)) AS display_name FROM e GROUP BY ALL""",
)
def eligible_lineages(spark, folder):
    """Orders as imported revisions whose sources are written in several ways, some of them foreign."""
    key = F.col("o_orderkey")
    repo = F.concat(F.lit("repo-"), F.col("o_custkey") % 3)
    form = key % 4
    url = (
        F.when(form == 0, F.concat(F.lit(" https://GitHub.com/Own/"), repo, F.lit(".git/ ")))
        .when(form == 1, F.concat(F.lit("git@github.com:own/"), repo, F.lit(".git")))
        .when(form == 2, F.concat(F.lit("https://github.com/OWN/"), repo))
        .otherwise(F.concat(F.lit("https://example.com/own/"), repo))
    )
    status = F.col("o_orderstatus")
    rows = b.table(spark, folder, "orders").select(
        key.alias("revision_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("name"),
        F.when(key % 5 == 0, "upload").otherwise("github").alias("source"),
        F.when(key % 11 == 0, "archive").otherwise("git").alias("revision_kind"),
        F.when(key % 7 == 0, "short").otherwise(F.sha1(key.cast("string"))).alias("revision_value"),
        F.when(status == "O", "refs/heads/main").when(status == "F", "refs/tags/v1").otherwise("HEAD").alias("revision_ref"),
        url.alias("source_url"),
    )
    keys = ["owner_id", "source_key", "revision_ref"]
    return lineage.sequence_lineages(lineage.eligible(rows), keys, "created_at", "revision_id", "name")[1]


@query(
    "w6_lineage_history",
    b.ctes("rev") + f", {_MEMBERS_SQL} SELECT revision_id, owner_id, branch, sequence_no, sequence_no=max(sequence_no) OVER (PARTITION BY owner_id, branch) AS is_current FROM mem",
)
def lineage_history(spark, folder):
    members, lineages = _lineages(spark, folder)
    return lineage.history(members, lineages, _KEYS, "revision_id").select(
        "revision_id", *_KEYS, "sequence_no", "is_current"
    )


@query(
    "w7_latest_after_delete",
    b.ctes("rev") + f""", {_MEMBERS_SQL} SELECT owner_id, branch, arg_min(revision_id, sequence_no) AS first, count(*)+1 AS next_sequence, arg_max(revision_id, sequence_no) FILTER (WHERE status<>'O') AS latest FROM mem GROUP BY ALL""",
)
def latest_after_delete(spark, folder):
    members, lineages = _lineages(spark, folder)
    deleted = b.revisions(spark, folder).where("status = 'O'").select("revision_id")
    return lineage.after_delete(members, lineages, deleted, _KEYS, "revision_id")


@query(
    "w8_disambiguated_names",
    b.ctes("files") + r""", n AS (SELECT path, regexp_extract(path,'[^/]*$') AS name, split_part(path,'/',-2) AS parent FROM files), c AS (SELECT name, count(*) AS n FROM n GROUP BY 1)
      SELECT path, CASE WHEN c.n>1 AND parent<>'' AND parent<>name THEN parent||'/'||name ELSE name END AS display FROM n JOIN c USING (name)""",
)
def disambiguated_names(spark, folder):
    from lodegraph.plans.architecture import disambiguate

    named = b.files(spark, folder).select("path", paths.basename("path").alias("name"))
    return disambiguate(named, "path", "name").select("path", "display")


@query(
    "w9_job_views",
    b.ctes("job") + """SELECT repository_id, arg_max(job_id, (created_at, job_id)) AS latest_job, arg_max(job_id, (created_at, job_id)) FILTER (WHERE status IN ('queued','running')) AS active_job,
      arg_max(job_id, (created_at, job_id)) FILTER (WHERE status IN ('queued','running','completed')) AS effective_job FROM job GROUP BY 1""",
)
def job_views(spark, folder):
    return lineage.job_views(b.jobs(spark, folder), "repository_id")


@query(
    "w10_appended_turns",
    """WITH m AS (SELECT conv_id, max(turn)+1 AS base FROM conversations WHERE role<>'assistant' GROUP BY 1), i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role='assistant')
      SELECT conv_id, turn, coalesce(base,0)+r-1 AS sequence_no FROM i LEFT JOIN m USING (conv_id)""",
)
def appended_turns(spark, folder):
    turns = b.table(spark, folder, "conversations").select("conv_id", "turn", "role")
    stored = turns.where("role <> 'assistant'").withColumn("sequence_no", F.col("turn"))
    incoming = turns.where("role = 'assistant'").drop("role")
    return lineage.append_turns(stored, incoming, ["conv_id"], "turn", F.shiftright("turn", 12))


@query(
    "w11_byte_budget",
    b.ctes("files") + """, t AS (SELECT split_part(path,'/',1) AS repository, path, CAST(sum(size) OVER (PARTITION BY split_part(path,'/',1) ORDER BY path) AS BIGINT) AS total FROM files)
      SELECT repository, path, total, total>60000 AS over_budget FROM t""",
)
def byte_budget(spark, folder):
    rows = b.files(spark, folder).withColumn("repository", F.substring_index("path", "/", 1))
    sliced = with_slices(rows, ["repository"], ["path"])
    totals = running_total(sliced, ["repository"], ["path"], F.col("_slice"), "size", "total")
    return totals.select("repository", "path", "total", (F.col("total") > 60000).alias("over_budget"))


# --- jobs --------------------------------------------------------------------

_NOW = "1998-06-01 00:00:00"


@query(
    "q1_eligible_backlog",
    b.ctes("job") + f"SELECT repository_id, arg_min(job_id, (created_at, job_id)) AS job_id FROM job WHERE status='queued' AND (next_attempt_at IS NULL OR next_attempt_at<=TIMESTAMP '{_NOW}') GROUP BY 1",
)
def eligible_backlog(spark, folder):
    return lineage.next_per_owner(b.jobs(spark, folder), F.lit(_NOW).cast("timestamp"), "repository_id")


@query(
    "q2_expired_leases",
    b.ctes("job") + f"SELECT job_id, lease_expires_at FROM job WHERE status='running' AND lease_expires_at<TIMESTAMP '{_NOW}'",
)
def expired_leases(spark, folder):
    return lineage.expired_leases(b.jobs(spark, folder), F.lit(_NOW).cast("timestamp")).select("job_id", "lease_expires_at")


@query(
    "q3_submission_triage",
    b.ctes("job") + """, j AS (SELECT repository_id, arg_max(job_id,(created_at,job_id)) FILTER (WHERE status='completed') AS c, arg_max(job_id,(created_at,job_id)) FILTER (WHERE status IN ('queued','running')) AS a FROM job GROUP BY 1)
      SELECT c_custkey AS repository_id, CASE WHEN c IS NOT NULL THEN 'reuse' WHEN a IS NOT NULL THEN 'return_active' ELSE 'enqueue' END AS action, coalesce(c,a) AS job_id FROM customer LEFT JOIN j ON repository_id=c_custkey""",
)
def submission_triage(spark, folder):
    submissions = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("repository_id"))
    return lineage.triage(submissions, b.jobs(spark, folder), "repository_id").select("repository_id", "action", "job_id")


@query(
    "s16_m15_reused_snapshots",
    b.ctes("rev") + """, c AS (SELECT owner_id, branch, min(revision_id) AS reused_id FROM rev WHERE status='F' GROUP BY ALL) SELECT revision_id, reused_id, reused_id IS NOT NULL AS reused FROM rev LEFT JOIN c USING (owner_id, branch)""",
)
def reused_snapshots(spark, folder):
    revisions = b.revisions(spark, folder).select("revision_id", *_KEYS, "status")
    completed = revisions.where("status = 'F'")
    return lineage.reuse_completed(revisions, completed, _KEYS, "revision_id").select("revision_id", "reused_id", "reused")


@query(
    "m14_reanalysis_outcome",
    b.ctes("rev") + """, l AS (SELECT owner_id, branch, arg_max(revision_value,(created_at,revision_id)) AS latest, arg_max(revision_value,(created_at,revision_id)) FILTER (WHERE status<>'P') AS head FROM rev GROUP BY ALL)
      SELECT owner_id, branch, CASE WHEN latest IS NOT DISTINCT FROM head THEN 'already-current' ELSE 'revision-imported' END AS outcome FROM l WHERE head IS NOT NULL""",
)
def reanalysis_outcome(spark, folder):
    members = _lineages(spark, folder)[0]
    latest = lineage.last_member(members, _KEYS, ["revision_value"])
    heads = (
        b.revisions(spark, folder)
        .where("status <> 'P'")
        .groupBy(*_KEYS)
        .agg(F.max(F.struct("created_at", "revision_id", "revision_value"))["revision_value"].alias("head_value"))
    )
    return lineage.reanalysis(latest, heads, _KEYS).select(*_KEYS, "outcome")


@query(
    "m16_repository_listing",
    b.ctes("rev") + "SELECT revision_id, owner_id, branch, created_at FROM rev ORDER BY created_at DESC, revision_id",
)
def repository_listing(spark, folder):
    """All owners' revisions of all branches, newest first."""
    listed = b.revisions(spark, folder).select("revision_id", "owner_id", "branch", "created_at")
    return listed.orderBy(F.desc("created_at"), "revision_id")


@query(
    "m15_duplicate_revisions",
    b.ctes("rev") + "SELECT revision_id FROM rev a WHERE status='O' AND EXISTS (SELECT 1 FROM rev b WHERE b.status='F' AND b.owner_id=a.owner_id AND b.branch=a.branch)",
)
def duplicate_revisions(spark, folder):
    revisions = b.revisions(spark, folder)
    return lineage.duplicate_revisions(revisions.where("status = 'O'"), revisions.where("status = 'F'"), _KEYS).select(
        "revision_id"
    )


