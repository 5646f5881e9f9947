"""Read models over whole tables."""

from pyspark.sql import functions as F

from lodegraph.functions import identity, paths, roles
from lodegraph.operators import resolve
from lodegraph.plans import architecture, dependencies, dispositions, insights, manifests, reports, review
from lodegraph.queries import bindings as b
from lodegraph.queries.q_facts import SUPPORT_SQL, support_inputs
from lodegraph.queries.q_functions import _ROLE_SQL
from lodegraph.queries.q_resolve import _ABSOLUTE_SQL, _ROOTS_SQL
from lodegraph.queries.registry import query
from lodegraph.session import checkpoint

# --- dispositions ------------------------------------------------------------


def _disposition_inputs(spark, folder):
    """One import and one call observation per document; every sixth kind of specifier takes turns."""
    doc, path = F.col("doc_id"), F.col("path")
    number = doc.cast("string")
    python = F.array(
        F.concat("lang", F.lit(".user_model_"), number), F.lit("os.path"), F.lit("yaml"), F.lit(".rel"),
        F.lit("requests"), F.lit("Foo_Bar.x"),
    )
    script = F.array(
        F.concat(F.lit("@/service_"), number), F.lit("fs/promises"), F.lit("./style.css"), F.lit("react"),
        F.lit("lodash"), F.lit("./x?raw"),
    )
    turn = (doc % 6 + 1).cast("int")
    named = b.named_documents(spark, folder).select(
        "doc_id",
        "lang",
        "source",
        "path",
        F.when(path.endswith(".py"), F.element_at(python, turn))
        .when(path.endswith(".ts"), F.element_at(script, turn))
        .otherwise(F.lit("other"))
        .alias("specifier"),
        F.element_at(F.array(F.lit("len"), F.lit("imp"), F.lit("other")), (doc % 3 + 1).cast("int")).alias("called"),
    )
    both = named.select(
        "*",
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("i"), number).alias("observation_id"), F.lit("import").alias("observed_kind"), F.col("specifier").alias("referent_text")),
                F.struct(F.concat(F.lit("c"), number).alias("observation_id"), F.lit("call").alias("observed_kind"), F.col("called").alias("referent_text")),
            )
        ),
    )
    diagnostics = both.select(
        "observation_id",
        "source",
        F.when(F.col("source") != "src3", path).alias("path"),
        F.when((F.col("observed_kind") == "call") & (F.col("lang") == "es"), resolve.SHADOWED).otherwise("no target").alias("message"),
    )
    observations = both.select("observation_id", "observed_kind", "referent_text")
    bindings = named.select("path", F.concat("specifier", F.lit("|x|imp")).alias("referent"), F.col("doc_id").alias("position"))
    declared = b.declared_packages(spark, folder).where(~F.col("dep_key").rlike("^dep:pypi:[a-z]{2}$"))
    declared = declared.unionByName(spark.range(1).select(F.lit("dep:pypi:pyyaml").alias("dep_key")))
    return diagnostics, observations, bindings, declared, b.files(spark, folder)


_DISPOSITION_SQL = """n AS (SELECT doc_id, lang, source, path, CASE WHEN path LIKE '%.py' THEN [lang||'.user_model_'||doc_id,'os.path','yaml','.rel','requests','Foo_Bar.x'][CAST(doc_id%6+1 AS INT)]
     WHEN path LIKE '%.ts' THEN ['@/service_'||doc_id,'fs/promises','./style.css','react','lodash','./x?raw'][CAST(doc_id%6+1 AS INT)] ELSE 'other' END AS specifier, ['len','imp','other'][CAST(doc_id%3+1 AS INT)] AS called FROM named),
  bound AS (SELECT path, arg_min(specifier, doc_id) AS spec FROM n GROUP BY path),
  o AS (SELECT 'i'||doc_id AS observation_id, source, lang, path, 'import' AS kind, specifier AS ref, specifier AS spec FROM n
    UNION ALL SELECT 'c'||doc_id, source, lang, n.path, 'call', called, CASE WHEN called='imp' THEN spec END FROM n JOIN bound USING (path)),
  d AS (SELECT observation_id, source, CASE WHEN source='src3' THEN 'gap' WHEN kind='call' AND lang='es' THEN 'local-binding'
     WHEN kind='call' AND spec IS NULL THEN CASE WHEN ref='len' AND path LIKE '%.py' THEN 'external' ELSE 'gap' END
     WHEN path LIKE '%.py' AND spec IN ('os.path','yaml','Foo_Bar.x') OR path LIKE '%.ts' AND spec IN ('fs/promises','react') THEN 'external'
     WHEN path LIKE '%.ts' AND spec IN ('./style.css','./x?raw') THEN 'non-code-asset'
     WHEN path LIKE '%.ts' AND spec LIKE '@/%' THEN 'in-repo-target-exists'
     WHEN path LIKE '%.py' AND spec LIKE '__.user~_model%' ESCAPE '~' AND (source||'/'||replace(spec,'.','/')||'.py' IN (SELECT path FROM files) OR source||'/'||lang||'/__init__.py' IN (SELECT path FROM files)) THEN 'in-repo-target-exists'
     ELSE 'gap' END AS disposition FROM o)"""


@query("c5_c6_c7_c8_c9_dispositions", b.ctes("files") + f", {_DISPOSITION_SQL} SELECT observation_id, disposition FROM d")
def disposition_of_unresolved(spark, folder):
    return dispositions.classify(*_disposition_inputs(spark, folder)).select("observation_id", "disposition")


_SPLIT_SQL = """count(*) FILTER (WHERE disposition IN ('gap','in-repo-target-exists')) AS in_repo_gap, count(*) FILTER (WHERE disposition='external') AS external_reference,
   count(*) FILTER (WHERE disposition='local-binding') AS local_binding, count(*) FILTER (WHERE disposition='non-code-asset') AS non_code_asset, count(*) AS total"""


@query("a5_unresolved_split", b.ctes("files") + f", {_DISPOSITION_SQL} SELECT source, {_SPLIT_SQL} FROM d GROUP BY source")
def unresolved_split(spark, folder):
    return dispositions.split_counts(dispositions.classify(*_disposition_inputs(spark, folder)), "source")


# --- insights ----------------------------------------------------------------


def _metric_inputs(spark, folder):
    files = b.files(spark, folder).select(
        F.concat(F.lit("file:"), "path").alias("stable_key"), F.lit("file").alias("node_kind"), roles.language("path").alias("language")
    )
    none = F.lit(None).cast("string").alias("language")
    symbols = b.table(spark, folder, "part").select(
        F.concat(F.lit("part::"), "p_partkey").alias("stable_key"), F.lit("symbol").alias("node_kind"), none
    )
    packages = b.declarations(spark, folder).select(
        F.col("dep_key").alias("stable_key"), F.lit("dependency").alias("node_kind"), none
    ).distinct()
    named = b.named_documents(spark, folder).select("doc_id", "path")
    labelled = named.join(b.table(spark, folder, "labels").select("doc_id"), "doc_id").select(
        "path", F.lit("labels").alias("extractor"), F.lit("1").alias("extractor_version")
    )
    evidence = labelled.unionByName(
        named.select("path", F.lit(insights.INVENTORY).alias("extractor"), F.lit("1").alias("extractor_version"))
    )
    return files.unionByName(symbols).unionByName(packages), b.edges(spark, folder), evidence, b.diagnostics(spark, folder)


@query(
    "m1_a4_insight_metrics",
    b.ctes("files", "edges", "decl", "diag") + f""", {_DISPOSITION_SQL}, u AS (SELECT {_SPLIT_SQL} FROM d), sem AS (SELECT DISTINCT path FROM named JOIN labels USING (doc_id)),
      c AS (SELECT count(*) AS den, count(sem.path) AS num FROM files LEFT JOIN sem USING (path)),
      m(id, value, unit, state, numerator, denominator) AS (
       SELECT 'nodes.files.total', CAST((SELECT count(*) FROM files) AS DOUBLE), 'nodes','assessed', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL SELECT 'nodes.symbols.total',(SELECT count(*) FROM part),'nodes','assessed',NULL,NULL
       UNION ALL SELECT 'nodes.dependencies.total',(SELECT count(DISTINCT dep_key) FROM decl),'nodes','assessed',NULL,NULL UNION ALL SELECT 'relationships.resolved.total',(SELECT count(*) FROM edges),'relationships','assessed',NULL,NULL
       UNION ALL SELECT 'evidence.records.total',(SELECT count(*) FROM labels)+(SELECT count(*) FROM documents),'records','assessed',NULL,NULL
       UNION ALL SELECT 'diagnostics.relationships.unresolved',in_repo_gap,'diagnostics','assessed',NULL,NULL FROM u UNION ALL SELECT 'diagnostics.relationships.external-references',external_reference,'diagnostics','assessed',NULL,NULL FROM u
       UNION ALL SELECT 'diagnostics.relationships.local-bindings',local_binding+non_code_asset,'diagnostics','assessed',NULL,NULL FROM u
       UNION ALL SELECT 'diagnostics.relationships.ambiguous',(SELECT count(*) FROM diag WHERE code='RI-RES-AMBIGUOUS'),'diagnostics','assessed',NULL,NULL
       UNION ALL SELECT 'diagnostics.source.unsupported',(SELECT count(*) FROM diag WHERE code='RI-EXT-UNSUPPORTED'),'diagnostics','assessed',NULL,NULL
       UNION ALL SELECT 'diagnostics.source.malformed',(SELECT count(*) FROM diag WHERE code='RI-SRC-MALFORMED'),'diagnostics','assessed',NULL,NULL
       UNION ALL SELECT 'extraction.files.semantic',num,'files','assessed',NULL,NULL FROM c UNION ALL SELECT 'extraction.files.eligible',den,'files','assessed',NULL,NULL FROM c
       UNION ALL SELECT 'extraction.coverage',num/den,'ratio','assessed',num,den FROM c UNION ALL SELECT 'assessment.vulnerability-scanning',NULL,'status','not_assessed',NULL,NULL)
      SELECT * FROM m""",
)
def insight_metrics(spark, folder):
    unresolved = dispositions.split_counts(dispositions.classify(*_disposition_inputs(spark, folder)))
    return insights.metrics(*_metric_inputs(spark, folder), unresolved)


@query(
    "m1_extractors",
    "SELECT name, version, records FROM (SELECT 'labels' AS name, '1' AS version, count(*) AS records FROM labels UNION ALL SELECT 'repository-inventory','1',count(*) FROM documents UNION ALL SELECT DISTINCT p_type, p_brand, 0 FROM part)",
)
def insight_extractors(spark, folder):
    evidence = _metric_inputs(spark, folder)[2]
    producers = b.table(spark, folder, "part").select(F.concat_ws("@", "p_type", "p_brand").alias("producer"))
    return insights.extractors(producers, evidence)


# --- dependencies ------------------------------------------------------------


def _declared(spark, folder):
    rows = b.declarations(spark, folder).where("fact_kind = 'declaration'")
    return rows.withColumn("name", F.col("dep_key"))


@query(
    "m2_dependency_nodes",
    b.ctes("decl") + """SELECT dep_key, dep_key AS name, CASE WHEN count(DISTINCT version)=1 THEN max(version) END AS version, CASE WHEN count(DISTINCT dependency_type)=1 THEN max(dependency_type) ELSE 'multiple' END AS type,
      count(*) AS declarations FROM decl WHERE fact_kind='declaration' GROUP BY dep_key""",
)
def dependency_nodes(spark, folder):
    return dependencies.dependency_nodes(_declared(spark, folder))


@query(
    "m2_dependency_edges",
    b.ctes("edges", "decl") + "SELECT edge_id, subject_key AS source, object_key AS target FROM edges WHERE predicate='depends_on' AND object_key IN (SELECT 'nation:'||CAST(start_line AS VARCHAR) FROM decl)",
)
def dependency_edges(spark, folder):
    nodes = b.declarations(spark, folder).select(F.concat(F.lit("nation:"), "start_line").alias("dep_key")).distinct()
    return dependencies.dependency_edges(b.edges(spark, folder), nodes)


@query(
    "m2_dependency_totals",
    b.ctes("decl", "diag") + """SELECT (SELECT count(DISTINCT dep_key) FROM decl WHERE fact_kind='declaration') AS dependencies, (SELECT count(DISTINCT p) FROM (SELECT manifest_path AS p FROM decl WHERE fact_kind='declaration'
      UNION ALL SELECT path||'/package.json' FROM diag WHERE code IN ('RI-SRC-MALFORMED','RI-EXT-UNSUPPORTED'))) AS manifests""",
)
def dependency_totals(spark, folder):
    declared = _declared(spark, folder)
    diagnostics = b.diagnostics(spark, folder).withColumn("path", F.concat("path", F.lit("/package.json")))
    relevant = dependencies.manifest_diagnostics(diagnostics, ("RI-SRC-MALFORMED", "RI-EXT-UNSUPPORTED"))
    return dependencies.totals(dependencies.dependency_nodes(declared), declared, relevant)


# --- review ------------------------------------------------------------------


def _findings(spark, folder):
    diagnostics, evidence = support_inputs(spark, folder)
    full = diagnostics.withColumns(
        {"snapshot_id": F.lit("s1"), "producer": F.lit("events"), "message": F.concat(F.lit("event "), "event_id")}
    )
    expected = full.where("code = 'RI-RES-UNRESOLVED' AND severity = 'info'")
    return review.build_findings(full, evidence, expected, "event_id"), full


_FINDING_SQL = f"""{SUPPORT_SQL}, f0 AS (SELECT *, CASE WHEN code LIKE 'RI-RES%' THEN 'relationship_resolution' ELSE 'source_extraction' END AS category,
   CASE severity WHEN 'fatal' THEN 'critical' WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'info' END AS level,
   'evidence:'||sha256('{{"endLine":'||line||',"extractor":"'||extractor||'","extractorVersion":"'||extractor_version||'","factId":"'||fact_id||'","path":"'||path||'","snapshotId":"s1","startLine":'||line||'}}') AS evidence_id
   FROM sup WHERE support<>'unsupported' AND code<>'RI-OTHER' AND NOT (code='RI-RES-UNRESOLVED' AND severity='info')),
  f AS (SELECT *, 'finding:'||sha256('{{"code":"'||code||'","evidenceId":"'||evidence_id||'","factId":"'||fact_id||'","message":"event '||event_id||'","producer":"events","snapshotId":"s1"}}') AS finding_id,
   CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 4 END AS rank FROM f0)"""


@query(
    "m3_review_findings",
    b.ctes("diag") + f", {_FINDING_SQL} SELECT event_id, category, level AS severity, support, evidence_id, finding_id FROM f",
)
def review_findings(spark, folder):
    return _findings(spark, folder)[0].select("event_id", "category", "severity", "support", "evidence_id", "finding_id")


@query(
    "k3_k4_review_page",
    b.ctes("diag") + f""", {_FINDING_SQL} SELECT finding_id, rank, category, path, line AS start_line, (SELECT count(*) FROM f WHERE category='relationship_resolution') AS total FROM f WHERE category='relationship_resolution'
      ORDER BY rank, category, path, line, code, finding_id LIMIT 200 OFFSET 20""",
)
def review_page(spark, folder):
    page = review.finding_page(_findings(spark, folder)[0], 20, 200, category="relationship_resolution")
    return page.select("finding_id", "rank", "category", "path", "start_line", "total")


@query(
    "m3_review_categories",
    b.ctes("diag") + f""", {_FINDING_SQL}, c(category, label, state) AS (VALUES ('architecture_boundaries','Architecture and boundaries','partially_assessed'),('relationship_resolution','Relationship resolution','assessed'),
      ('source_extraction','Source extraction','partially_assessed'),('dependency_declarations','Dependency declarations','insufficient_evidence'),('security_vulnerability_scanning','Security vulnerability scanning','not_assessed'),
      ('authentication_evidence','Authentication evidence','partially_assessed'),('repository_structure','Repository structure','insufficient_evidence'),('analysis_integrity','Analysis integrity','assessed'))
      SELECT category, label, state, (SELECT count(*) FROM f WHERE f.category=c.category) AS n FROM c""",
)
def review_categories(spark, folder):
    findings, diagnostics = _findings(spark, folder)
    return review.category_states(findings, diagnostics, b.nodes(spark, folder))


@query(
    "m3_review_summary",
    b.ctes("diag") + f""", {_FINDING_SQL} SELECT count(*) AS findings, count(*) FILTER (WHERE level='critical') AS critical, count(*) FILTER (WHERE level='high') AS high, count(*) FILTER (WHERE level='medium') AS medium,
      count(*) FILTER (WHERE level='info') AS info, count(*) FILTER (WHERE support='file_scoped') AS file_scoped, (SELECT count(*) FROM diag)-count(*) AS omitted, 'partially_assessed' AS overall FROM f""",
)
def review_summary(spark, folder):
    findings, diagnostics = _findings(spark, folder)
    categories = review.category_states(findings, diagnostics, b.nodes(spark, folder))
    return review.summary(findings, diagnostics, categories)


# --- architecture ------------------------------------------------------------


def _architecture(spark, folder):
    """Imports between files and packages, declarations of the repository, and folder modules."""
    files = b.files(spark, folder).select(
        "path", roles.file_role("path").alias("role"), F.col("path").endswith(".py").alias("defines_symbols")
    )
    imports = b.imports(spark, folder)
    declared = b.declared_packages(spark, folder)
    resolved = resolve.resolve_imports(imports, b.files(spark, folder), declared).where("code IS NULL")
    from_files = resolved.select(
        F.lit("file").alias("subject_kind"),
        F.concat(F.lit("file:"), "source_path").alias("subject_key"),
        F.lit("imports").alias("predicate"),
        F.when(F.col("tier") == 1, "file").otherwise("dependency").alias("object_kind"),
        F.col("target").alias("object_key"),
        F.col("source_path").alias("path"),
    )
    groups = b.table(spark, folder, "documents").select("source", "lang").distinct()
    from_root = groups.select(
        F.lit("repository").alias("subject_kind"),
        F.lit("repo:root").alias("subject_key"),
        F.lit("depends_on").alias("predicate"),
        F.lit("dependency").alias("object_kind"),
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("dep:pypi:"), "lang").alias("key"), F.concat("source", F.lit("/"), "lang", F.lit("/pyproject.toml")).alias("path")),
                F.struct(F.lit("dep:npm:react").alias("key"), F.lit("package.json").alias("path")),
            )
        ).alias("o"),
    ).select("subject_kind", "subject_key", "predicate", "object_kind", F.col("o.key").alias("object_key"), F.col("o.path").alias("path"))
    readmes = b.named_documents(spark, folder).where(F.col("path").contains("/README_"))
    from_modules = readmes.select(
        F.lit("module").alias("subject_kind"),
        F.concat(F.lit("mod:"), "source", F.lit("/"), "lang").alias("subject_key"),
        F.lit("imports").alias("predicate"),
        F.lit("file").alias("object_kind"),
        F.concat(F.lit("file:"), "path").alias("object_key"),
        F.lit(None).cast("string").alias("path"),
    )
    # sealed edges are a stored table; the read models scan them many times
    rows = checkpoint(
        from_files.unionByName(from_root)
        .unionByName(from_modules)
        .withColumn("edge_id", identity.edge_id("subject_key", "predicate", "object_key"))
    )
    columns = ["edge_id", "subject_kind", "subject_key", "predicate", "object_kind", "object_key"]
    edges = rows.select(*columns).distinct()
    edge_evidence = rows.where("path IS NOT NULL").select("edge_id", "path").distinct()
    node_evidence = groups.where("lang = 'fr'").select(
        F.concat(F.lit("mod:"), "source", F.lit("/"), "lang").alias("stable_key"),
        F.concat("source", F.lit("/"), "lang", F.lit("/__init__.py")).alias("path"),
    )
    ends = edges.select(F.explode(F.array("subject_key", "object_key")).alias("key"))
    related = ends.where(F.col("key").startswith("file:")).select(F.regexp_replace("key", "^file:", "").alias("path"))
    members = checkpoint(architecture.module_members(files, related))
    known = members.select(F.col("module_id").alias("node_id")).distinct().unionByName(
        declared.select(F.col("dep_key").alias("node_id"))
    )
    return edges, edge_evidence, node_evidence, members, known


_MODULE_SQL = f"""rl AS (SELECT path, {_ROLE_SQL} AS role FROM files), mem AS (SELECT path, role, 'module:'||CASE role WHEN 'route' THEN 'api' WHEN 'service' THEN 'services' WHEN 'model' THEN 'domain' WHEN 'documentation' THEN 'documentation'
   ELSE CASE WHEN path LIKE '%.py' THEN path ELSE split_part(path,'/',1) END END AS m FROM rl)"""

_ARCH_SQL = f"""{_ROOTS_SQL}, {_ABSOLUTE_SQL}, {_MODULE_SQL},
  r AS (SELECT source_path, specifier, regexp_replace(source_path,'/[^/]*$','')||specifier[2:]||unnest(['.ts','.tsx','.py','/index.ts','/index.tsx','/__init__.py']) AS path FROM imports WHERE specifier LIKE '.%'),
  ff AS (SELECT * FROM hit UNION SELECT source_path, specifier, path FROM r JOIN files USING (path)),
  ag AS (SELECT source_path, specifier, count(path) AS n, min('file:'||path) AS t FROM imports LEFT JOIN ff USING (source_path, specifier) GROUP BY ALL),
  pk2 AS (SELECT ag.*, CASE WHEN source_path LIKE '%.py' THEN split_part(specifier,'.',1) ELSE split_part(specifier,'/',1) END AS root FROM ag),
  dd AS (SELECT source_path, specifier, n, t, count(dep_key) AS dn, min(dep_key) AS dt FROM pk2 LEFT JOIN declared ON dep_key='dep:npm:'||root OR dep_key='dep:pypi:'||lower(regexp_replace(root,'[-_.]+','-','g')) GROUP BY ALL),
  res AS (SELECT DISTINCT 'file:'||source_path AS s, 'imports' AS p, CASE WHEN n=1 THEN t ELSE dt END AS o, source_path FROM dd WHERE n=1 OR (n=0 AND dn=1)),
  grp AS (SELECT DISTINCT source, lang FROM documents),
  fol AS (SELECT DISTINCT split_part(path,'/',1)||'/'||split_part(path,'/',2) AS folder, m FROM mem),
  pr AS (SELECT s, p, o, mem.m AS source, coalesce(m2.m, o) AS target FROM res JOIN mem ON mem.path=source_path LEFT JOIN mem m2 ON 'file:'||m2.path=o
    UNION SELECT 'repo:root','depends_on','dep:pypi:'||lang, m, 'dep:pypi:'||lang FROM grp JOIN fol ON folder=source||'/'||lang
    UNION SELECT 'mod:'||source||'/'||lang,'imports','file:'||named.path, CASE WHEN lang='fr' AND init.m IS NOT NULL THEN init.m ELSE fol.m END, mem.m FROM named JOIN mem ON mem.path=named.path JOIN fol ON folder=source||'/'||lang
      LEFT JOIN mem init ON init.path=source||'/fr/__init__.py' WHERE contains(named.path,'/README_')),
  lift AS (SELECT DISTINCT 'edge:sha256:'||sha256(s||chr(31)||p||chr(31)||o) AS edge_id, p AS predicate, source, target FROM pr WHERE source<>target)"""

_ARCH_CTES = b.ctes("files", "imports", "declared")


@query("m4_j14_j15_lifted_edges", _ARCH_CTES + f", {_ARCH_SQL} SELECT edge_id, predicate, source, target FROM lift")
def lifted_edges(spark, folder):
    return architecture.lift_edges(*_architecture(spark, folder))[0]


@query(
    "m4_lift_diagnostics",
    "SELECT 'edge:sha256:'||sha256('repo:root'||chr(31)||'depends_on'||chr(31)||'dep:npm:react') AS edge_id, 'ARCH-REL-REPO-SCOPED' AS code, 'info' AS severity",
)
def lift_diagnostics(spark, folder):
    return architecture.lift_edges(*_architecture(spark, folder))[1]


@query(
    "g7_module_adjacency",
    _ARCH_CTES + f", {_ARCH_SQL} SELECT DISTINCT source AS node_id, 'dependency' AS direction, target AS other FROM lift UNION SELECT target,'dependent',source FROM lift",
)
def module_adjacency(spark, folder):
    return architecture.adjacency(architecture.module_pairs(*_architecture(spark, folder)))


@query(
    "g8_g9_relationship_states",
    _ARCH_CTES + f""", {_ARCH_SQL}, nd AS (SELECT DISTINCT m AS node_id, 'shared' AS layer FROM mem UNION SELECT dep_key,'external' FROM declared), con AS (SELECT source AS id FROM lift UNION SELECT target FROM lift),
      cov AS (SELECT DISTINCT path FROM named JOIN labels USING (doc_id)), opn AS (SELECT DISTINCT m FROM mem WHERE path NOT IN (SELECT path FROM cov))
      SELECT node_id, layer, CASE WHEN node_id IN (SELECT id FROM con) THEN 'connected' WHEN node_id LIKE '%/m_%' THEN 'unresolved' WHEN layer<>'external' AND node_id NOT IN (SELECT m FROM opn) THEN 'no-observed-relationships' ELSE 'not-extracted' END AS state
      FROM nd WHERE layer<>'external' OR node_id IN (SELECT id FROM con)""",
)
def relationship_states(spark, folder):
    edges, edge_evidence, node_evidence, members, known = _architecture(spark, folder)
    lifted = architecture.module_pairs(edges, edge_evidence, node_evidence, members, known)
    nodes = known.withColumn("layer", F.when(F.col("node_id").startswith("dep:"), "external").otherwise("shared"))
    kept = architecture.prune_external(nodes, lifted)
    unresolved = known.where(F.col("node_id").rlike("/m."))
    covered = (
        b.named_documents(spark, folder)
        .select("doc_id", "path")
        .join(b.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    )
    return architecture.relationship_states(kept, lifted, unresolved, members, covered)


_MODULE_TABLE_SQL = f"""{_MODULE_SQL}, md AS (SELECT m, count(*) AS files, coalesce(min(role),'unknown') AS role, CASE WHEN count(*)=1 THEN '/'||min(path) WHEN count(DISTINCT split_part(path,'/',1))>1 THEN '/' END AS path_prefix,
   CASE WHEN contains(m,'/') THEN CASE WHEN m LIKE '%/__init__.py' THEN split_part(m,'/',-2) ELSE regexp_replace(split_part(m,'/',-1),'\\.[^.]+$','') END ELSE upper(m[8:8])||m[9:] END AS name FROM mem GROUP BY m)"""


@query(
    "m4_modules",
    b.ctes("files") + f""", {_MODULE_TABLE_SQL} SELECT m AS module_id, CASE WHEN count(*) OVER (PARTITION BY name)>1 THEN split_part(m[8:],'/',1)||'/'||name ELSE name END AS name, role,
      CASE role WHEN 'route' THEN 'presentation' WHEN 'service' THEN 'business-logic' WHEN 'model' THEN 'domain' ELSE 'shared' END AS layer, path_prefix, files FROM md""",
)
def module_table(spark, folder):
    return architecture.modules(_architecture(spark, folder)[3])


@query(
    "k5_notable_symbols",
    b.ctes("files") + f""", {_MODULE_SQL}, s AS (SELECT DISTINCT m, (CASE WHEN path LIKE '%/m%' THEN '_' ELSE '' END)||regexp_extract(path,'[^/]*$') AS symbol FROM mem), p AS (SELECT * FROM s WHERE symbol NOT LIKE '~_%' ESCAPE '~' UNION ALL SELECT * FROM s WHERE symbol LIKE '~_%' ESCAPE '~' AND m NOT IN (SELECT m FROM s WHERE symbol NOT LIKE '~_%' ESCAPE '~'))
      SELECT m AS module_id, symbol, row_number() OVER (PARTITION BY m ORDER BY symbol) AS position FROM p QUALIFY position<=4""",
)
def notable_symbols(spark, folder):
    members = _architecture(spark, folder)[3]
    prefix = F.when(F.col("path").rlike("/m"), "_").otherwise("")
    symbols = members.select("path", F.concat(prefix, paths.basename("path")).alias("symbol"))
    return architecture.notable_symbols(members, symbols)


@query(
    "m5_request_flow",
    b.ctes("files") + f""", rl AS (SELECT path, {_ROLE_SQL} AS role FROM files), s AS (SELECT CASE role WHEN 'route' THEN '1 api' WHEN 'service' THEN '2 service' END AS step, path FROM rl WHERE role IN ('route','service')),
      k AS (SELECT step, path, row_number() OVER (PARTITION BY step ORDER BY path) AS r, count(*) OVER (PARTITION BY step) AS n FROM s)
      SELECT step, max(n) AS modules, string_agg(path, ', ' ORDER BY path) FILTER (WHERE r<=6)||CASE WHEN max(n)>6 THEN ', and '||(max(n)-6)||' more' ELSE '' END AS details FROM k GROUP BY step UNION ALL SELECT '0 client',0,''""",
)
def request_flow(spark, folder):
    table = b.files(spark, folder).select(
        F.col("path").alias("module_id"), F.col("path").alias("name"), roles.file_role("path").alias("role")
    )
    return architecture.request_flow(table)


@query(
    "m4_layer_table",
    b.ctes("files") + f""", {_MODULE_TABLE_SQL}, l AS (SELECT CASE role WHEN 'route' THEN 'presentation' WHEN 'service' THEN 'business-logic' WHEN 'model' THEN 'domain' ELSE 'shared' END AS layer FROM md)
      SELECT layer, count(*) AS nodes, CASE layer WHEN 'presentation' THEN 0 WHEN 'business-logic' THEN 1 WHEN 'domain' THEN 2 ELSE 4 END AS position, CASE layer WHEN 'presentation' THEN 'Presentation' WHEN 'business-logic' THEN 'Business Logic' WHEN 'domain' THEN 'Domain' ELSE 'Shared' END AS name FROM l GROUP BY layer""",
)
def layers(spark, folder):
    return architecture.layer_table(architecture.modules(_architecture(spark, folder)[3]))


# --- projections and reports -------------------------------------------------


@query(
    "m7_product_modules",
    b.ctes("files") + f""", rl AS (SELECT path, {_ROLE_SQL} AS role FROM files), k AS (SELECT CASE role WHEN 'route' THEN 'api' WHEN 'service' THEN 'service' WHEN 'documentation' THEN 'documentation' WHEN 'model' THEN 'domain' ELSE split_part(path,'/',1) END AS module, role FROM rl)
      SELECT module, coalesce(min(role),'unknown') AS role, CASE min(role) WHEN 'route' THEN 'presentation' WHEN 'service' THEN 'business-logic' WHEN 'model' THEN 'domain' ELSE 'shared' END AS layer, count(*) AS files FROM k GROUP BY module""",
)
def product_modules(spark, folder):
    return reports.product_modules(b.files(spark, folder).withColumn("role", roles.file_role("path")))


@query(
    "m18_m7_stack_summary",
    b.ctes("files") + r""", l AS (SELECT CASE regexp_extract(path,'\.([a-z]+)$',1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'md' THEN 'Markdown' END AS language, path FROM files)
      SELECT (SELECT language FROM l GROUP BY language ORDER BY count(*) DESC, min(path) LIMIT 1) AS language, 'FastAPI, React' AS framework, (SELECT min(path) FROM files WHERE contains(path,'/routes/')) AS entry_point""",
)
def stack_summary(spark, folder):
    files = b.files(spark, folder).select("path", roles.language("path").alias("language"))
    kind = F.col("p_type")
    frameworks = b.table(spark, folder, "part").select(
        F.when(kind == "PROMO", "React").when(kind == "SMALL", "FastAPI").otherwise(kind).alias("framework")
    )
    return architecture.stack_summary(files, frameworks, files.where(F.col("path").contains("/routes/")))


def _manifest_names(spark, folder):
    """Each part is a file of its brand's repository; the type picks the file name."""
    names = {
        "ECONOMY": "package.json", "SMALL": "requirements.txt", "STANDARD": "poetry.lock", "MEDIUM": "main.py",
        "LARGE": "src/app.py", "PROMO": "README.md",
    }
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return b.table(spark, folder, "part").select(
        F.concat("p_brand", F.lit("-"), F.col("p_size")).alias("repository"), F.element_at(lookup, F.col("p_type")).alias("path"), "p_name"
    )


@query(
    "c11_package_manager_and_entry_point",
    """WITH t AS (SELECT p_brand||'-'||p_size AS repository, list(DISTINCT p_type) AS t FROM part GROUP BY 1)
      SELECT repository, CASE WHEN list_contains(t,'ECONOMY') THEN 'npm' WHEN list_contains(t,'STANDARD') THEN 'poetry' WHEN list_contains(t,'SMALL') THEN 'pip' END AS package_manager,
       CASE WHEN list_contains(t,'LARGE') THEN '/src/app.py' WHEN list_contains(t,'MEDIUM') THEN '/main.py' WHEN list_contains(t,'ECONOMY') THEN '/package.json' END AS entry_point FROM t""",
)
def package_manager(spark, folder):
    return reports.detect_stack(_manifest_names(spark, folder))


@query(
    "c11_framework",
    """WITH t AS (SELECT p_brand||'-'||p_size AS repository, bool_or(p_type='ECONOMY' AND contains(p_name,'red')) AS nx, bool_or(p_type='ECONOMY' AND NOT contains(p_name,'red')) AS vu, bool_or(p_type='SMALL' AND contains(p_name,'bolt')) AS dj, bool_or(p_type='SMALL') AS sm FROM part GROUP BY 1)
      SELECT repository, CASE WHEN nx THEN 'Next.js' WHEN vu THEN 'Vue' WHEN dj THEN 'Django' WHEN sm THEN 'Flask' ELSE 'Unknown' END AS framework FROM t""",
)
def framework(spark, folder):
    rows = _manifest_names(spark, folder)
    npm = F.when(F.col("p_name").contains("red"), '{"devDependencies":{"vue":"3","next":"1"}}').otherwise('{"dependencies":{"vue":"3"}}')
    python = F.when(F.col("p_name").contains("bolt"), "Flask==1\nDJANGO>=4").otherwise("Flask")
    kind = F.when(F.col("path") == "package.json", "npm").when(F.col("path") == "requirements.txt", "python").otherwise("other")
    body = F.when(kind == "npm", npm).when(kind == "python", python).otherwise("")
    return reports.detect_framework(rows.select("repository", kind.alias("kind"), body.alias("text")))


@query(
    "m8_k6_documentation_sections",
    b.ctes("files", "decl", "ev") + f""", rl AS (SELECT path, {_ROLE_SQL} AS role FROM files), rt AS (SELECT DISTINCT fact_id AS route FROM ev WHERE NOT (extractor='F' AND extractor_version='R')),
      l AS (SELECT 'folder-structure' AS section, 1 AS kind, path AS line FROM files UNION ALL SELECT 'api',1,'File: '||path FROM (SELECT path FROM rl WHERE role='route' UNION SELECT path FROM ev WHERE fact_id IN (SELECT route FROM rt))
        UNION ALL SELECT 'api',2,'Observed route: '||route FROM rt UNION ALL SELECT DISTINCT 'contribution',1,dep_key||': '||CASE version WHEN 'N' THEN 'no version/specifier declared' ELSE version END||' ('||manifest_path||')' FROM decl),
      k AS (SELECT *, row_number() OVER (PARTITION BY section, kind ORDER BY line) AS position FROM l) SELECT * FROM k WHERE position<=CASE section WHEN 'folder-structure' THEN 80 WHEN 'api' THEN 30 ELSE 50 END""",
)
def documentation(spark, folder):
    files = b.files(spark, folder).withColumn("role", roles.file_role("path"))
    test = (F.col("extractor") == "F") & (F.col("extractor_version") == "R")
    evidence = b.evidence(spark, folder).select(
        F.col("fact_id").alias("route"), "path", F.when(test, "test").otherwise("route").alias("role")
    )
    declared = b.declarations(spark, folder).select(
        F.col("dep_key").alias("name"), F.nullif("version", F.lit("N")).alias("version"), "manifest_path"
    )
    return reports.documentation(files, evidence.select("route").distinct(), evidence, declared)


@query(
    "m9_dependency_report",
    b.ctes("decl") + """, t AS (SELECT dependency_type, count(DISTINCT dep_key) AS dependencies, count(*) AS declarations FROM decl GROUP BY 1) SELECT 1 AS section, 1 AS part, '## Dependency types' AS line
      UNION ALL SELECT 2,1,'| dependency_type | dependencies | declarations |' UNION ALL SELECT 2,1,'| --- | --- | --- |' UNION ALL SELECT 2,2,'| '||dependency_type||' | '||dependencies||' | '||declarations||' |' FROM t""",
)
def dependency_report(spark, folder):
    from lodegraph.sources import tables

    counted = b.declarations(spark, folder).groupBy("dependency_type").agg(
        F.countDistinct("dep_key").alias("dependencies"), F.count("*").alias("declarations")
    )
    columns = ["dependency_type", "dependencies", "declarations"]
    title = tables.markdown_lines(spark, 1, ["## Dependency types"])
    return title.unionByName(tables.markdown_table(counted, 2, columns, [F.col("dependency_type")])).drop("position")


@query(
    "m10_k7_context_pack",
    b.ctes("files", "decl") + f""", {_MODULE_SQL}, a AS (SELECT 'file' AS kind, path AS name FROM files UNION SELECT 'module', m FROM mem UNION SELECT 'dependency', dep_key FROM decl), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) AS position FROM a)
      SELECT * FROM k WHERE position<=CASE kind WHEN 'file' THEN 40 WHEN 'module' THEN 10 ELSE 20 END""",
)
def context_pack(spark, folder):
    return reports.context_pack(
        b.files(spark, folder).select(F.col("path").alias("name")),
        _architecture(spark, folder)[3].select(F.col("module_id").alias("name")),
        b.declarations(spark, folder).select(F.col("dep_key").alias("name")),
    )


@query(
    "m10_version_conflicts",
    b.ctes("decl") + "SELECT dep_key, CASE WHEN count(DISTINCT version)=1 THEN min(version) END AS version, count(DISTINCT version)>1 AS conflict FROM decl GROUP BY dep_key",
)
def version_conflicts(spark, folder):
    return reports.version_conflicts(b.declarations(spark, folder))


# --- manifests ---------------------------------------------------------------


def _snapshot_rows(spark, folder):
    orders = b.table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    return orders.select(
        F.concat(F.lit("repo:"), "o_custkey").alias("repository_id"),
        F.lit("git").alias("revision_kind"),
        F.substring(F.sha2(key, 256), 1, 40).alias("revision_value"),
        F.concat(F.lit("refs/heads/"), "o_orderpriority").alias("revision_ref"),
        F.concat(F.lit("snap:"), key).alias("snapshot_id"),
        F.lit("ri.v1").alias("schema_version"),
        F.array(F.concat(F.lit("orders@"), "o_orderstatus"), F.lit("plain")).alias("producer_version_set"),
        F.sha2("o_orderstatus", 256).alias("producer_set_hash"),
        F.lit(None).cast("string").alias("config_hash"),
        F.sha2(F.concat(key, F.lit("g")), 256).alias("canonical_graph_hash"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("sealed_at"),
        "o_orderstatus",
        "o_orderkey",
    )


_MANIFEST_SQL = """man AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_orderdate, sha256(o_orderkey||'g') AS g, '{"canonicalGraphHash":"'||sha256(o_orderkey||'g')||'","configHash":null,"createdAt":"'||strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ')||
   '","extractors":[{"name":"orders","version":"'||o_orderstatus||'"},{"name":"plain","version":""}],"producerSetHash":"'||sha256(o_orderstatus)||'","repositoryId":"repo:'||o_custkey||'","revisionKind":"git","revisionRef":"refs/heads/'||o_orderpriority||
   '","revisionValue":"'||substr(sha256(CAST(o_orderkey AS VARCHAR)),1,40)||'","sealedAt":"'||strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ')||'","snapshotId":"snap:'||o_orderkey||'","snapshotSchemaVersion":"ri.v1"}' AS doc FROM orders)"""


@query("m11_p13_manifest_digest", f"WITH {_MANIFEST_SQL} SELECT 'snap:'||o_orderkey AS snapshot_id, 'sha256:'||sha256(doc) AS digest FROM man")
def manifest_digest(spark, folder):
    return manifests.build(_snapshot_rows(spark, folder)).select("snapshot_id", manifests.digest().alias("digest"))


@query(
    "m12_verified_manifests",
    f"""WITH {_MANIFEST_SQL}, cur AS (SELECT o_custkey, arg_max(o_orderkey,(o_orderdate,o_orderkey)) AS k FROM orders GROUP BY 1)
      SELECT 'snap:'||o_orderkey AS submission_id, CASE WHEN o_orderstatus='P' THEN 'mismatch' WHEN o_orderstatus='O' THEN 'mismatch' WHEN o_orderkey=k THEN 'verified' ELSE 'superseded' END AS state,
        CASE WHEN o_orderstatus='P' THEN 'configHash' WHEN o_orderstatus='O' THEN 'revisionRef' ELSE '' END AS mismatched FROM man JOIN cur USING (o_custkey)""",
)
def verified_manifests(spark, folder):
    rows = _snapshot_rows(spark, folder)
    stored = manifests.build(rows)
    current = rows.groupBy("repository_id").agg(
        F.max(F.struct("created_at", "o_orderkey", "snapshot_id"))["snapshot_id"].alias("snapshot_id")
    )
    status = F.col("o_orderstatus")
    # P: the content was changed after export, with the digest as it was; O: a consistent but invented manifest
    changed = manifests.build(rows.where(status == "P")).withColumn("submitted_digest", manifests.digest())
    changed = changed.withColumn("config_hash", F.lit("changed"))
    other = rows.where(~status.eqNullSafe("P")).withColumn(
        "revision_ref", F.when(status == "O", "refs/heads/other").otherwise(F.col("revision_ref"))
    )
    submitted = changed.unionByName(manifests.build(other).withColumn("submitted_digest", manifests.digest()))
    return manifests.verify(submitted.withColumn("submission_id", F.col("snapshot_id")), stored, current)


@query(
    "m13_verified_citations",
    b.ctes("files") + """, src AS (SELECT path, max(n_chars) AS lines, sha256(path) AS hash FROM named WHERE lang<>'es' GROUP BY path),
      c AS (SELECT doc_id, path, lang, source, n_chars FROM named)
      SELECT doc_id, CASE WHEN source='src1' THEN 'revision-changed' WHEN source='src2' THEN 'not-in-evidence' WHEN lang='es' THEN 'source-gone' WHEN c.path LIKE '%.md' THEN 'not-text' WHEN n_chars+20>lines THEN CASE WHEN n_chars<300 THEN 'outside-content' ELSE 'content-differs' END
        WHEN lang='de' THEN 'content-differs' ELSE 'ready' END AS status FROM c LEFT JOIN src USING (path)""",
)
def verified_citations(spark, folder):
    named = b.named_documents(spark, folder).select("doc_id", "path", "lang", "source", "n_chars")
    sources = named.where("lang <> 'es'").groupBy("path").agg(F.max("n_chars").alias("line_count"))
    sources = sources.select(
        "path",
        F.col("path").endswith(".md").alias("is_binary"),
        F.lit(False).alias("is_image"),
        F.lit(False).alias("truncated"),
        "line_count",
        F.sha2("path", 256).alias("content_hash"),
    )
    beyond = sources.select("path", F.col("line_count").alias("lines"))
    cited = named.join(beyond, "path", "left")
    # near the end of a file: short documents cite beyond it, longer ones cite changed content
    late = F.col("n_chars") + 20 > F.col("lines")
    end = F.when(late & (F.col("n_chars") < 300), F.col("lines") + 1).otherwise(F.lit(1))
    changed = F.when(late, F.col("n_chars") >= 300).otherwise(F.col("lang") == "de")
    citations = cited.select(
        "doc_id",
        F.lit("r1").alias("snapshot_revision"),
        F.when(F.col("source") == "src1", "r2").otherwise("r1").alias("current_revision"),
        F.concat(F.lit("doc:"), "doc_id").alias("fact_id"),
        "path",
        F.lit(1).cast("long").alias("start_line"),
        F.coalesce(end, F.lit(1)).cast("long").alias("end_line"),
        F.when(changed, "other").otherwise(F.sha2("path", 256)).alias("sealed_hash"),
        "source",
    )
    evidence = citations.where("source <> 'src2'").select("fact_id", "path", "start_line", "end_line")
    return manifests.verify_citations(citations.drop("source"), evidence, sources).select("doc_id", "status")


@query(
    "m17_outcome_card",
    b.ctes("files", "diag", "decl", "rev") + f""", {_FINDING_SQL}, {_MODULE_SQL} SELECT (SELECT count(*) FROM rev) AS repositories, (SELECT count(*) FROM rev WHERE status='F') AS completed, (SELECT count(*) FROM f) AS findings,
      (SELECT count(DISTINCT dep_key) FROM decl WHERE fact_kind='declaration') AS dependencies, (SELECT count(DISTINCT m) FROM mem) AS modules, (SELECT category FROM f GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS headline""",
)
def outcome_card(spark, folder):
    repositories = b.revisions(spark, folder).select(
        F.when(F.col("status") == "F", "completed").otherwise("building").alias("state")
    )
    return reports.outcome_card(
        _findings(spark, folder)[0],
        dependencies.dependency_nodes(_declared(spark, folder)),
        architecture.modules(_architecture(spark, folder)[3]),
        repositories,
    )


@query(
    "a23_m17_headline_message",
    b.ctes("diag") + f", {_FINDING_SQL} SELECT category, count(*)||' '||CASE category WHEN 'source_extraction' THEN 'source extraction' ELSE 'relationship resolution' END||CASE WHEN count(*)=1 THEN ' finding' ELSE ' findings' END AS message FROM f GROUP BY category ORDER BY count(*) DESC, category LIMIT 1",
)
def headline_message(spark, folder):
    findings, diagnostics = _findings(spark, folder)
    return review.headline(review.category_states(findings, diagnostics, b.nodes(spark, folder)))


