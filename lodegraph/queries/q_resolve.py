"""Relationship resolution over whole tables."""

from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.operators import resolve
from lodegraph.queries import bindings as b
from lodegraph.queries.registry import query


def _parts(spark, folder):
    return b.table(spark, folder, "part").select(
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").alias("size"),
        F.concat(F.lit("part:"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("target"),
        F.col("p_retailprice").alias("price"),
    )


_PARTS_SQL = "p AS (SELECT p_brand AS brand, p_type AS type, p_size AS size, 'part:'||lpad(CAST(p_partkey AS VARCHAR),9,'0') AS target, p_retailprice AS price FROM part)"


@query(
    "r1_unique_candidate",
    b.ctes("obs") + f""", {_PARTS_SQL} SELECT observation_id, CASE count(target) WHEN 0 THEN 'RI-RES-UNRESOLVED' WHEN 1 THEN NULL ELSE 'RI-RES-AMBIGUOUS' END AS code,
      CASE WHEN count(target)=1 THEN min(target) END AS target FROM obs LEFT JOIN p USING (brand,type,size) GROUP BY observation_id""",
)
def unique_candidate(spark, folder):
    observations = b.observations(spark, folder)
    return resolve.resolve_unique(observations, _parts(spark, folder), ["brand", "type", "size"]).select(
        "observation_id", "code", "target"
    )


@query(
    "r1_ambiguous_candidates",
    b.ctes("obs") + f""", {_PARTS_SQL} SELECT DISTINCT brand, type, size, target FROM p WHERE (brand,type,size) IN (SELECT (brand,type,size) FROM p GROUP BY brand,type,size HAVING count(*)>1)
      AND (brand,type,size) IN (SELECT (brand,type,size) FROM obs)""",
)
def ambiguous_candidates(spark, folder):
    return resolve.ambiguous_candidates(b.observations(spark, folder), _parts(spark, folder), ["brand", "type", "size"])


@query(
    "r2_earliest_evidence",
    b.ctes("ev") + """SELECT fact_id, path, start_line, end_line, extractor, extractor_version FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY path,start_line,end_line,extractor,extractor_version) AS r FROM ev) WHERE r=1""",
)
def earliest_evidence(spark, folder):
    order = ("path", "start_line", "end_line", "extractor", "extractor_version")
    return resolve.earliest_evidence(b.evidence(spark, folder), "fact_id", order)


@query(
    "r3_definition_parents",
    """WITH s AS (SELECT DISTINCT source||'/'||lang||'.py' AS path, ['Mod','Mod.run','Gone.run.inner','Mod.run.'||lang][CAST(n_chars%4+1 AS INT)] AS name FROM documents),
      k AS (SELECT path||'::'||name AS key, CASE WHEN contains(name,'.') THEN path||'::'||regexp_replace(name,'\\.[^.]*$','') ELSE 'file:'||path END AS parent FROM s),
      known AS (SELECT key FROM k UNION SELECT 'file:'||path FROM s)
      SELECT CASE WHEN parent IN (SELECT key FROM known) THEN parent END AS subject_key, p AS predicate, key AS object_key,
        CASE WHEN parent NOT IN (SELECT key FROM known) THEN 'RI-RES-UNRESOLVED' END AS code
      FROM (SELECT *, unnest(CASE WHEN parent IN (SELECT key FROM known) THEN ['contains','defines'] ELSE [NULL] END) AS p FROM k)""",
)
def definition_parents(spark, folder):
    names = F.array(F.lit("Mod"), F.lit("Mod.run"), F.lit("Gone.run.inner"), F.concat(F.lit("Mod.run."), "lang"))
    rows = (
        b.table(spark, folder, "documents")
        .select(
            F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("path"),
            F.element_at(names, (F.col("n_chars") % 4 + 1).cast("int")).alias("name"),
        )
        .distinct()
    )
    symbols = rows.select(F.concat_ws("::", "path", "name").alias("key"))
    files = rows.select(F.concat(F.lit("file:"), "path").alias("key")).distinct()
    return resolve.definition_edges(symbols, symbols, files)


@query(
    "r4_relative_import_files",
    b.ctes("files", "imports") + """, r AS (SELECT source_path, specifier, regexp_replace(source_path,'/[^/]*$','')||specifier[2:] AS root FROM imports WHERE specifier LIKE '.%'),
      c AS (SELECT source_path, specifier, root||unnest(['.ts','.tsx','.py','/index.ts','/index.tsx','/__init__.py']) AS path FROM r)
      SELECT source_path, specifier, path AS target FROM c JOIN files USING (path)""",
)
def relative_imports(spark, folder):
    relative = b.imports(spark, folder).where(F.col("specifier").startswith("."))
    wanted = relative.select(
        "source_path", "specifier", F.explode(resolve.relative_candidates("specifier", "source_path")).alias("path")
    )
    return wanted.join(b.files(spark, folder).select("path"), "path").withColumnRenamed("path", "target")


_ROOTS_SQL = """pk AS (SELECT DISTINCT regexp_replace(path,'/[^/]*$','') AS folder FROM files WHERE path LIKE '%/__init__.py'),
  roots AS (SELECT '' AS root UNION SELECT CASE WHEN contains(folder,'/') THEN regexp_replace(folder,'/[^/]*$','') ELSE '' END FROM pk
    WHERE CASE WHEN contains(folder,'/') THEN regexp_replace(folder,'/[^/]*$','') ELSE '' END NOT IN (SELECT folder FROM pk))"""


@query("r5_source_roots", b.ctes("files") + f", {_ROOTS_SQL} SELECT root FROM roots")
def source_roots(spark, folder):
    return resolve.source_roots(b.files(spark, folder))


_ABSOLUTE_SQL = """cand AS (SELECT source_path, specifier, (CASE WHEN root='' THEN '' ELSE root||'/' END)||replace(specifier,'.','/')||unnest(['.py','/__init__.py']) AS path
   FROM imports, roots WHERE source_path LIKE '%.py' AND specifier NOT LIKE '.%'),
  hit AS (SELECT DISTINCT source_path, specifier, path FROM cand JOIN files USING (path))"""


@query(
    "r6_absolute_import_files",
    b.ctes("files", "imports") + f""", {_ROOTS_SQL}, {_ABSOLUTE_SQL} SELECT DISTINCT replace(specifier,'.','/') AS module, path AS target FROM hit""",
)
def absolute_imports(spark, folder):
    wanted = (
        b.imports(spark, folder)
        .where(F.col("source_path").endswith(".py") & ~F.col("specifier").startswith("."))
        .select(F.translate("specifier", ".", "/").alias("module"))
        .distinct()
    )
    return resolve.module_files(b.files(spark, folder)).join(wanted, "module", "left_semi")


@query(
    "r7_resolve_imports",
    b.ctes("files", "imports", "declared") + f""", {_ROOTS_SQL}, {_ABSOLUTE_SQL},
      r AS (SELECT source_path, specifier, regexp_replace(source_path,'/[^/]*$','')||specifier[2:]||unnest(['.ts','.tsx','.py','/index.ts','/index.tsx','/__init__.py']) AS path FROM imports WHERE specifier LIKE '.%'),
      f AS (SELECT * FROM hit UNION SELECT source_path, specifier, path FROM r JOIN files USING (path)),
      agg AS (SELECT source_path, specifier, count(path) AS n, min('file:'||path) AS t FROM imports LEFT JOIN f USING (source_path, specifier) GROUP BY ALL),
      pkg AS (SELECT agg.*, CASE WHEN source_path LIKE '%.py' THEN split_part(specifier,'.',1) ELSE split_part(specifier,'/',1) END AS root FROM agg),
      d AS (SELECT source_path, specifier, n, t, count(dep_key) AS dn, min(dep_key) AS dt FROM pkg LEFT JOIN declared ON dep_key='dep:npm:'||root OR dep_key='dep:pypi:'||lower(regexp_replace(root,'[-_.]+','-','g')) GROUP BY ALL)
      SELECT source_path, specifier, CASE WHEN n>0 THEN 1 WHEN dn>0 THEN 2 END AS tier,
        CASE WHEN n>1 THEN 'RI-RES-AMBIGUOUS' WHEN n=1 THEN NULL WHEN dn>1 THEN 'RI-RES-AMBIGUOUS' WHEN dn=0 THEN 'RI-RES-UNRESOLVED' END AS code,
        CASE WHEN n=1 THEN t WHEN n=0 AND dn=1 THEN dt END AS target FROM d""",
)
def resolve_imports(spark, folder):
    return resolve.resolve_imports(
        b.imports(spark, folder), b.files(spark, folder), b.declared_packages(spark, folder)
    )


@query(
    "r9_three_tiers",
    b.ctes("obs") + f""", {_PARTS_SQL},
      t1 AS (SELECT brand,type,size,count(*) n,min(target) t FROM p GROUP BY ALL), t2 AS (SELECT brand,type,count(*) n,min(target) t FROM p WHERE size>40 GROUP BY ALL),
      t3 AS (SELECT brand,size,count(*) n,min(target) t FROM p WHERE price<950 GROUP BY ALL)
      SELECT observation_id, CASE WHEN t1.n>0 THEN 1 WHEN t2.n>0 THEN 2 WHEN t3.n>0 THEN 3 END AS tier,
       CASE WHEN coalesce(t1.n,t2.n,t3.n) IS NULL THEN 'RI-RES-UNRESOLVED' WHEN coalesce(t1.n,t2.n,t3.n)>1 THEN 'RI-RES-AMBIGUOUS' END AS code,
       CASE WHEN coalesce(t1.n,t2.n,t3.n)=1 THEN coalesce(t1.t,t2.t,t3.t) END AS target
      FROM obs LEFT JOIN t1 USING (brand,type,size) LEFT JOIN t2 USING (brand,type) LEFT JOIN t3 ON t3.brand=obs.brand AND t3.size=obs.size""",
)
def three_tiers(spark, folder):
    parts = _parts(spark, folder)
    tiers = [
        (["brand", "type", "size"], parts),
        (["brand", "type"], parts.where("size > 40")),
        (["brand", "size"], parts.where("price < 950")),
    ]
    return resolve.resolve_tiers(b.observations(spark, folder), tiers).select("observation_id", "tier", "code", "target")


def _code_graph(spark, folder):
    """Symbols, bindings and references over FILES: one symbol per file, names by language."""
    files = b.files(spark, folder)
    folder_of = paths.directory("path")
    symbols = files.select(
        F.concat_ws("::", "path", F.concat(F.lit("S_"), paths.basename(folder_of))).alias("key"),
        "path",
        F.concat(F.lit("S_"), paths.basename(folder_of)).alias("name"),
        F.col("path").endswith(".ts").alias("default_export"),
    )
    lang = F.element_at(F.split("source_path", "/"), 2)
    imports = b.imports(spark, folder)
    bindings = imports.select(
        "source_path",
        "specifier",
        F.when(F.col("specifier").startswith("."), "default").otherwise(F.concat(F.lit("S_"), lang)).alias("imported"),
        F.concat(F.lit("local_"), lang).alias("local"),
    )
    local = F.when(F.col("path").endswith(".py"), F.concat(F.lit("local_"), F.element_at(F.split("path", "/"), 2)))
    references = files.select(
        F.col("path").alias("source_path"),
        F.explode(
            F.array(
                F.concat(F.lit("S_"), paths.basename(folder_of)),
                F.coalesce(local, F.concat(F.lit("local_"), F.element_at(F.split("path", "/"), 2))),
                F.concat_ws("::", "path", F.concat(F.lit("S_"), paths.basename(folder_of))),
            )
        ).alias("referent"),
    )
    return references, symbols, bindings, files


@query(
    "r9_resolve_references",
    b.ctes("files", "imports") + f""", {_ROOTS_SQL}, {_ABSOLUTE_SQL},
      sym AS (SELECT path||'::S_'||split_part(regexp_replace(path,'/[^/]*$',''),'/',-1) AS key, path, 'S_'||split_part(regexp_replace(path,'/[^/]*$',''),'/',-1) AS name, path LIKE '%.ts' AS def FROM files),
      rel AS (SELECT source_path, specifier, regexp_replace(source_path,'/[^/]*$','')||specifier[2:]||unnest(['.ts','.tsx','.py','/index.ts','/index.tsx','/__init__.py']) AS path FROM imports WHERE specifier LIKE '.%'),
      tf AS (SELECT * FROM hit UNION SELECT source_path, specifier, path FROM rel JOIN files USING (path)),
      bind AS (SELECT source_path, specifier, CASE WHEN specifier LIKE '.%' THEN 'default' ELSE 'S_'||split_part(source_path,'/',2) END AS imported, 'local_'||split_part(source_path,'/',2) AS local FROM imports),
      bt AS (SELECT DISTINCT b.source_path, b.local, s.key FROM bind b JOIN tf USING (source_path,specifier) JOIN sym s ON s.path=tf.path AND ((imported='default' AND def) OR (imported<>'default' AND s.name=imported))),
      ref AS (SELECT path AS source_path, unnest(['S_'||split_part(regexp_replace(path,'/[^/]*$',''),'/',-1), 'local_'||split_part(path,'/',2), path||'::S_'||split_part(regexp_replace(path,'/[^/]*$',''),'/',-1)]) AS referent FROM files),
      c AS (SELECT r.source_path, r.referent, count(DISTINCT bt.key) AS n, min(bt.key) AS t FROM ref r LEFT JOIN bt ON bt.source_path=r.source_path AND bt.local=r.referent GROUP BY ALL)
      SELECT source_path, referent, CASE WHEN referent LIKE '%::%' THEN 1 WHEN referent LIKE 'S~_%' ESCAPE '~' THEN 2 WHEN n>0 THEN 3 END AS tier,
        CASE WHEN referent LIKE '%::%' OR referent LIKE 'S~_%' ESCAPE '~' OR n=1 THEN NULL WHEN n=0 THEN 'RI-RES-UNRESOLVED' ELSE 'RI-RES-AMBIGUOUS' END AS code,
        CASE WHEN referent LIKE '%::%' THEN referent WHEN referent LIKE 'S~_%' ESCAPE '~' THEN source_path||'::'||referent WHEN n=1 THEN t END AS target FROM c""",
)
def resolve_references(spark, folder):
    return resolve.resolve_references(*_code_graph(spark, folder))


@query(
    "r10_shadowed_calls",
    """WITH c AS (SELECT event_id, event_type, user_id, nullif(CAST(json_extract(props,'$.k') AS INT)%3,0) AS k FROM events)
      SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM c s WHERE s.event_type='error' AND s.user_id=c.user_id AND s.k IS NOT DISTINCT FROM c.k) THEN 'calls target is shadowed by a local binding' END AS message
      FROM c WHERE event_type<>'error'""",
)
def shadowed_calls(spark, folder):
    rows = b.table(spark, folder, "events").select(
        "event_id", "event_type", "user_id", F.nullif(b.k_of_props() % 3, F.lit(0)).alias("k")
    )
    calls, markers = rows.where("event_type <> 'error'"), rows.where("event_type = 'error'")
    return resolve.suppress_shadowed(calls, markers, ["user_id", "k"]).select("event_id", "message")


def _day_hour_spans(spark, folder):
    """Per user one span for each day and each hour that has events; hours of orders' users twice."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = b.table(spark, folder, "events").select("user_id", seconds.alias("s"), "event_type")

    def spans(width, label, source):
        start = F.expr(f"s - s % {width}")
        return source.select(F.concat(F.lit("user:"), "user_id").alias("path"), start.alias("start")).distinct().select(
            "path",
            "start",
            (F.col("start") + width - 1).alias("end"),
            F.concat(F.lit(label), F.col("start").cast("string")).alias("name"),
        )

    return (
        spans(86400, "day:", rows)
        .unionByName(spans(3600, "hour:", rows))
        .unionByName(spans(3600, "again:", rows.where("event_type = 'signup'")))
    )


_SPAN_SQL = """e AS (SELECT event_id, 'user:'||user_id AS path, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type FROM events),
  sp AS (SELECT DISTINCT path, s-s%86400 AS a, s-s%86400+86399 AS z, 'day:'||(s-s%86400) AS name FROM e UNION ALL SELECT DISTINCT path, s-s%3600, s-s%3600+3599, 'hour:'||(s-s%3600) FROM e
   UNION ALL SELECT DISTINCT path, s-s%3600, s-s%3600+3599, 'again:'||(s-s%3600) FROM e WHERE event_type='signup')"""


@query(
    "j8_r11_smallest_containing_span",
    f"""WITH {_SPAN_SQL}, m AS (SELECT event_id, event_type, e.path, name, rank() OVER (PARTITION BY event_id ORDER BY z-a) AS r, count(*) OVER (PARTITION BY event_id, z-a) AS n FROM e JOIN sp ON sp.path=e.path AND a<=s AND z>=s)
      SELECT DISTINCT event_id, CASE WHEN event_type='click' THEN 'symbol:'||event_id WHEN n=1 THEN name WHEN event_type='view' THEN path END AS subject FROM m WHERE r=1""",
)
def containing_span(spark, folder):
    points = b.table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.concat(F.lit("user:"), "user_id").alias("path"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("end"),
    )
    found = resolve.smallest_containing(points, _day_hour_spans(spark, folder))
    kind = F.when(F.col("event_type") == "click", "symbol").when(F.col("event_type") == "view", "file").otherwise("other")
    key = F.when(kind == "symbol", F.concat(F.lit("symbol:"), "event_id")).otherwise(F.col("path"))
    joined = points.join(found, ["path", "start", "end"], "left").withColumn("kind", kind).withColumn("key", key)
    return joined.select("event_id", resolve.subject_of_reference("kind", "key", "name").alias("subject"))


@query(
    "r12_route_handlers",
    """WITH r AS (SELECT DISTINCT conv_id FROM conversations WHERE role='user'), h AS (SELECT conv_id, count(*) AS n, min(turn) AS t FROM conversations WHERE role='assistant' GROUP BY conv_id)
      SELECT conv_id, CASE WHEN n IS NULL THEN 'RI-RES-UNRESOLVED' WHEN n>1 THEN 'RI-RES-AMBIGUOUS' END AS code, CASE WHEN n=1 THEN t END AS handler FROM r LEFT JOIN h USING (conv_id)""",
)
def route_handlers(spark, folder):
    turns = b.table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return resolve.route_handlers(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", "turn")


@query(
    "r13_r15_r18_declared_edges",
    b.ctes("decl") + """SELECT DISTINCT 'repo:root' AS subject_key, CASE WHEN version='R' THEN 'declares' ELSE 'depends_on' END AS predicate, dep_key AS object_key FROM decl WHERE fact_kind='declaration'""",
)
def declared_edges(spark, folder):
    # lockfile pins (resolutions) never create edges
    declared = b.declarations(spark, folder).where("fact_kind = 'declaration'")
    predicate = F.when(F.col("version") == "R", "declares").otherwise("depends_on")
    return declared.select(
        F.lit("repo:root").alias("subject_key"), predicate.alias("predicate"), F.col("dep_key").alias("object_key")
    ).distinct()


@query(
    "r14_http_call_to_service",
    r"""WITH p AS (SELECT page_id, regexp_extract(url,'^(https?)://([^/?#]+)',1)||'://'||lower(regexp_extract(url,'^(https?)://([^/?#]+)',2)) AS origin, contains(url,'#') AS svc FROM pages),
      s AS (SELECT DISTINCT 'svc:'||origin AS key FROM p WHERE svc)
      SELECT page_id, CASE WHEN key IS NULL THEN 'RI-RES-UNRESOLVED' END AS code, key AS target FROM p LEFT JOIN s ON key='svc:'||origin""",
)
def http_call_to_service(spark, folder):
    pages = b.table(spark, folder, "pages")
    services = pages.where(F.col("url").contains("#")).select(paths.service_key(paths.url_origin("url")).alias("target"))
    services = services.withColumn("service", F.col("target"))
    calls = pages.select(
        "page_id",
        paths.service_key(paths.parse_referent(paths.referent(F.lit("GET"), "url"))["origin"]).alias("service"),
    )
    return resolve.resolve_unique(calls, services, ["service"]).select("page_id", "code", "target")


@query(
    "r16_r17_edge_provenance",
    b.ctes("obs") + f""", {_PARTS_SQL}, r AS (SELECT observation_id, path, line, count(target) AS n, min(target) AS target FROM obs JOIN p USING (brand,type,size) GROUP BY ALL HAVING count(target)=1),
      e AS (SELECT *, 'edge:sha256:'||sha256('file:'||path||chr(31)||'calls'||chr(31)||target) AS edge_id FROM r)
      SELECT edge_id, 'file:'||path AS subject_key, 'calls' AS predicate, target AS object_key, count(DISTINCT line) AS n_evidence, count(DISTINCT observation_id) AS n_derivations FROM e GROUP BY ALL""",
)
def edge_provenance(spark, folder):
    observations = b.observations(spark, folder)
    resolved = (
        resolve.resolve_unique(observations, _parts(spark, folder), ["brand", "type", "size"])
        .withColumn("subject", F.concat(F.lit("file:"), "path"))
        .withColumn("start_line", F.col("line"))
        .withColumn("end_line", F.col("line"))
    )
    edges, evidence, derivations = resolve.provenance(resolved, "subject", "calls", "resolver")
    return edges.join(evidence.groupBy("edge_id").agg(F.count("*").alias("n_evidence")), "edge_id").join(
        derivations.groupBy("edge_id").agg(F.count("*").alias("n_derivations")), "edge_id"
    )
