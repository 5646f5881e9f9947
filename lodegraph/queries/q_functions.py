"""Scalar functions and row filters over whole tables."""

from pyspark.sql import functions as F

from lodegraph.functions import identity, paths, roles, text
from lodegraph.queries import bindings as b
from lodegraph.queries.registry import query

# A raw path per page: some absolute, some leaving the root, some to be cleaned.
_RAW_PATH_SQL = """SELECT page_id, CASE page_id%5 WHEN 0 THEN '/'||rest WHEN 1 THEN './'||rest||'//../x/.' WHEN 2 THEN '../'||rest
  WHEN 3 THEN 'C:'||chr(92)||rest ELSE replace(rest,'/',chr(92)) END AS raw, rest
  FROM (SELECT page_id, regexp_replace(url,'^https?://','') AS rest FROM pages)"""


def _raw_paths(spark, folder):
    rest = F.regexp_replace("url", "^https?://", "")
    which = F.col("page_id") % 5
    raw = (
        F.when(which == 0, F.concat(F.lit("/"), rest))
        .when(which == 1, F.concat(F.lit("./"), rest, F.lit("//../x/.")))
        .when(which == 2, F.concat(F.lit("../"), rest))
        .when(which == 3, F.concat(F.lit("C:\\"), rest))
        .otherwise(F.translate(rest, "/", "\\"))
    )
    return b.table(spark, folder, "pages").select("page_id", raw.alias("raw"), rest.alias("rest"))


_NORM_SQL = r"""CASE WHEN NOT regexp_matches(raw,'^(/|[A-Za-z]:)') THEN
  (SELECT CASE WHEN list_contains(st,'<out>') THEN NULL ELSE array_to_string(st,'/') END FROM (SELECT
  list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split(replace(raw,chr(92),'/'),'/'), lambda x: x NOT IN ('','.')), lambda x: [x])),
   lambda acc, x: CASE WHEN x[1]<>'..' THEN list_concat(acc,x) WHEN len(acc)=0 THEN ['<out>'] ELSE acc[1:len(acc)-1] END) AS st)) END"""


@query(
    "f1_f2_normalize_path",
    f"WITH r AS ({_RAW_PATH_SQL}) SELECT page_id, {_NORM_SQL} AS path, ({_NORM_SQL}) IS NOT NULL AS valid FROM r",
)
def normalize_path(spark, folder):
    return _raw_paths(spark, folder).select(
        "page_id", paths.normalize_path("raw").alias("path"), paths.is_valid_path("raw").alias("valid")
    )


@query(
    "f3_stable_key_per_kind",
    b.ctes("nodes") + """, k AS (SELECT 'file' AS kind, 'file:'||stable_key AS key FROM nodes UNION ALL SELECT 'symbol', stable_key||'::'||name FROM nodes
      UNION ALL SELECT 'module', 'mod:./'||stable_key FROM nodes UNION ALL SELECT 'dependency', stable_key FROM nodes
      UNION ALL SELECT 'service','svc:https://'||node_kind FROM nodes UNION ALL SELECT 'Part', stable_key FROM nodes
      UNION ALL SELECT 'repository', stable_key FROM nodes UNION ALL SELECT node_kind, stable_key FROM nodes)
    SELECT kind, count(*) AS n, count(CASE WHEN kind IN ('file','module','symbol','service') OR kind IN ('region','nation','supplier','customer','part','order')
      THEN 1 END) AS n_valid,
      max(CASE kind WHEN 'module' THEN replace(key,'mod:./','mod:') WHEN 'file' THEN key WHEN 'symbol' THEN key WHEN 'service' THEN key
       WHEN 'dependency' THEN NULL WHEN 'Part' THEN NULL WHEN 'repository' THEN NULL ELSE key END) AS max_key FROM k GROUP BY kind""",
)
def stable_keys(spark, folder):
    nodes = b.nodes(spark, folder)
    key, name, kind = F.col("stable_key"), F.col("name"), F.col("node_kind")
    variants = F.array(
        *[
            F.struct(k.alias("kind"), v.alias("key"))
            for k, v in (
                (F.lit("file"), F.concat(F.lit("file:"), key)),
                (F.lit("symbol"), F.concat(key, F.lit("::"), name)),
                (F.lit("module"), F.concat(F.lit("mod:./"), key)),
                (F.lit("dependency"), key),
                (F.lit("service"), F.concat(F.lit("svc:https://"), kind)),
                (F.lit("Part"), key),
                (F.lit("repository"), key),
                (kind, key),
            )
        ]
    )
    rows = nodes.select(F.inline(variants))
    return (
        rows.withColumn("good", paths.normalize_stable_key("kind", "key"))
        .groupBy("kind")
        .agg(F.count("*").alias("n"), F.count("good").alias("n_valid"), F.max("good").alias("max_key"))
    )


@query(
    "f4_predicate_token",
    "SELECT event_type, regexp_matches(event_type,'^[a-z][a-z0-9_]*$') AS lower_ok, regexp_matches(upper(event_type),'^[a-z][a-z0-9_]*$') AS upper_ok, count(*) AS n FROM events GROUP BY ALL",
)
def predicate_token(spark, folder):
    return (
        b.table(spark, folder, "events")
        .groupBy(
            "event_type",
            paths.is_token("event_type").alias("lower_ok"),
            paths.is_token(F.upper("event_type")).alias("upper_ok"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "f5_dependency_key",
    "SELECT p_partkey, 'dep:pypi:'||lower(regexp_replace(replace(p_name,' ','_.')||'-'||p_brand,'[-_.]+','-','g')) AS pypi_key, 'dep:npm:'||p_name AS npm_key FROM part",
)
def dependency_key(spark, folder):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_.")), F.lit("-"), F.col("p_brand"))
    return b.table(spark, folder, "part").select(
        "p_partkey",
        paths.dependency_key(F.lit("pypi"), raw).alias("pypi_key"),
        paths.dependency_key(F.lit("npm"), "p_name").alias("npm_key"),
    )


@query(
    "f6_entity_keys",
    f"WITH r AS ({_RAW_PATH_SQL}), n AS (SELECT page_id, {_NORM_SQL} AS path FROM r)" + r"""
    SELECT page_id, 'mod:'||CASE WHEN contains(path,'/') THEN regexp_replace(path,'/[^/]*$','') ELSE '' END AS module_key,
      nullif(regexp_extract(CASE WHEN contains(path,'/') THEN regexp_replace(path,'/[^/]*$','') ELSE '' END,'[^/]*$'),'') AS module_name,
      'iac:'||path||'::service/db' AS resource_key, path||'::Page.render' AS symbol_key FROM n""",
)
def entity_keys(spark, folder):
    return _raw_paths(spark, folder).select(
        "page_id",
        paths.module_key("raw").alias("module_key"),
        paths.module_name("raw").alias("module_name"),
        paths.resource_key("raw", F.lit("service"), F.lit("db")).alias("resource_key"),
        paths.symbol_key("raw", F.lit("Page.render")).alias("symbol_key"),
    )


@query(
    "f7_package_root",
    b.ctes("imports") + """SELECT source_path, specifier, CASE WHEN source_path LIKE '%.py' THEN split_part(specifier,'.',1)
      WHEN specifier LIKE '@%' THEN split_part(specifier,'/',1)||'/'||split_part(specifier,'/',2) ELSE split_part(specifier,'/',1) END AS root FROM imports""",
)
def package_root(spark, folder):
    return b.imports(spark, folder).withColumn("root", paths.package_root("specifier", "source_path"))


_PAGE_PARTS = r"""SELECT page_id, url, regexp_extract(url,'^(https?)://([^/?#]+)',1) AS scheme, lower(regexp_extract(url,'^(https?)://([^/?#]+)',2)) AS host,
  regexp_extract(url,'^https?://[^/?#]+(/[^?#]*)?',1) AS path FROM pages"""


@query(
    "f8_f9_http_destination",
    f"WITH p AS ({_PAGE_PARTS}) SELECT page_id, 'GET' AS method, scheme||'://'||host AS origin, CASE WHEN path='' THEN '/' ELSE path END AS path FROM p",
)
def http_destination(spark, folder):
    return b.table(spark, folder, "pages").select(
        "page_id",
        paths.http_method(F.lit(" get ")).alias("method"),
        paths.url_origin("url").alias("origin"),
        paths.url_path("url").alias("path"),
    )


@query(
    "f10_http_referent",
    f"""WITH p AS ({_PAGE_PARTS}), r AS (SELECT page_id, 'POST|'||scheme||'://'||host||'|'||CASE WHEN path='' THEN '/' ELSE path END AS referent FROM p)
      SELECT page_id, referent, split_part(referent,'|',1) AS method, split_part(referent,'|',2) AS origin, split_part(referent,'|',3) AS path FROM r""",
)
def http_referent(spark, folder):
    coded = b.table(spark, folder, "pages").select("page_id", paths.referent(F.lit("post"), "url").alias("referent"))
    return coded.select("page_id", "referent", paths.parse_referent("referent").alias("p")).select(
        "page_id", "referent", "p.method", "p.origin", "p.path"
    )


@query(
    "f11_nfc_text",
    "SELECT doc_id, md5(nfc_normalize(replace(replace(text,'é','e'||chr(769)),'ü','u'||chr(776)))) AS digest, nfc_normalize(text)=text AS unchanged FROM documents",
)
def nfc_text(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "text")
    taken_apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    both = docs.withColumn("apart", taken_apart).withColumn("original", F.col("text"))
    return text.with_nfc(both, "apart", "text").select(
        "doc_id", F.md5("apart").alias("digest"), (F.col("text") == F.col("original")).alias("unchanged")
    )


@query(
    "f12_canonical_json",
    """SELECT o_orderkey, '{"customer":'||o_custkey||',"priority":"'||o_orderpriority||'","ref":null,"state":{"kind":"order","status":"'||o_orderstatus||'"}}' AS document FROM orders""",
)
def canonical_json(spark, folder):
    return b.table(spark, folder, "orders").select(
        "o_orderkey",
        identity.canonical_json(
            state=identity.sorted_struct(status="o_orderstatus", kind=F.lit("order")),
            ref=F.lit(None).cast("string"),
            priority="o_orderpriority",
            customer="o_custkey",
        ).alias("document"),
    )


_ROLE_SQL = r"""CASE WHEN regexp_matches(lower(path),'(^|/)readme') THEN 'documentation' WHEN regexp_matches(lower(path),'(^|/)(test|spec|__tests__)') THEN 'test'
  WHEN regexp_matches(lower(path),'(^|/)(main|app|index)\.(py|ts|tsx|js|jsx)$') THEN 'entrypoint' WHEN lower(path) LIKE '%middleware%' THEN 'middleware'
  WHEN lower(path) LIKE '%controller%' THEN 'controller' WHEN lower(path) LIKE '%/api/%' OR lower(path) LIKE '%route%' THEN 'route'
  WHEN lower(path) LIKE '%service%' THEN 'service' WHEN lower(path) LIKE '%repo%' OR lower(path) LIKE '%/repositorie%' THEN 'repository'
  WHEN lower(path) LIKE '%model%' OR regexp_matches(lower(path),'/schemas?/') THEN 'model' WHEN lower(path) LIKE '%dto%' THEN 'dto'
  WHEN lower(path) LIKE '%interface%' THEN 'interface' WHEN lower(path) LIKE '%enum%' THEN 'enum'
  WHEN lower(path) LIKE '%/config%' OR lower(path) LIKE '%settings%' THEN 'configuration' WHEN lower(path) LIKE '%util%' OR lower(path) LIKE '%/lib/%' THEN 'utility' END"""


@query(
    "c1_c4_file_role_and_layer",
    b.ctes("files") + f""", r AS (SELECT path, {_ROLE_SQL} AS role FROM files) SELECT path, role,
      CASE WHEN role IN ('entrypoint','controller','route') THEN 'presentation' WHEN role='service' THEN 'business-logic'
       WHEN role IN ('model','dto','interface','enum') THEN 'domain' WHEN role IN ('repository','configuration','test','middleware') THEN 'infrastructure'
       ELSE 'shared' END AS layer,
      CASE WHEN role IN ('entrypoint','controller','route') THEN 0 WHEN role='service' THEN 1
       WHEN role IN ('model','dto','interface','enum') THEN 2 WHEN role IN ('repository','configuration','test','middleware') THEN 3 ELSE 4 END AS layer_order
      FROM r WHERE role IS NOT NULL""",
)
def file_roles(spark, folder):
    return (
        b.files(spark, folder)
        .select("path", roles.file_role("path").alias("role"))
        .where("role IS NOT NULL")
        .withColumn("layer", roles.layer("role"))
        .withColumn("layer_order", roles.layer_order("layer"))
    )


@query(
    "c1_url_role",
    "WITH u AS (SELECT page_id, url AS path FROM pages) SELECT role, count(*) AS n FROM (SELECT " + _ROLE_SQL + " AS role FROM u) GROUP BY role",
)
def url_roles(spark, folder):
    return b.table(spark, folder, "pages").groupBy(roles.file_role("url").alias("role")).agg(F.count("*").alias("n"))


_SYMBOLS = ("Service", "Model", "Dto", "Middleware", "Helper", "")


@query(
    "c2_symbol_role",
    """WITH s AS (SELECT p_partkey, (CASE WHEN p_size%9=0 THEN '' ELSE upper(p_name) END)||['Service','Model','Dto','Middleware','Helper',''][CAST(p_partkey%6+1 AS INT)] AS name FROM part)
      SELECT p_partkey, name, CASE WHEN name LIKE '_%Middleware' THEN 'middleware' WHEN name LIKE '_%Service' THEN 'service' WHEN name LIKE '_%Model' THEN 'model'
       WHEN name LIKE '_%Dto' THEN 'dto' END AS role FROM s""",
)
def symbol_roles(spark, folder):
    stem = F.when(F.col("p_size") % 9 == 0, F.lit("")).otherwise(F.upper("p_name"))
    ending = F.element_at(F.array(*[F.lit(s) for s in _SYMBOLS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    named = b.table(spark, folder, "part").select("p_partkey", F.concat(stem, ending).alias("name"))
    return named.withColumn("role", roles.symbol_role("name"))


@query(
    "c10_asset_import",
    "SELECT page_id, contains(url,'?') OR regexp_extract(lower(split_part(url,'?',1)),'\\.([^./]*)$',1) IN ('css','svg','png','md','txt','yaml') AS asset FROM pages",
)
def asset_import(spark, folder):
    return b.table(spark, folder, "pages").select(
        "page_id", roles.is_asset_import("url", F.lit("src/page.ts")).alias("asset")
    )


@query(
    "c12_license",
    "SELECT doc_id, CASE WHEN contains(head,'mit license') THEN 'MIT' WHEN contains(head,'apache license') THEN 'Apache-2.0' WHEN contains(head,'gnu general public license') THEN 'GPL' ELSE 'Custom' END AS license FROM (SELECT doc_id, lower(text) AS head FROM documents)",
)
def licenses(spark, folder):
    return b.table(spark, folder, "documents").select("doc_id", roles.license_name("text").alias("license"))


@query(
    "c13_architecture_type",
    """WITH t AS (SELECT p_brand, list(DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'React' WHEN 'SMALL' THEN 'FastAPI' WHEN 'PROMO' THEN 'Vue' ELSE p_type END) AS fw FROM part GROUP BY p_brand)
      SELECT p_brand, CASE WHEN list_has_any(fw,['React','Next.js','Vue']) THEN 'Client Application' WHEN list_has_any(fw,['FastAPI','Django','Flask']) THEN 'Backend Service' END AS architecture_type FROM t""",
)
def architecture_type(spark, folder):
    kind = F.col("p_type")
    name = F.when(kind == "ECONOMY", "React").when(kind == "SMALL", "FastAPI").when(kind == "PROMO", "Vue").otherwise(kind)
    # at most six distinct names per brand, so the set stays small whatever the row count
    return (
        b.table(spark, folder, "part")
        .groupBy("p_brand")
        .agg(F.collect_set(name).alias("frameworks"))
        .select("p_brand", roles.architecture_type("frameworks").alias("architecture_type"))
    )


@query(
    "p10_language_and_flags",
    b.ctes("files") + r"""SELECT path, CASE regexp_extract(path,'\.([a-z]+)$',1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'md' THEN 'Markdown' END AS language,
      false AS is_config, contains(path,'/README') AS is_readme FROM files""",
)
def languages(spark, folder):
    return b.files(spark, folder).select(
        "path",
        roles.language("path").alias("language"),
        roles.is_config_file("path").alias("is_config"),
        roles.is_readme("path").alias("is_readme"),
    )


@query(
    "p11_environment_and_deployment_paths",
    f"WITH p AS ({_PAGE_PARTS}), q AS (" + r"""SELECT page_id, 'Deploy'||path||CASE page_id%3 WHEN 0 THEN '/config.py' WHEN 1 THEN '/site.YML' ELSE '/Dockerfile' END AS file FROM p)
      SELECT page_id, page_id%3=0 AS environment, (page_id%3=1 OR page_id%3=2) AS deployment FROM q""",
)
def special_paths(spark, folder):
    which = F.col("page_id") % 3
    tail = F.when(which == 0, "/config.py").when(which == 1, "/site.YML").otherwise("/Dockerfile")
    rows = b.table(spark, folder, "pages").select(
        "page_id", F.concat(F.lit("Deploy"), paths.url_path("url"), tail).alias("file")
    )
    return rows.select(
        "page_id",
        roles.is_environment_path("file").alias("environment"),
        roles.is_deployment_path("file").alias("deployment"),
    )


@query(
    "p13_producer_parts",
    "SELECT p_partkey, regexp_extract(p_type||'#'||p_brand,'^(.*)#([^#]*)$',1) AS name, regexp_extract(p_type||'#'||p_brand,'^(.*)#([^#]*)$',2) AS version, p_type AS bare_name, '' AS bare_version FROM part",
)
def producer_parts(spark, folder):
    full = text.producer_parts(F.concat("p_type", F.lit("#"), "p_brand"), "#")
    bare = text.producer_parts(F.col("p_type"), "#")
    return b.table(spark, folder, "part").select(
        "p_partkey",
        full["name"].alias("name"),
        full["version"].alias("version"),
        bare["name"].alias("bare_name"),
        bare["version"].alias("bare_version"),
    )


_REQUEST_SQL = """SELECT event_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'error' THEN 'OPTIONS' ELSE 'POST' END AS method,
  CASE event_type WHEN 'signup' THEN '/auth/register' WHEN 'purchase' THEN '/analysis/'||user_id||'/start' WHEN 'click' THEN '/ai/'||user_id ELSE '/docs' END AS path FROM events"""


@query(
    "p14_request_class",
    f"WITH r AS ({_REQUEST_SQL})" + """SELECT event_id, CASE WHEN method='OPTIONS' OR path LIKE '/docs%' THEN NULL WHEN method='POST' AND path='/auth/register' THEN 'auth'
      WHEN path LIKE '/ai/%' THEN 'ai' WHEN method='POST' AND path LIKE '/analysis/%/start' THEN 'heavy' ELSE 'default' END AS class FROM r""",
)
def request_class(spark, folder):
    kind, user = F.col("event_type"), F.col("user_id")
    method = F.when(kind == "view", "GET").when(kind == "error", "OPTIONS").otherwise("POST")
    path = (
        F.when(kind == "signup", "/auth/register")
        .when(kind == "purchase", F.concat(F.lit("/analysis/"), user, F.lit("/start")))
        .when(kind == "click", F.concat(F.lit("/ai/"), user))
        .otherwise("/docs")
    )
    return b.table(spark, folder, "events").select("event_id", paths.request_class(method, path).alias("class"))


@query(
    "f13_f14_module_of_file",
    b.ctes("files") + f""", r AS (SELECT path, {_ROLE_SQL} AS role FROM files), m AS (SELECT path, role, CASE WHEN role='route' THEN 'api' WHEN role='service' THEN 'services'
       WHEN role='model' THEN 'domain' WHEN role='documentation' THEN 'documentation' WHEN path LIKE '%.py' THEN path ELSE split_part(path,'/',1) END AS m FROM r)
      SELECT path, 'module:'||m AS module_id, CASE WHEN contains(m,'/') THEN CASE WHEN m LIKE '%/__init__.py' THEN split_part(m,'/',-2) ELSE regexp_replace(split_part(m,'/',-1),'\\.[^.]+$','') END
        ELSE upper(m[1:1])||m[2:] END AS name FROM m""",
)
def module_of_file(spark, folder):
    module = roles.module_id("path", "role", F.col("path").endswith(".py"))
    return (
        b.files(spark, folder)
        .select("path", roles.file_role("path").alias("role"))
        .select("path", module.alias("module_id"))
        .withColumn("name", roles.module_display_name("module_id"))
    )


@query("f15_strip_discriminator", "SELECT p_partkey, regexp_replace(p_brand,'#[0-9]+$','') AS brand FROM part")
def strip_discriminator(spark, folder):
    return b.table(spark, folder, "part").select("p_partkey", text.strip_discriminator("p_brand").alias("brand"))


@query(
    "f16_path_of_key",
    b.ctes("nodes") + """SELECT stable_key, regexp_replace(stable_key,'^/+','') AS file_path, CASE WHEN contains(name,'RE') THEN name END AS symbol_path, '' AS root_module FROM nodes""",
)
def path_of_key(spark, folder):
    return b.nodes(spark, folder).select(
        "stable_key",
        paths.path_of_key(F.lit("file"), F.concat(F.lit("file:/"), "stable_key")).alias("file_path"),
        paths.path_of_key(
            F.lit("symbol"), F.when(F.col("name").contains("RE"), F.concat("name", F.lit("::f"))).otherwise(F.col("name"))
        ).alias("symbol_path"),
        paths.path_of_key(F.lit("module"), F.lit("mod:")).alias("root_module"),
    )


@query("f17_edge_id", b.ctes("edges") + "SELECT subject_key, predicate, object_key, edge_id FROM edges")
def edge_ids(spark, folder):
    return b.edges(spark, folder).select("subject_key", "predicate", "object_key", "edge_id")


@query(
    "f18_observation_id",
    b.ctes("obs") + """SELECT observation_id, 'obs:sha256:'||sha256('{"evidence":{"end_line":'||line||',"extractor":"ast","extractor_version":"1.0.0","path":"'||path||'","start_line":'||line||
     '},"observed_kind":"call","ordinal":1,"referent_text":'||CASE WHEN size%2=0 THEN '"'||brand||'"' ELSE 'null' END||',"revision":{"kind":"git","value":"'||type||'"},"schema_version":"ri.v1","subject":{"kind":"file","stable_key":"file:'||path||'"}}') AS id FROM obs""",
)
def observation_ids(spark, folder):
    obs = b.observations(spark, folder)
    referent = F.when(F.col("size") % 2 == 0, F.col("brand"))
    evidence = {
        "path": "path",
        "start_line": "line",
        "end_line": "line",
        "extractor": F.lit("ast"),
        "extractor_version": F.lit("1.0.0"),
    }
    identifier = identity.observation_id(
        F.lit("git"), "type", F.lit("call"), F.lit("file"), F.concat(F.lit("file:"), "path"), referent, F.lit(1), evidence
    )
    return obs.select("observation_id", identifier.alias("id"))


@query(
    "f19_assertion_id",
    """SELECT d.doc_id, 'assertion:sha256:'||sha256('{"derived_from":[{"kind":"node","stable_key":"doc:'||d.doc_id||'"},{"edge_id":"edge:'||source||'","kind":"edge"}],"predicate":"classified_as","producer":"labels","producer_version":"1","schema_version":"ri.v1","subject":{"kind":"document","stable_key":"doc:'||d.doc_id||'"},"truth_class":"inferred","value":{"classification":"'||quality||'","confidence":"heuristic"}}') AS id
     FROM labels l JOIN documents d USING (doc_id)""",
)
def assertion_ids(spark, folder):
    rows = b.table(spark, folder, "labels").join(
        b.table(spark, folder, "documents").select("doc_id", "source"), "doc_id"
    )
    key = F.concat(F.lit("doc:"), F.col("doc_id"))

    def reference(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("identity"))

    edge = reference("edge", F.concat(F.lit("edge:"), "source"))
    references = F.array(edge, reference("node", key), edge)
    value = identity.sorted_struct(classification=F.col("quality").cast("string"), confidence=F.lit("heuristic"))
    identifier = identity.assertion_id(
        F.lit("document"),
        key,
        F.lit("classified_as"),
        value,
        F.lit("inferred"),
        F.lit("labels"),
        F.lit("1"),
        identity.derived_from_json(references),
    )
    return rows.select("doc_id", identifier.alias("id"))


@query(
    "f20_f22_producer_and_config_hash",
    """WITH t AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY p_brand)
      SELECT p_brand, 'sha256:'||sha256('["'||array_to_string(types,'","')||'"]') AS producers, 'sha256:'||sha256('{"extractors":["'||array_to_string(types,'","')||'"],"max_bytes":524288}') AS config,
       'sha256:'||sha256('{}') AS empty_config FROM t""",
)
def producer_and_config_hash(spark, folder):
    # at most six part types per brand
    sets = b.table(spark, folder, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"))
    config = F.struct(F.concat("types", "types").alias("extractors"), F.lit(524288).alias("max_bytes"))
    return sets.select(
        "p_brand",
        identity.producer_set_hash("types").alias("producers"),
        identity.config_hash(config, ("extractors",)).alias("config"),
        identity.config_hash(F.lit(None).cast("struct<a:string>")).alias("empty_config"),
    )


@query(
    "f21_finding_id",
    b.ctes("diag") + """SELECT event_id, 'finding:'||sha256('{"code":"'||code||'","line":'||coalesce(CAST(span_start AS VARCHAR),'null')||',"path":"'||path||'"}') AS id FROM diag""",
)
def finding_ids(spark, folder):
    document = identity.canonical_json(code="code", path="path", line="span_start")
    return b.diagnostics(spark, folder).select("event_id", identity.stable_id("finding", document).alias("id"))


@query(
    "f23_revision_format",
    b.ctes("rev") + """SELECT revision_id, true AS git_ok, false AS bad_ref, true AS upload_ok, false AS upload_with_ref FROM rev""",
)
def revision_format(spark, folder):
    value = F.col("revision_value")
    sha = F.substring(value, 1, 40)
    none = F.lit(None).cast("string")
    check = identity.revision_is_valid
    return b.revisions(spark, folder).select(
        "revision_id",
        check(F.lit("git"), sha, F.concat(F.lit("refs/heads/"), "branch")).alias("git_ok"),
        check(F.lit("git"), sha, F.col("branch")).alias("bad_ref"),
        check(F.lit("upload"), F.concat(F.lit("sha256:"), value), none).alias("upload_ok"),
        check(F.lit("upload"), F.concat(F.lit("sha256:"), value), F.lit("refs/x")).alias("upload_with_ref"),
    )


@query(
    "f24_f25_source_and_archive_name",
    r"""SELECT page_id, lower(regexp_replace(url,'^https?://','')) AS source_key, 'page.'||page_id AS archive, 'n'||page_id AS stem FROM pages""",
)
def source_and_archive(spark, folder):
    number = F.col("page_id").cast("string")
    suffix = F.when(F.col("page_id") % 2 == 0, ".tar.GZ").otherwise(".zip")
    return b.table(spark, folder, "pages").select(
        "page_id",
        paths.source_key("url").alias("source_key"),
        paths.archive_name(F.concat(F.lit("page."), number, suffix)).alias("archive"),
        paths.archive_name(F.concat(F.lit("n"), number, F.lit(".txt"))).alias("stem"),
    )


@query("f26_content_hash", "SELECT doc_id, 'sha256:'||sha256(text) AS digest FROM documents")
def content_hash(spark, folder):
    return b.table(spark, folder, "documents").select(
        "doc_id", identity.sha256_of(F.encode("text", "UTF-8")).alias("digest")
    )


@query("f27_utc_time", "SELECT event_id, ts AS utc, ts - INTERVAL 1 HOUR AS from_berlin FROM events")
def utc_time(spark, folder):
    return b.table(spark, folder, "events").select(
        "event_id",
        F.to_utc_timestamp("ts", "UTC").cast("timestamp_ntz").alias("utc"),
        F.to_utc_timestamp("ts", "Europe/Berlin").cast("timestamp_ntz").alias("from_berlin"),
    )


@query(
    "f28_retry_and_lease",
    b.ctes("job") + "SELECT job_id, CAST(least(pow(2,attempt),60) AS BIGINT) AS delay, lease_expires_at <= TIMESTAMP '1998-06-01' AS expired FROM job",
)
def retry_and_lease(spark, folder):
    return b.jobs(spark, folder).select(
        "job_id",
        text.retry_delay("attempt").alias("delay"),
        (F.col("lease_expires_at") <= F.lit("1998-06-01").cast("timestamp")).alias("expired"),
    )


@query(
    "f29_interpolation",
    r"""SELECT page_id, regexp_matches(' '||replace(html,'#','$'),'[^$]\$(\{[^}]*\}|[A-Za-z_][A-Za-z0-9_]*)') AS templated FROM pages""",
)
def interpolation(spark, folder):
    return b.table(spark, folder, "pages").select(
        "page_id", text.has_interpolation(F.translate("html", "#", "$")).alias("templated")
    )


@query(
    "f30_escape_html",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&#x27;')) AS digest FROM pages""",
)
def escape_html(spark, folder):
    return b.table(spark, folder, "pages").select("page_id", F.md5(text.escape_html("html")).alias("digest"))


@query(
    "r8_import_binding",
    b.ctes("imports") + """SELECT source_path, specifier, CASE WHEN specifier NOT LIKE './%' THEN specifier END AS module, CASE WHEN specifier NOT LIKE './%' THEN 'a|b' END AS local FROM imports""",
)
def import_binding(spark, folder):
    missing = F.when(F.col("specifier").startswith("./"), "").otherwise("x")
    parsed = text.import_binding(F.concat_ws("|", "specifier", missing, F.lit("a|b")))
    return b.imports(spark, folder).select(
        "source_path", "specifier", parsed["specifier"].alias("module"), parsed["local"].alias("local")
    )
