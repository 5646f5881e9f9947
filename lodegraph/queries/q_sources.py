"""Source triage, lines, manifests, sinks and streams over whole tables."""

from pyspark.sql import functions as F

from lodegraph.queries import bindings as b
from lodegraph.queries.registry import query
from lodegraph.session import scratch_folder
from lodegraph.sources import inventory, tables
from lodegraph.streaming import anchored, jobs


@query(
    "s1_s2_stored_facts_roundtrip",
    b.ctes("nodes") + "SELECT node_kind AS snapshot_id, count(*) AS n, min(stable_key) AS first_key FROM nodes WHERE node_kind IN ('part','supplier') GROUP BY 1",
)
def stored_facts(spark, folder):
    store = scratch_folder(spark, "facts")
    nodes = b.nodes(spark, folder).select(
        F.col("node_kind").alias("snapshot_id"),
        "stable_key",
        "node_kind",
        "name",
        F.lit(None).cast("string").alias("language"),
        F.lit("observed").alias("truth_class"),
        F.lit(None).cast("map<string,string>").alias("properties"),
    )
    # facts come in two batches that overlap
    tables.append_facts(nodes.where("stable_key < 'part:5'"), store, "nodes", ["stable_key"])
    tables.append_facts(nodes, store, "nodes", ["stable_key"])
    stored = tables.load_facts(spark, store, "part", "supplier")
    return (
        stored["nodes"]
        .groupBy("snapshot_id")
        .agg(F.count("*").alias("n"), F.min("stable_key").alias("first_key"))
    )


@query(
    "s3_merged_batches",
    "SELECT k AS l_partkey, count(*) AS n_rows, min(f) AS flag FROM (SELECT l_partkey AS k, 'x' AS f FROM lineitem UNION ALL SELECT p_partkey,'x' FROM part) GROUP BY k",
)
def merged_batches(spark, folder):
    flag = F.lit("x").alias("flag"), F.lit("p").alias("path")
    batches = [
        b.table(spark, folder, "lineitem").select("l_partkey", *flag),
        b.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), *flag),
    ]
    return tables.merge_batches(batches, ["l_partkey"], ["flag"], ["path"])[0]


@query(
    "s4_scanned_tree",
    "SELECT lang AS folder, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1",
)
def scanned_tree(spark, folder):
    """Documents written as text files below a folder for each language; some folders are ignored ones.

    Hidden files are source files as well, so those that Spark's writer adds are left out here.
    """
    root = scratch_folder(spark, "tree")
    rows = b.table(spark, folder, "documents").select("text", "lang")
    for lang, name in (("en", "en"), ("fr", "src/fr"), ("de", "node_modules/de"), ("es", "src/.venv/es")):
        rows.where(F.col("lang") == lang).select("text").write.text(f"{root}/{name}")
    files = inventory.scan_tree(spark, root).where(F.element_at(F.split("path", "/"), -1).startswith("part-"))
    name = F.element_at(F.split("path", "/"), -2).alias("folder")
    return files.groupBy(name).agg(F.sum(F.length("content")).cast("bigint").alias("bytes"))


@query(
    "s4_s5_inventory_paths",
    b.ctes("named") + """, p AS (SELECT '/'||CASE lang WHEN 'de' THEN 'build/' WHEN 'es' THEN 'lib/._' ELSE './' END||path AS path FROM named) SELECT DISTINCT replace(path,'/./','') AS path FROM p WHERE path NOT LIKE '/build/%' AND path NOT LIKE '/lib/.~_%' ESCAPE '~'""",
)
def inventory_paths(spark, folder):
    lang = F.col("lang")
    prefix = F.when(lang == "de", "build/").when(lang == "es", "lib/._").otherwise("./")
    raw = b.named_documents(spark, folder).select(F.concat(F.lit("/"), prefix, "path").alias("path"))
    return inventory.distinct_paths(raw.where(inventory.is_source_path("path")))


@query(
    "s6_source_triage",
    """SELECT doc_id, CASE WHEN lang='de' THEN 'RI-SEC-PATH-ESCAPE' WHEN lang='es' THEN 'RI-SRC-BINARY' WHEN lang='fr' THEN 'RI-SRC-MALFORMED' END AS code FROM documents""",
)
def source_triage(spark, folder):
    lang, raw = F.col("lang"), F.encode("text", "UTF-8")
    nul, broken = F.unhex(F.lit("00")), F.unhex(F.lit("C328"))
    # the marker replaces the first two bytes, so sizes stay as they are
    rest = F.substring(raw, 3, 2147483647)
    content = (
        F.when((lang == "es"), F.concat(nul, F.unhex(F.lit("20")), rest))
        .when(lang == "fr", F.concat(broken, rest))
        .otherwise(raw)
    )
    path = F.when(lang == "de", F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    files = b.named_documents(spark, folder).select("doc_id", path.alias("path"), content.alias("content"))
    return inventory.triage(files).select("doc_id", "code")


@query(
    "s7_line_table",
    "SELECT doc_id, n AS line_number, md5(l) AS digest FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS l, unnest(range(1, len(string_split(text,chr(10)))+1)) AS n FROM documents)",
)
def line_table(spark, folder):
    return inventory.lines(b.table(spark, folder, "documents"), "doc_id").select(
        "doc_id", "line_number", F.md5("line").alias("digest")
    )


@query(
    "s7_logical_line_count",
    "SELECT doc_id, length(text)-length(replace(text,chr(10),''))+1 AS line_count FROM documents",
)
def logical_lines(spark, folder):
    return inventory.line_counts(b.table(spark, folder, "documents"), "doc_id")


@query(
    "s8_previews",
    b.ctes("named") + """SELECT doc_id, octet_length(encode(text)) AS size, false AS truncated, contains(text, chr(0)) AS is_binary, regexp_matches(path, '[.](png|jpg|jpeg|gif|webp|svg|ico|bmp)$') AS is_image, md5(text) AS digest FROM named""",
)
def previews(spark, folder):
    files = b.named_documents(spark, folder).select(
        F.concat_ws("|", "doc_id", "path").alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return inventory.previews(files).select(
        F.substring_index("path", "|", 1).cast("long").alias("doc_id"),
        "size",
        "truncated",
        "is_binary",
        "is_image",
        F.md5("text").alias("digest"),
    )


@query(
    "s9_requirements",
    r"""WITH l AS (SELECT doc_id, n AS line_number, regexp_replace(regexp_replace(l,'^\s+',''),'\s+$','') AS v FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS l, unnest(range(1, len(string_split(text,chr(10)))+1)) AS n FROM documents)),
      k AS (SELECT doc_id, line_number, regexp_replace(regexp_replace(v,'\s+#.*$',''),'\s+$','') AS v FROM l WHERE v<>'' AND v[1] NOT IN ('#','-','.')),
      s AS (SELECT doc_id, line_number, v, regexp_extract(v,'^[^\[<>=!~@\s]*') AS name FROM k)
      SELECT doc_id, line_number, name, nullif(regexp_replace(regexp_replace(v[length(name)+1:],'^\s+',''),'\s+$',''),'') AS version FROM s WHERE name<>''""",
)
def requirements(spark, folder):
    return inventory.requirements(b.table(spark, folder, "documents"), "doc_id")


def _manifests(spark, folder):
    """A package.json per event: errors carry a number as the version, signups a list as a section."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    version = F.when(kind == "error", k).otherwise(F.concat(F.lit('"^'), k, F.lit('"')))
    development = F.when(kind == "signup", "[1]").otherwise(F.concat(F.lit('{"@types/'), kind, F.lit('":"*"}')))
    return b.table(spark, folder, "events").select(
        "event_id",
        F.concat(
            F.lit('{"name":"x","dependencies":{"pkg'), F.col("user_id"), F.lit('":'), version, F.lit('},"devDependencies":'), development, F.lit("}")
        ).alias("text"),
    )


@query(
    "s10_npm_declarations",
    """SELECT event_id, 'production' AS dependency_type, 'pkg'||user_id AS name, '^'||CAST(json_extract(props,'$.k') AS INT) AS version FROM events WHERE event_type NOT IN ('error','signup')
      UNION ALL SELECT event_id, 'development', '@types/'||event_type, '*' FROM events WHERE event_type NOT IN ('error','signup')""",
)
def npm_declarations(spark, folder):
    return inventory.npm_declarations(_manifests(spark, folder), "event_id")[0]


@query("s10_npm_malformed", "SELECT event_id, 'RI-SRC-MALFORMED' AS code FROM events WHERE event_type IN ('error','signup')")
def npm_malformed(spark, folder):
    return inventory.npm_declarations(_manifests(spark, folder), "event_id")[1]


def _lockfiles(spark, folder):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    version = F.when(kind == "error", "1").when(kind == "signup", '"3"').otherwise("3")
    flags = F.when(kind == "click", ',"dev":true,"optional":true').when(kind == "view", ',"devOptional":true').otherwise("")
    body = F.concat(
        F.lit('{"lockfileVersion":'), version,
        F.lit(',"packages":{"":{"version":"1"},"node_modules/a/node_modules/@s/p'), F.col("user_id"),
        F.lit('":{"version":"1.'), k, F.lit('"'), flags, F.lit('},"node_modules/linked":{"version":"2","link":true},"node_modules/bare":{}}}'),
    )
    return b.table(spark, folder, "events").select("event_id", body.alias("text"))


@query(
    "s11_npm_resolutions",
    """SELECT event_id, 'node_modules/a/node_modules/@s/p'||user_id AS entry, '@s/p'||user_id AS name, '1.'||CAST(json_extract(props,'$.k') AS INT) AS version,
      CASE event_type WHEN 'click' THEN 'optional' WHEN 'view' THEN 'development' ELSE 'production' END AS scope FROM events WHERE event_type NOT IN ('error','signup')""",
)
def npm_resolutions(spark, folder):
    return inventory.npm_resolutions(_lockfiles(spark, folder), "event_id")[0]


@query(
    "s11_npm_lockfile_diagnostics",
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'RI-EXT-UNSUPPORTED' ELSE 'RI-SRC-MALFORMED' END AS code FROM events WHERE event_type IN ('error','signup')",
)
def lockfile_diagnostics(spark, folder):
    return inventory.npm_resolutions(_lockfiles(spark, folder), "event_id")[1]


@query(
    "s12_json_export",
    """SELECT '{"o_orderkey":'||o_orderkey||',"o_orderstatus":"'||o_orderstatus||'","note":null}' AS value FROM orders""",
)
def json_export(spark, folder):
    orders = b.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("note"))
    return tables.as_json(orders)


@query(
    "s13_markdown_report",
    b.ctes("diag") + """, t AS (SELECT code, severity, count(*) AS n FROM diag GROUP BY ALL)
      SELECT 1 AS section, 1 AS part, '# Findings' AS line UNION ALL SELECT 2,1,'| code | severity | n |' UNION ALL SELECT 2,1,'| --- | --- | --- |'
      UNION ALL SELECT 2,2,'| '||code||' | '||severity||' | '||n||' |' FROM t UNION ALL SELECT DISTINCT 3,3,'- '||path FROM diag""",
)
def markdown_report(spark, folder):
    diagnostics = b.diagnostics(spark, folder)
    counted = diagnostics.groupBy("code", "severity").agg(F.count("*").alias("n"))
    columns = ["code", "severity", "n"]
    title = tables.markdown_lines(spark, 1, ["# Findings"])
    table = tables.markdown_table(counted, 2, columns, [F.col("code"), F.col("severity")])
    bullets = tables.markdown_bullets(diagnostics.select("path").distinct(), 3, "path")
    return title.unionByName(table).unionByName(bullets).drop("position")


@query(
    "s14_purged_facts",
    """WITH f AS (SELECT DISTINCT 'order:'||lpad(CAST(o_orderkey AS VARCHAR),9,'0') AS s FROM orders JOIN lineitem ON l_orderkey=o_orderkey WHERE o_orderstatus='P'),
      l AS (SELECT 'order:'||lpad(CAST(l_orderkey AS VARCHAR),9,'0') AS s FROM lineitem) SELECT s AS snapshot_id, count(*) AS n FROM l WHERE s NOT IN (SELECT s FROM f) GROUP BY s""",
)
def purged_facts(spark, folder):
    def key(column):
        return F.concat(F.lit("order:"), F.lpad(F.col(column).cast("string"), 9, "0")).alias("snapshot_id")

    snapshots = b.table(spark, folder, "orders").select(
        key("o_orderkey"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("state")
    )
    kept = tables.purge(b.table(spark, folder, "lineitem").select(key("l_orderkey")), snapshots)
    return kept.groupBy("snapshot_id").agg(F.count("*").alias("n"))


@query(
    "s15_orphaned_folders",
    "SELECT o_orderkey, count(*) AS files, CAST(sum(round(o_totalprice)) AS BIGINT) AS bytes FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
)
def orphaned_folders(spark, folder):
    stored = b.table(spark, folder, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    known = b.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.orphans(stored, known, "o_orderkey", "size")


@query(
    "x1_extractor_conflicts",
    b.ctes("files") + """, c AS (SELECT path, concat_ws(',', CASE WHEN path LIKE '%.py' THEN 'python' END, CASE WHEN path LIKE '%.ts' THEN 'typescript' END, CASE WHEN contains(path,'/routes/') THEN 'routes' END) AS claims FROM files) SELECT path, claims FROM c WHERE contains(claims,',')""",
)
def extractor_conflicts(spark, folder):
    path = F.col("path")
    extractors = {"python": path.endswith(".py"), "typescript": path.endswith(".ts"), "routes": path.contains("/routes/")}
    return inventory.extractor_conflicts(b.files(spark, folder), extractors)


# --- streams -----------------------------------------------------------------


def _chain_sql(width: int, key: str = "user_id") -> str:
    return f"""WITH RECURSIVE h AS (SELECT event_id, {key} AS key, ts, event_type, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
      w AS (SELECT key, n, event_id, ts, ts AS start, CAST(1 AS BIGINT) AS c FROM h WHERE n=1
        UNION ALL SELECT h.key, h.n, h.event_id, h.ts, CASE WHEN h.ts - w.start >= INTERVAL {width} SECOND THEN h.ts ELSE w.start END, CASE WHEN h.ts - w.start >= INTERVAL {width} SECOND THEN 1 ELSE w.c+1 END FROM w JOIN h ON h.key=w.key AND h.n=w.n+1)"""


def _counted(spark, folder, width, chunk=None):
    events = b.table(spark, folder, "events").select("event_id", "user_id", "ts")
    return anchored.anchored_hits(
        events, "user_id", "ts", "event_id", width, F.shiftright("event_id", 20), chunk=chunk
    )


_HIT_COLUMNS = "event_id, start AS window_start, c AS hit_count, greatest(1, CAST(ceil(({w}000000 - (epoch_us(ts)-epoch_us(start)))/1000000) AS BIGINT)) AS reset_seconds"


@query("t1_anchored_windows_hour", _chain_sql(3600) + " SELECT " + _HIT_COLUMNS.format(w=3600) + " FROM w")
def anchored_hour(spark, folder):
    return _counted(spark, folder, 3600).select("event_id", "window_start", "hit_count", "reset_seconds")


@query("t1_anchored_windows_day", _chain_sql(86400) + " SELECT " + _HIT_COLUMNS.format(w=86400) + " FROM w")
def anchored_day(spark, folder):
    # chunks of three days: windows cross many chunk borders
    return _counted(spark, folder, 86400, 3 * 86400).select("event_id", "window_start", "hit_count", "reset_seconds")


@query(
    "t2_over_budget",
    _chain_sql(86400, "event_type||':'||user_id")
    + " SELECT event_id, c AS hit_count, c > CASE split_part(key,':',1) WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 1 END AS over_budget FROM w",
)
def over_budget(spark, folder):
    events = b.table(spark, folder, "events").select(
        "event_id", "event_type", "ts", F.concat_ws(":", "event_type", "user_id").alias("caller")
    )
    counted = anchored.anchored_hits(events, "caller", "ts", "event_id", 86400, F.shiftright("event_id", 20))
    flagged = anchored.over_budget(counted, "event_type", {"click": 2, "view": 3}, 1)
    return flagged.select("event_id", "hit_count", "over_budget")


def _event_stream(spark, folder):
    schema = b.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query("t1_stream_window_counts", _chain_sql(3600) + " SELECT event_id, start AS window_start, c AS hit_count FROM w")
def stream_window_counts(spark, folder):
    out = scratch_folder(spark, "hits")
    hits = _event_stream(spark, folder).select("event_id", "user_id", "ts")
    jobs.count_hits(hits, "user_id", "ts", "event_id", 3600, F.shiftright("event_id", 20), out).awaitTermination()
    return spark.read.parquet(f"{out}/hits").select("event_id", "window_start", "hit_count")


@query(
    "t3_stream_ingest",
    "SELECT user_id, event_type, count(*) AS n_rows, 'events' AS producer FROM events GROUP BY ALL",
)
def stream_ingest(spark, folder):
    out = scratch_folder(spark, "ingest")
    rows = _event_stream(spark, folder).select("user_id", "event_type", F.lit("events").alias("producer"), "event_id")
    jobs.ingest_facts(rows, ["user_id", "event_type"], ["producer"], ["event_id"], out).awaitTermination()
    return jobs.ingested(spark, out, ["user_id", "event_type"])["facts"]


@query(
    "t3_stream_replays_and_conflicts",
    """WITH r AS (SELECT doc_id, lang, source FROM documents UNION ALL SELECT doc_id, lang, source FROM documents),
       k AS (SELECT source, count(DISTINCT lang) AS n FROM r GROUP BY 1)
       SELECT 'evidence' AS kind, source, CAST(doc_id AS VARCHAR) AS item FROM (SELECT DISTINCT source, doc_id FROM r)
       UNION ALL SELECT 'conflict', source, NULL FROM k WHERE n > 1
       UNION ALL SELECT 'fact', source, min(lang) FROM r WHERE source IN (SELECT source FROM k WHERE n = 1) GROUP BY source""",
)
def stream_replays_and_conflicts(spark, folder):
    """Documents arrive in several batches, each of them twice; most sources have more than one language."""
    out = scratch_folder(spark, "replays")
    rows = b.table(spark, folder, "documents").select("doc_id", "lang", "source")
    for _ in range(2):
        rows.repartition(3, "doc_id").write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    jobs.ingest_facts(stream, ["source"], ["lang"], ["doc_id"], out).awaitTermination()
    found = jobs.ingested(spark, out, ["source"])
    return (
        found["evidence"].select(F.lit("evidence").alias("kind"), "source", F.col("doc_id").cast("string").alias("item"))
        .unionByName(found["conflicts"].select(F.lit("conflict").alias("kind"), "source", F.lit(None).cast("string").alias("item")))
        .unionByName(found["facts"].select(F.lit("fact").alias("kind"), "source", F.col("lang").alias("item")))
    )


@query(
    "j10_diagnostic_rules",
    b.ctes("diag") + """SELECT event_id, CASE WHEN code LIKE 'RI-RES%' THEN 'relationship_resolution' ELSE 'source_extraction' END AS category,
      CASE code WHEN 'RI-RES-UNRESOLVED' THEN 'Unresolved relationship' WHEN 'RI-RES-AMBIGUOUS' THEN 'Ambiguous relationship' WHEN 'RI-EXT-UNSUPPORTED' THEN 'Unsupported source construct' ELSE 'Malformed source' END AS title FROM diag WHERE code<>'RI-OTHER'""",
)
def diagnostic_rules(spark, folder):
    from lodegraph.plans.review import with_rules

    return with_rules(b.diagnostics(spark, folder)).select("event_id", "category", "title")


