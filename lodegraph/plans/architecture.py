"""Module graph lifted from file, symbol and dependency facts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import paths, roles
from lodegraph.operators import facts, summaries
from lodegraph.operators.resolve import union_all
from lodegraph.session import checkpoint

# Manifest and lockfile names that never form a module.
MANIFESTS = (
    "package.json", "pyproject.toml", "requirements.txt", "package-lock.json", "poetry.lock",
)
UNTELLING_ROLES = ("unknown", "documentation", "test")


def module_members(files: DataFrame, related: DataFrame) -> DataFrame:
    """(path, role, module_id) of files that take part in the structure.

    ``files``: path, role, defines_symbols.  ``related``: path of every file edge end.
    A file counts when it defines symbols, is related, or has a known role.
    """
    touched = related.select("path").distinct().withColumn("_related", F.lit(True))
    rows = files.where(~paths.basename("path").isin(*MANIFESTS)).join(touched, "path", "left")
    known = F.col("role").isNotNull() & (F.col("role") != "unknown")
    kept = rows.where(F.col("defines_symbols") | F.col("_related").isNotNull() | F.coalesce(known, F.lit(False)))
    return kept.select("path", "role", roles.module_id("path", "role", F.col("defines_symbols")).alias("module_id"))


def modules(members: DataFrame) -> DataFrame:
    """One row per module: dominant role, layer, common folder and file count."""
    telling = members.where(F.col("role").isNotNull() & ~F.col("role").isin(*UNTELLING_ROLES))
    main = summaries.dominant(telling, ["module_id"], "role", "path")
    totals = members.groupBy("module_id").agg(
        F.count(F.lit(1)).alias("files"),
        summaries.path_prefix("path").alias("path_prefix"),
        F.min(F.struct("path", "role"))["role"].alias("_first_role"),
    )
    named = totals.join(main, "module_id", "left").withColumn(
        "role", F.coalesce("role", "_first_role", F.lit("unknown"))
    )
    shown = disambiguate(
        named.withColumn("name", roles.module_display_name("module_id")).withColumn(
            "_path", F.regexp_replace("module_id", "^module:", "")
        ),
        "_path",
        "name",
    )
    return shown.select(
        "module_id", F.col("display").alias("name"), "role", roles.layer("role").alias("layer"), "path_prefix", "files"
    )


def disambiguate(named: DataFrame, path: str, name: str) -> DataFrame:
    """Add ``display``: a colliding name gets the nearest folder that differs from it."""
    sizes = named.groupBy(name).agg(F.count(F.lit(1)).alias("_same"))
    folders = F.filter(
        F.reverse(F.split(paths.directory(path), "/")), lambda s: (s != "") & (s != F.col(name))
    )
    nearest = F.get(folders, F.lit(0))
    display = F.when((F.col("_same") > 1) & nearest.isNotNull(), F.concat_ws("/", nearest, F.col(name))).otherwise(F.col(name))
    return named.join(sizes, name).withColumn("display", display).drop("_same")


def module_folders(members: DataFrame) -> DataFrame:
    """(folder, module_id) for every folder above a member file, the root included."""
    return members.select(F.explode(paths.ancestors("path")).alias("folder"), "module_id").distinct()


def _ends(edges: DataFrame, members: DataFrame, edge_evidence: DataFrame, node_evidence: DataFrame) -> DataFrame:
    """(edge_id, side, node_id, folder, alone) for both sides of the edges, in one pass.

    An end is a node, or a folder that stands for the modules with files below it; the other column is null.  ``alone``
    says that the side has no other end.

    Each side asks for files or folders by level: what the edge's own evidence says (of subjects only), without any
    what the node's evidence says, and if no file answers, the folder that the key names.
    """
    sides = edges.select(
        "edge_id",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(s).alias("side"), F.col(f"{s}_kind").alias("kind"), F.col(f"{s}_key").alias("key"))
                    for s in ("subject", "object")
                )
            )
        ),
    ).withColumn("path", paths.path_of_key("kind", "key"))
    plain = F.col("kind").isin("file", "symbol")
    scope = F.col("kind") == "repository"
    other = ~F.col("kind").isin("dependency", "repository", "file", "symbol")
    asks_edge = scope | (other & (F.col("side") == "subject"))

    def asking(rows: DataFrame, what: str, value, level: int) -> DataFrame:
        return rows.select(
            "edge_id", "side", F.lit(level).alias("level"), F.lit(what).alias("what"), value.alias("value")
        )

    seen = sides.where(asks_edge).join(edge_evidence.select("edge_id", F.col("path").alias("_at")), "edge_id", "left")
    blind = sides.where(other & (F.col("side") == "object")).unionByName(
        seen.where(other & F.col("_at").isNull()).drop("_at")
    )
    by_node = blind.join(node_evidence.select(F.col("stable_key").alias("key"), F.col("path").alias("_at")), "key")
    asked = union_all(
        [
            asking(sides.where(plain), "file", F.col("path"), 1),
            asking(seen.where(scope), "folder", F.nullif(paths.directory("_at"), F.lit("")), 1),
            asking(seen.where(other), "file", F.col("_at"), 1),
            asking(by_node, "file", F.col("_at"), 1),
            asking(sides.where(other), "folder", F.col("path"), 2),
        ]
    ).where("value IS NOT NULL")
    # a folder answers by itself: its modules times the edges that ask for it would be far more rows than the tables have
    places = members.select(
        F.lit("file").alias("what"), F.col("path").alias("value"), F.col("module_id").alias("node_id"), F.lit(None).cast("string").alias("folder")
    )
    folders = module_folders(members).select("folder").distinct().select(
        F.lit("folder").alias("what"), F.col("folder").alias("value"), F.lit(None).cast("string").alias("node_id"), "folder"
    )
    answers = asked.distinct().join(places.unionByName(folders), ["what", "value"])
    # the levels, the distinct ends of a side and their number are found where its edge is
    at_edge = answers.select("edge_id", "side", "level", "node_id", "folder").repartition("edge_id")
    side = Window.partitionBy("edge_id", "side")
    best = at_edge.withColumn("_best", F.min("level").over(side)).where("level = _best")
    found = (
        best.select("edge_id", "side", "node_id", "folder").distinct().withColumn("alone", F.count(F.lit(1)).over(side) == 1)
    )
    direct = sides.where("kind = 'dependency'").select(
        "edge_id", "side", F.col("key").alias("node_id"), F.lit(None).cast("string").alias("folder"), F.lit(True).alias("alone")
    )
    return found.unionByName(direct)


def _lift(
    edges: DataFrame, edge_evidence: DataFrame, node_evidence: DataFrame, members: DataFrame, known: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(usable edges, edges declared at the root, ends, known modules of folders).

    The ends are as many as the edges and their evidence, whatever the folders hold; those without a known node are
    left out.
    """
    root_rows = (
        edges.where("predicate = 'depends_on' AND subject_kind = 'repository'")
        .select("edge_id")
        .join(edge_evidence, "edge_id")
        .groupBy("edge_id")
        .agg(F.count_if(paths.directory("path") == "").alias("_root"), F.count(F.lit(1)).alias("_all"))
        .where("_root > 0")
    )
    only_root = root_rows.where("_root = _all").select("edge_id")
    # both sides of the edges are asked for in several ways, each from here
    usable = checkpoint(edges.join(only_root, "edge_id", "left_anti"))
    ids = known.select("node_id").distinct()
    inside = module_folders(members).select("folder", F.col("module_id").alias("node_id")).join(ids, "node_id", "left_semi")
    right = ids.select(F.col("node_id").alias("_node"), F.lit(None).cast("string").alias("_folder")).unionByName(
        inside.select(F.lit(None).cast("string").alias("_node"), F.col("folder").alias("_folder")).distinct()
    )
    same = F.col("node_id").eqNullSafe(F.col("_node")) & F.col("folder").eqNullSafe(F.col("_folder"))
    # stored once: the edges, the diagnostics and all their users start from here
    ends = checkpoint(_ends(usable, members, edge_evidence, node_evidence).join(right, same, "left_semi"))
    return usable, root_rows, ends, inside


def _pairs(ends: DataFrame) -> DataFrame:
    """(edge_id, alone, subject, subject_folder, object, object_folder): every end of a side with those of the other."""

    def one(side: str) -> DataFrame:
        return ends.where(F.col("side") == side).select(
            "edge_id", F.col("node_id").alias(side), F.col("folder").alias(f"{side}_folder"), F.col("alone").alias(f"_{side}")
        )

    both = one("subject").join(one("object"), "edge_id")
    return both.withColumn("alone", F.col("_subject") & F.col("_object")).drop("_subject", "_object")


def _nodes_of(pairs: DataFrame, inside: DataFrame) -> DataFrame:
    """``pairs`` with the nodes of both ends as source and target, without pairs of a node with itself."""
    # rows without a folder find nothing, so they are spread by a hash of their own; folders get a mark before them
    own, rows = F.xxhash64(*pairs.columns).cast("string"), pairs
    for side, name in (("subject", "source"), ("object", "target")):
        held = inside.select(F.concat(F.lit("/"), "folder").alias("_at"), F.col("node_id").alias("_module"))
        asked = rows.withColumn("_at", F.coalesce(F.concat(F.lit("/"), f"{side}_folder"), own))
        rows = asked.join(held, "_at", "left").withColumn(name, F.coalesce(side, "_module")).drop("_at", "_module")
    return rows.where("source <> target").drop("subject", "subject_folder", "object", "object_folder")


def lift_edges(
    edges: DataFrame, edge_evidence: DataFrame, node_evidence: DataFrame, members: DataFrame, known: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(module edges, diagnostics).

    Module edges: edge_id, predicate, source, target without self pairs.  An edge
    without any pair of known nodes gives ARCH-REL-ENDPOINT-UNMAPPED, one that only
    stays inside a module gives nothing, and repository declarations at the root
    give ARCH-REL-REPO-SCOPED.

    An edge of a folder has a module edge for each module below it, so these are as many as the edges of a folder
    times its modules.  Where only the pairs of modules count, ``module_pairs`` has them without that product.
    """
    usable, root_rows, ends, inside = _lift(edges, edge_evidence, node_evidence, members, known)
    pairs = usable.select("edge_id", "predicate").join(_pairs(ends), "edge_id")
    # only ends of the same side may share modules
    single = _nodes_of(pairs.where("alone").drop("alone"), inside)
    several = _nodes_of(pairs.where("NOT alone").drop("alone"), inside).distinct()
    # an edge has a pair exactly when both of its sides are known
    mapped = ends.groupBy("edge_id").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b")
    unmapped = usable.select("edge_id").join(mapped, "edge_id", "left_anti")
    diagnostics = root_rows.select("edge_id", F.lit("ARCH-REL-REPO-SCOPED").alias("code"), F.lit("info").alias("severity")).unionByName(
        unmapped.select("edge_id", F.lit("ARCH-REL-ENDPOINT-UNMAPPED").alias("code"), F.lit("warning").alias("severity"))
    )
    return single.unionByName(several), diagnostics


def module_pairs(
    edges: DataFrame, edge_evidence: DataFrame, node_evidence: DataFrame, members: DataFrame, known: DataFrame
) -> DataFrame:
    """(source, target) of the module edges; equal pairs of ends meet before folders become modules."""
    _, _, ends, inside = _lift(edges, edge_evidence, node_evidence, members, known)
    return _nodes_of(_pairs(ends).drop("edge_id", "alone").distinct(), inside).distinct()


def adjacency(lifted: DataFrame) -> DataFrame:
    """(node_id, direction, other): distinct dependencies and dependents, one row each."""
    pairs = lifted.select("source", "target").distinct()
    return pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("node_id"), F.lit("dependency").alias("direction"), F.col("target").alias("other")),
                F.struct(F.col("target").alias("node_id"), F.lit("dependent").alias("direction"), F.col("source").alias("other")),
            )
        )
    )


def relationship_states(nodes: DataFrame, lifted: DataFrame, unresolved: DataFrame, members: DataFrame, covered: DataFrame) -> DataFrame:
    """State per node: connected, unresolved, no-observed-relationships or not-extracted."""
    connected = lifted.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    open_files = members.join(covered.select("path").distinct(), "path", "left_anti").select("module_id").distinct()
    whole = members.select("module_id").distinct().join(open_files, "module_id", "left_anti")

    def flag(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.col(column).alias("node_id"), F.lit(name).alias("mark"))

    marks = (
        union_all([flag(connected, "node_id", "connected"), flag(unresolved, "node_id", "unresolved"), flag(whole, "module_id", "whole")])
        .groupBy("node_id")
        .agg(*(F.max(F.col("mark") == m).alias(f"_{m}") for m in ("connected", "unresolved", "whole")))
    )
    marked = nodes.join(marks, "node_id", "left")
    state = (
        F.when(F.col("_connected"), "connected")
        .when(F.col("_unresolved"), "unresolved")
        .when(F.col("_whole"), "no-observed-relationships")
        .otherwise("not-extracted")
    )
    return marked.withColumn("state", state).drop("_connected", "_unresolved", "_whole")


def prune_external(nodes: DataFrame, lifted: DataFrame) -> DataFrame:
    """Drop external nodes that no module edge touches."""
    ends = lifted.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    external = F.col("layer") == "external"
    return nodes.where(~external).unionByName(nodes.where(external).join(ends, "node_id", "left_semi"))


def notable_symbols(members: DataFrame, symbols: DataFrame, limit: int = 4) -> DataFrame:
    """First public top-level names per module; private names only where there is no public one."""
    named = symbols.join(members.select("path", "module_id"), "path").select("module_id", "symbol").distinct()
    private = F.col("symbol").startswith("_")
    public = named.where(~private)
    hidden = named.where(private).join(public.select("module_id").distinct(), "module_id", "left_anti")
    return facts.top_per_group(public.unionByName(hidden), ["module_id"], [F.col("symbol")], limit)


def request_flow(module_table: DataFrame, shown: int = 6) -> DataFrame:
    """Steps of a request; no rows at all when no module is a route or controller."""
    role = F.col("role")
    step = (
        F.when(role == "service", F.lit("2 service")).when(role == "repository", F.lit("3 repository")).otherwise("1 api")
    )
    rows = module_table.where(role.isin("route", "controller", "service", "repository")).withColumn("step", step)
    sizes = rows.groupBy("step").agg(F.count(F.lit(1)).alias("modules"))
    listed = (
        facts.top_per_group(rows, ["step"], [F.col("name"), F.col("module_id")], shown)
        .groupBy("step")
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("details"))
    )
    more = F.when(F.col("modules") > shown, F.concat(F.lit(", and "), F.col("modules") - shown, F.lit(" more"))).otherwise("")
    steps = sizes.join(listed, "step").select("step", "modules", F.concat("details", more).alias("details"))
    entries = module_table.where(role.isin("route", "controller")).select(F.count(F.lit(1)).alias("n")).scalar()
    client = module_table.sparkSession.range(1).select(
        F.lit("0 client").alias("step"), F.lit(0).cast("long").alias("modules"), F.lit("").alias("details")
    )
    return steps.unionByName(client).where(entries > 0)


def cross_layer_counts(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Relationships between different layers, counted per pair of layers."""
    source = layers.select(F.col("key").alias("subject_key"), F.col("layer").alias("source_layer"))
    target = layers.select(F.col("key").alias("object_key"), F.col("layer").alias("target_layer"))
    joined = edges.select("subject_key", "object_key").join(source, "subject_key").join(target, "object_key")
    return joined.where("source_layer <> target_layer").groupBy("source_layer", "target_layer").agg(F.count(F.lit(1)).alias("n"))


def layer_table(nodes: DataFrame) -> DataFrame:
    """Node count per layer in display order."""
    return (
        nodes.groupBy("layer")
        .agg(F.count(F.lit(1)).alias("nodes"))
        .withColumn("position", roles.layer_order("layer"))
        .withColumn("name", F.initcap(F.translate("layer", "-", " ")))
    )


def stack_summary(languages: DataFrame, frameworks: DataFrame, entry_points: DataFrame) -> DataFrame:
    """One row: most frequent language, known frameworks joined by comma, first entry point."""
    known = list(roles.CLIENT_FRAMEWORKS + roles.SERVER_FRAMEWORKS)
    main = summaries.dominant(languages.withColumn("_all", F.lit(1)), ["_all"], "language", "path")
    # at most as many names as there are known frameworks
    listed = (
        frameworks.where(F.col("framework").isin(*known))
        .select("framework")
        .distinct()
        .agg(F.array_join(F.array_sort(F.collect_list("framework")), ", ").alias("frameworks"))
    )
    first = entry_points.agg(F.min("path").alias("entry_point"))
    return main.select(F.coalesce("language", F.lit("Unknown")).alias("language")).withColumns(
        {"framework": listed.scalar(), "entry_point": first.scalar()}
    )

