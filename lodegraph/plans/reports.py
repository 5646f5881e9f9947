"""Report bodies: documentation sections, context pack and product projection."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import roles
from lodegraph.operators import facts, summaries
from lodegraph.operators.resolve import union_all

# Rows shown per documentation section.
SECTION_LIMITS = {"folder-structure": 80, "api": 30, "environment": 30, "deployment": 30, "contribution": 50}


def documentation(files: DataFrame, routes: DataFrame, route_evidence: DataFrame, declarations: DataFrame) -> DataFrame:
    """(section, position, line) of the bulleted documentation sections.

    ``files``: path, role.  ``routes``: route.  ``route_evidence``: route, path, role.
    ``declarations``: name, version, manifest_path.
    """
    real = facts.drop_test_only(routes, route_evidence, "route")
    shown_paths = route_evidence.join(real, "route", "left_semi").select("path")
    api_files = files.where(F.col("role").isin("route", "controller")).select("path").union(shown_paths).distinct()

    def bullets(section: str, kind: int, df: DataFrame, line) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.lit(kind).alias("kind"), line.alias("line"))

    declared = F.concat(
        F.col("name"), F.lit(": "), F.coalesce("version", F.lit("no version/specifier declared")), F.lit(" ("),
        F.coalesce("manifest_path", F.lit("manifest path unavailable")), F.lit(")"),
    )
    path = F.col("path")
    parts = [
        bullets("folder-structure", 1, files, path),
        bullets("api", 1, api_files, F.concat(F.lit("File: "), path)),
        bullets("api", 2, real, F.concat(F.lit("Observed route: "), "route")),
        bullets("environment", 1, files.where(roles.is_environment_path("path")), path),
        bullets("deployment", 1, files.where(roles.is_deployment_path("path")), path),
        bullets("contribution", 1, declarations.distinct(), declared),
    ]
    ranked = facts.top_per_group(union_all(parts), ["section", "kind"], [F.col("line")], max(SECTION_LIMITS.values()))
    limit = F.lit(0)
    for name, value in SECTION_LIMITS.items():
        limit = F.when(F.col("section") == name, value).otherwise(limit)
    return ranked.where(F.col("position") <= limit)


# Rows of each kind in a context pack.
CONTEXT_LIMITS = {"file": 40, "module": 10, "dependency": 20}


def context_pack(files: DataFrame, modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(kind, position, name): the first files, modules and dependencies by name.

    Each input has one column ``name``; the limits are the feature's own.
    """
    tagged = [
        df.select(F.lit(kind).alias("kind"), "name").distinct()
        for kind, df in (("file", files), ("module", modules), ("dependency", dependencies))
    ]
    ranked = facts.top_per_group(union_all(tagged), ["kind"], [F.col("name")], max(CONTEXT_LIMITS.values()))
    limit = F.lit(0)
    for name, value in CONTEXT_LIMITS.items():
        limit = F.when(F.col("kind") == name, value).otherwise(limit)
    return ranked.where(F.col("position") <= limit)


def version_conflicts(declarations: DataFrame) -> DataFrame:
    """(dep_key, version, conflict): the one declared version, or a conflict flag without it."""
    lo, hi = F.min(F.struct("version")), F.max(F.struct("version"))
    return declarations.groupBy("dep_key").agg(
        F.when(lo == hi, lo["version"]).alias("version"), (lo != hi).alias("conflict")
    )


def detect_stack(files: DataFrame) -> DataFrame:
    """(repository, package_manager, entry_point) by the first present file of each priority list.

    ``files``: repository, path.  The priority tables are constants of a few rows.
    """
    path = F.col("path")

    def priority(values) -> object:
        return F.array_position(F.array(*[F.lit(v) for v in values]), path)

    managers = [name for name, _ in roles.PACKAGE_MANAGERS]
    labels = F.create_map(*[F.lit(x) for pair in roles.PACKAGE_MANAGERS for x in pair])
    m, e = priority(managers), priority(roles.ENTRY_POINTS)
    best = files.groupBy("repository").agg(
        F.min_by(F.element_at(labels, path), F.when(m > 0, m)).alias("package_manager"),
        F.min_by(F.concat(F.lit("/"), path), F.when(e > 0, e)).alias("entry_point"),
    )
    return best


def detect_framework(manifests: DataFrame) -> DataFrame:
    """(repository, framework): npm dependencies first, then names in Python manifests.

    ``manifests``: repository, kind (npm or python), text.
    """
    lowered = F.lower("text")
    keys = F.concat(
        F.coalesce(F.json_object_keys(F.get_json_object("text", "$.dependencies")), F.array().cast("array<string>")),
        F.coalesce(F.json_object_keys(F.get_json_object("text", "$.devDependencies")), F.array().cast("array<string>")),
    )
    rank = F.lit(None).cast("int")
    names = [label for _, label in roles.NPM_FRAMEWORKS + roles.PYTHON_FRAMEWORKS]
    tests = [(F.col("kind") == "npm") & F.array_contains(keys, name) for name, _ in roles.NPM_FRAMEWORKS]
    tests += [(F.col("kind") == "python") & lowered.contains(name) for name, _ in roles.PYTHON_FRAMEWORKS]
    for position, test in reversed(list(enumerate(tests, start=1))):
        rank = F.when(test, position).otherwise(rank)
    best = manifests.groupBy("repository").agg(F.min(rank).alias("_r"))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("_r") - 1)
    return best.select("repository", F.coalesce(label, F.lit("Unknown")).alias("framework"))


def product_modules(files: DataFrame) -> DataFrame:
    """(module, role, layer, files): coarse grouping of files for the product projection."""
    role = F.col("role")
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    rooted = first.isin("app", "src", "backend", "frontend", "apps") & (F.size(parts) > 1)
    key = (
        F.when(role.isin("controller", "route"), "api")
        .when(role.isin("service", "repository", "middleware", "configuration", "test", "documentation"), role)
        .when(role.isin("model", "dto", "interface", "enum"), "domain")
        .when(rooted, F.lower(F.get(parts, F.lit(1))))
        .when(F.size(parts) > 0, F.lower(first))
        .otherwise("repository")
    )
    keyed = files.withColumn("module", key)
    telling = keyed.where(role.isNotNull() & ~role.isin("unknown", "documentation", "test"))
    main = summaries.dominant(telling, ["module"], "role", "path")
    totals = keyed.groupBy("module").agg(
        F.count(F.lit(1)).alias("files"), F.min(F.struct("path", "role"))["role"].alias("_first")
    )
    joined = totals.join(main, "module", "left").withColumn("role", F.coalesce("role", "_first", F.lit("unknown")))
    return joined.select("module", "role", roles.layer("role").alias("layer"), "files")


def outcome_card(findings: DataFrame, dependencies: DataFrame, modules: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row of headline numbers over the read models."""

    def total(df: DataFrame):
        return df.select(F.count(F.lit(1)).alias("n")).scalar()

    worst = summaries.counts(findings, "category").orderBy(F.desc("n"), "category").limit(1)
    return repositories.agg(
        F.count(F.lit(1)).alias("repositories"), F.count_if(F.col("state") == "completed").alias("completed")
    ).withColumns(
        {
            "findings": total(findings),
            "dependencies": total(dependencies),
            "modules": total(modules),
            "headline": worst.select("category").scalar(),
        }
    )
