"""Reading source trees: file inventory, triage, lines, previews and manifests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.functions.text import LINE_BREAK
from lodegraph.sources.tree import IGNORED_FOLDERS, SourceTree

def is_source_path(path) -> Column:
    """No ignored folder on the way, no Finder artefact as the name."""
    path = path if isinstance(path, Column) else F.col(path)
    segments = F.split(path, "/")
    ignored = F.arrays_overlap(segments, F.array(*[F.lit(n) for n in IGNORED_FOLDERS]))
    artefact = F.exists(segments, lambda s: (s == ".DS_Store") | s.startswith("._"))
    return ~(ignored | artefact)


def tree_entries(spark: SparkSession, root: str, content: bool = True, levels: int = 2) -> DataFrame:
    """(path, kind, size, content) of files, folders and links below ``root``, without what is ignored.

    Folders are listed and files are read in the tasks; see ``sources.tree``.  ``content`` is null for folders and
    links, and for all where only names are wanted.  Links are not followed.  ``root`` is a path or URI of a mounted
    file system, an object store or HDFS.
    """
    spark.dataSource.register(SourceTree)
    options = {"slices": 2 * spark.sparkContext.defaultParallelism, "levels": levels, "content": content}
    return spark.read.format("source_tree").options(**options).load(root)


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of the source files below ``root``, empty and hidden ones too."""
    return tree_entries(spark, root).where("kind = 'file'").select("path", "size", "content")


def distinct_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Normalized, distinct paths in order; paths that leave the root are dropped."""
    cleaned = paths.normalize_path(F.ltrim(F.col(path), F.lit("/")))
    return files.select(cleaned.alias("path")).where("path IS NOT NULL AND path <> ''").distinct().orderBy("path")


def triage(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Diagnostic code of each file (null when it is usable text), first rule first.

    Path escape, then size where a ``limit`` in bytes is given, then NUL bytes, then invalid UTF-8.
    """
    content = F.col("content")
    code = (
        F.when(~paths.is_valid_path("path"), "RI-SEC-PATH-ESCAPE")
        .when(F.lit(False) if limit is None else F.length(content) > limit, "RI-LIMIT-SKIP")
        .when(_has_nul(content), "RI-SRC-BINARY")
        .when(~F.is_valid_utf8(content.cast("string")), "RI-SRC-MALFORMED")
    )
    return files.withColumn("code", code)


def _has_nul(content: Column) -> Column:
    # bytes keep their value when read as Latin-1, so a NUL byte is the NUL character
    return F.decode(content, "ISO-8859-1").contains("\x00")


def lines(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_number, line): one row per LF-separated line, numbered from 1."""
    return documents.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_p", "line")).select(
        key, (F.col("_p") + 1).alias("line_number"), "line"
    )


def line_counts(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    from lodegraph.functions.text import logical_line_count

    return documents.select(key, logical_line_count(text).alias("line_count"))


# File extensions shown as images.
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp")


def previews(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Flags and text of each file, whole or up to ``limit`` bytes."""
    content = F.col("content")
    head = content if limit is None else F.substring(content, 1, limit)
    binary = _has_nul(head)
    return files.select(
        "path",
        F.length(content).alias("size"),
        (F.length(head) < F.length(content)).alias("truncated"),
        binary.alias("is_binary"),
        F.coalesce(paths.extension("path").isin(*IMAGES), F.lit(False)).alias("is_image"),
        F.when(~binary, F.make_valid_utf8(head.cast("string"))).alias("text"),
    )


# --- manifests ---------------------------------------------------------------


def requirements(manifests: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Declarations of requirements files: (key, line_number, name, version).

    Comments and option lines are skipped; ``#`` only starts a comment after whitespace.
    """
    numbered = manifests.select(key, F.posexplode(F.split(F.col(text), LINE_BREAK, -1)).alias("_p", "_raw"))
    blank = F.lit(" \t\n\x0b\x0c\r")
    stripped = numbered.withColumn("_v", F.btrim("_raw", blank))
    kept = stripped.where((F.col("_v") != "") & ~F.substring("_v", 1, 1).isin("#", "-", "."))
    bare = F.when(F.col("_v").contains("#"), F.rtrim(F.regexp_replace("_v", r"\s+#.*$", ""), blank)).otherwise(F.col("_v"))
    value = kept.withColumn("_v", bare)
    name = F.regexp_extract("_v", r"^[^\[<>=!~@\s]*", 0)
    named = value.select(key, "_p", "_v", name.alias("name")).where("name <> ''")
    rest = F.btrim(F.col("_v").substr(F.length("name") + 1, F.length("_v")), blank)
    return named.select(
        key, (F.col("_p") + 1).alias("line_number"), "name", F.nullif(rest, F.lit("")).alias("version")
    )


# Manifest sections and the dependency type each declares.
NPM_SECTIONS = (
    ("dependencies", "production"),
    ("devDependencies", "development"),
    ("peerDependencies", "peer"),
    ("optionalDependencies", "optional"),
)


def npm_declarations(manifests: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(declarations, malformed) of package.json texts.

    One wrong section or a version that is no string makes the whole manifest malformed.
    """
    parsed = manifests.select(key, F.try_parse_json(text).alias("_v"))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    sections = F.array(
        *[
            F.struct(
                F.lit(name).alias("section"),
                F.lit(kind).alias("dependency_type"),
                F.try_variant_get("_v", f"$.{name}", "variant").alias("value"),
            )
            for name, kind in NPM_SECTIONS
        ]
    )
    rooted = parsed.withColumn("_object", F.coalesce(is_object, F.lit(False)))
    each = rooted.where("_object").select(key, F.inline(sections)).where("value IS NOT NULL")
    typed = each.withColumn("_object", F.schema_of_variant("value").startswith("OBJECT"))
    entries = typed.where("_object").lateralJoin(
        typed.sparkSession.tvf.variant_explode(F.col("value").outer()).select(
            F.col("key").alias("name"), F.col("value").alias("_entry")
        )
    )
    entries = entries.withColumn("_string", F.schema_of_variant("_entry") == "STRING")
    bad = (
        rooted.where("NOT _object")
        .select(key)
        .unionByName(typed.where("NOT _object").select(key))
        .unionByName(entries.where("NOT _string").select(key))
        .distinct()
    )
    good = entries.select(key, "dependency_type", "name", F.try_variant_get("_entry", "$", "string").alias("version"))
    return good.join(bad, key, "left_anti"), bad.withColumn("code", F.lit("RI-SRC-MALFORMED"))


LOCKFILE = (
    "packages map<string, struct<version:string, link:boolean, optional:boolean, dev:boolean, devOptional:boolean>>"
)
LOCK_VERSIONS = (2, 3)


def npm_resolutions(lockfiles: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(resolutions, diagnostics) of package-lock.json texts of the supported versions."""
    number = F.try_variant_get(F.try_parse_json(text), "$.lockfileVersion", "variant")
    whole = F.schema_of_variant(number) == "BIGINT"
    read = lockfiles.select(
        key,
        F.when(whole, F.try_variant_get(number, "$", "int")).alias("_version"),
        F.from_json(text, LOCKFILE)["packages"].alias("_packages"),
    )
    code = F.when(F.col("_version").isNull() | F.col("_packages").isNull(), "RI-SRC-MALFORMED").when(
        ~F.col("_version").isin(*LOCK_VERSIONS), "RI-EXT-UNSUPPORTED"
    )
    judged = read.withColumn("code", code)
    entry = judged.where("code IS NULL").select(key, F.explode("_packages").alias("entry", "_r"))
    # optional is the stronger caveat and wins over dev
    scope = (
        F.when(F.col("_r.optional"), "optional")
        .when(F.col("_r.dev") | F.coalesce("_r.devOptional", F.lit(False)), "development")
        .when(F.col("_r.devOptional"), "development")
        .otherwise("production")
    )
    name = F.substring_index("entry", "node_modules/", -1)
    pinned = F.col("entry").contains("node_modules/") & ~F.coalesce("_r.link", F.lit(False))
    resolutions = (
        entry.where(pinned)
        .select(key, "entry", name.alias("name"), F.col("_r.version").alias("version"), scope.alias("scope"))
        .where("name <> '' AND version <> ''")
    )
    return resolutions, judged.where("code IS NOT NULL").select(key, "code")


# --- extractor registry ------------------------------------------------------


def extractor_conflicts(files: DataFrame, extractors: dict[str, Column]) -> DataFrame:
    """Paths that more than one extractor claims; each extractor is a predicate over ``path``."""
    claims = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in extractors.items()]))
    return files.select("path", claims.alias("claims")).where(F.size("claims") > 1).select(
        "path", F.array_join("claims", ",").alias("claims")
    )
