"""What an unresolved reference is: external, local, an asset, an unlinked file, or a gap."""

import builtins
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths, roles
from lodegraph.functions.text import import_binding
from lodegraph.operators.ranking import first_per_key
from lodegraph.operators.resolve import SHADOWED

REFERENCE_KINDS = ("call", "implements", "injects", "route_handler")

# Language names come from the running interpreter rather than from a list.
PYTHON_MODULES = tuple(sorted(sys.stdlib_module_names))
PYTHON_NAMES = tuple(sorted(n for n in dir(builtins) if not n.startswith("_")))

# Node.js built-in modules.
NODE_MODULES = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram",
    "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net",
    "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder",
    "test", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)

# Script globals that are called but never imported.
SCRIPT_GLOBALS = (
    "describe", "it", "test", "expect", "beforeAll", "beforeEach", "afterAll", "afterEach", "vi", "jest", "waitFor",
    "within", "fireEvent", "fetch", "structuredClone", "queueMicrotask", "requestAnimationFrame",
    "cancelAnimationFrame", "setTimeout", "clearTimeout", "setInterval", "clearInterval", "alert", "confirm",
    "prompt", "getComputedStyle", "matchMedia", "requestIdleCallback", "atob", "btoa",
)

# Distributions whose import name differs.
DISTRIBUTIONS = {
    "yaml": ("pyyaml",), "jwt": ("pyjwt",), "argon2": ("argon2-cffi",), "PIL": ("pillow",),
    "cv2": ("opencv-python", "opencv-python-headless"), "bs4": ("beautifulsoup4",), "sklearn": ("scikit-learn",),
    "dateutil": ("python-dateutil",), "dotenv": ("python-dotenv",), "jose": ("python-jose",),
    "multipart": ("python-multipart",), "magic": ("python-magic",), "git": ("gitpython",), "attr": ("attrs",),
    "psycopg2": ("psycopg2-binary",), "OpenSSL": ("pyopenssl",), "serial": ("pyserial",),
    "markdown": ("markdown",), "google.protobuf": ("protobuf",),
}


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def is_platform_name(name, source_path) -> Column:
    """A bare call into the language or its host."""
    name, path = _col(name), _col(source_path)
    script = path.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$")
    return (path.endswith(".py") & name.isin(*PYTHON_NAMES)) | (script & name.isin(*SCRIPT_GLOBALS))


def is_platform_import(specifier, source_path) -> Column:
    """An import from the standard library or of a Node built-in."""
    specifier, path = _col(specifier), _col(source_path)
    root = paths.package_root(specifier, path)
    bare = F.regexp_replace(root, "^node:", "")
    platform = F.when(path.endswith(".py"), root.isin(*PYTHON_MODULES)).otherwise(
        root.isin(*NODE_MODULES) | bare.isin(*NODE_MODULES)
    )
    return ~specifier.startswith(".") & (root != "") & platform


def dependency_keys(specifier, source_path) -> Column:
    """Array of dependency keys under which the import may be declared."""
    specifier, path = _col(specifier), _col(source_path)
    root = paths.package_root(specifier, path)
    own = F.when(path.endswith(".py"), paths.dependency_key(F.lit("pypi"), root)).otherwise(
        paths.dependency_key(F.lit("npm"), root)
    )
    aliases = F.create_map(
        *[x for name, known in DISTRIBUTIONS.items() for x in (F.lit(name), F.array(*[F.lit(f"dep:pypi:{d}") for d in known]))]
    )
    others = F.when(path.endswith(".py"), F.element_at(aliases, root))
    usable = ~specifier.startswith(".") & (root != "")
    empty = F.array().cast("array<string>")
    return F.when(usable, F.concat(F.array(own), F.coalesce(others, empty))).otherwise(empty)


def first_bindings(bindings: DataFrame) -> DataFrame:
    """(path, local, specifier): the first binding of each local name in a file.

    ``bindings``: path, referent (``specifier|imported|local``), position.
    """
    parsed = bindings.withColumn("_b", import_binding("referent")).where("_b IS NOT NULL AND path <> ''")
    flat = parsed.select("path", F.col("_b.local").alias("local"), F.col("_b.specifier").alias("specifier"), "position")
    return first_per_key(flat, ["path", "local"], [F.col("position")], ["specifier"])


def _candidate_paths(specifier: str, path: str, folders: bool) -> Column:
    """Array of repository paths the specifier could name, seen from each folder above the importer.

    With ``folders`` aliases are taken as names of folders, as they are written.
    """
    spec, source = F.col(specifier), F.col(path)
    above = F.transform(paths.ancestors(source), lambda a: F.when(a == "", a).otherwise(F.concat(a, F.lit("/"))))
    parts = F.split(spec, r"\.")
    modules = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dotted = F.flatten(
        F.transform(
            above,
            lambda a: F.flatten(
                F.transform(modules, lambda m: F.array(F.concat(a, m, F.lit(".py")), F.concat(a, m, F.lit("/__init__.py"))))
            ),
        )
    )
    aliased = spec.rlike("^[@~#]/")
    target = F.rtrim(F.substring_index(spec.substr(F.lit(3), F.length(spec)), "?", 1), F.lit("/"))
    endings = [F.lit("")] if folders else [F.lit("")] + [F.lit(e) for e in roles.SCRIPT_EXTENSIONS]
    if not folders:
        endings += [F.lit(f"/index{e}") for e in roles.SCRIPT_EXTENSIONS]
    tails = F.transform(F.array(*endings), lambda e: F.concat(target, e))
    slashed = F.flatten(
        F.transform(
            above,
            lambda a: F.flatten(F.transform(tails, lambda t: F.array(F.concat(a, F.lit("src/"), t), F.concat(a, t)))),
        )
    )
    empty = F.array().cast("array<string>")
    return (
        F.when(source.endswith(".py") & ~spec.startswith(".") & (spec != ""), dotted)
        .when(roles.is_script(source) & aliased & (target != ""), slashed)
        .otherwise(empty)
    )


def in_repository(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (specifier, path) that name a stored file, or by alias a folder with files, of an enclosing folder."""
    wanted = imports.select("specifier", "path").distinct()

    def tried(folders: bool) -> DataFrame:
        places = F.array_distinct(_candidate_paths("specifier", "path", folders))
        return wanted.select("specifier", "path", F.explode(places).alias("place"))

    stored = files.select(F.col("path").alias("place")).distinct()
    folders = files.select(F.explode(paths.ancestors("path", include_root=False)).alias("place")).distinct()
    hit = tried(False).join(stored, "place", "left_semi")
    # a folder is named as it is, without endings
    by_folder = tried(True).where(roles.is_script("path")).join(folders, "place", "left_semi")
    return hit.unionByName(by_folder).select("specifier", "path").distinct()


def classify(
    diagnostics: DataFrame, observations: DataFrame, bindings: DataFrame, declared: DataFrame, files: DataFrame
) -> DataFrame:
    """Add ``disposition`` to unresolved diagnostics (path, observation_id, message, ...).

    ``observations``: observation_id, observed_kind, referent_text.  ``declared``: dep_key.
    ``files``: path of every scanned file.
    """
    kinds = observations.select("observation_id", "observed_kind", "referent_text")
    rows = diagnostics.join(kinds, "observation_id", "left")
    bound = first_bindings(bindings).select(
        "path", F.col("local").alias("referent_text"), F.col("specifier").alias("_bound")
    )
    rows = rows.join(bound, ["path", "referent_text"], "left")
    is_reference = F.col("observed_kind").isin(*REFERENCE_KINDS)
    specifier = F.when(F.col("observed_kind") == "import", F.col("referent_text")).when(is_reference, F.col("_bound"))
    rows = rows.withColumn("specifier", specifier)
    # every question about a specifier is answered once per distinct (specifier, path)
    questions = rows.where("specifier IS NOT NULL AND path IS NOT NULL").select("specifier", "path").distinct()
    external = (
        questions.select("specifier", "path", F.explode(dependency_keys("specifier", "path")).alias("dep_key"))
        .join(declared.select("dep_key").distinct(), "dep_key", "left_semi")
        .select("specifier", "path")
        .distinct()
        .withColumn("_declared", F.lit(True))
    )
    stored = in_repository(questions, files).withColumn("_stored", F.lit(True))
    rows = rows.join(external, ["specifier", "path"], "left").join(stored, ["specifier", "path"], "left")
    spec = F.col("specifier")
    disposition = (
        F.when(F.col("path").isNull() | (F.col("path") == ""), "gap")
        .when(F.col("message") == SHADOWED, "local-binding")
        .when(F.col("referent_text").isNull() | (F.col("referent_text") == ""), "gap")
        .when(is_reference & spec.isNull(), F.when(is_platform_name("referent_text", "path"), "external").otherwise("gap"))
        .when(spec.isNull(), "gap")
        .when(is_platform_import("specifier", "path") | F.col("_declared"), "external")
        .when(roles.is_asset_import("specifier", "path"), "non-code-asset")
        .when(F.col("_stored"), "in-repo-target-exists")
        .otherwise("gap")
    )
    return rows.select(*diagnostics.columns, disposition.alias("disposition"))


def split_counts(classified: DataFrame, *keys: str) -> DataFrame:
    """Unresolved diagnostics in four buckets; an unlinked in-repository target counts as a gap."""
    # count each disposition once, then lay the few counts side by side
    sizes = classified.groupBy(*keys, "disposition").agg(F.count(F.lit(1)).alias("_n"))

    def among(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("disposition").isin(*names), F.col("_n"))), F.lit(0))

    return sizes.groupBy(*keys).agg(
        among("gap", "in-repo-target-exists").alias("in_repo_gap"),
        among("external").alias("external_reference"),
        among("local-binding").alias("local_binding"),
        among("non-code-asset").alias("non_code_asset"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
    )
