"""Resolving observations to entities under the exactly-one rule.

Candidates are first summarized per join key as their smallest and greatest
target (``lo``, ``hi``).  That is all a verdict needs: none is unresolved, equal
ends are the one target, different ends are ambiguous.  Observations then meet
one row per key, so a key shared by many observations and many candidates never
multiplies.  The candidates of ambiguous keys are listed once per key.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import paths

UNRESOLVED = "RI-RES-UNRESOLVED"
AMBIGUOUS = "RI-RES-AMBIGUOUS"
SHADOWED = "calls target is shadowed by a local binding"

EVIDENCE_ORDER = ("path", "start_line", "end_line", "granularity", "extractor", "extractor_version")


def summarize(candidates: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """One row per key with the smallest and greatest candidate."""
    return candidates.groupBy(*keys).agg(F.min(target).alias("lo"), F.max(target).alias("hi"))


def verdict(lo: Column, hi: Column) -> list[Column]:
    """Columns ``code`` (null when resolved) and ``target``."""
    code = F.when(lo.isNull(), UNRESOLVED).when(lo != hi, AMBIGUOUS)
    return [code.alias("code"), F.when(lo == hi, lo).alias("target")]


def resolve_unique(observations: DataFrame, candidates: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """Add ``code`` and ``target`` to observations that share ``keys`` with the candidates."""
    joined = observations.join(summarize(candidates, keys, target), keys, "left")
    return joined.select(*observations.columns, *verdict(F.col("lo"), F.col("hi")))


def ambiguous_candidates(
    observations: DataFrame, candidates: DataFrame, keys: list[str], target: str = "target"
) -> DataFrame:
    """Distinct candidates of every ambiguous key that was observed."""
    several = summarize(candidates, keys, target).where("lo <> hi").select(*keys)
    wanted = several.join(observations.select(*keys).distinct(), keys, "left_semi")
    return candidates.select(*keys, target).join(wanted, keys, "left_semi").distinct()


def resolve_tiers(observations: DataFrame, tiers: list[tuple[list[str], DataFrame]]) -> DataFrame:
    """Resolve against the first tier that has any candidate.

    A tier is (key columns, candidates with those columns and ``target``).
    Adds ``tier``, ``code`` and ``target``.
    """
    joined = observations
    for number, (keys, candidates) in enumerate(tiers, start=1):
        ends = summarize(candidates, keys).withColumnsRenamed({"lo": f"_lo{number}", "hi": f"_hi{number}"})
        joined = joined.join(ends, keys, "left")
    numbers = range(1, len(tiers) + 1)
    tier = F.coalesce(*[F.when(F.col(f"_lo{n}").isNotNull(), n) for n in numbers])
    lo = F.coalesce(*[F.col(f"_lo{n}") for n in numbers])
    hi = F.coalesce(*[F.when(F.col(f"_lo{n}").isNotNull(), F.col(f"_hi{n}")) for n in numbers])
    return joined.select(*observations.columns, tier.alias("tier"), *verdict(lo, hi))


def earliest_evidence(evidence: DataFrame, key: str, order: tuple = EVIDENCE_ORDER) -> DataFrame:
    """First evidence of each fact in canonical order."""
    return evidence.groupBy(key).agg(F.min(F.struct(*order)).alias("_e")).select(key, "_e.*")


def definition_edges(definitions: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``contains`` and ``defines`` edges from the lexical parent of each symbol key.

    Inputs have one column ``key``.  A parent that is absent gives one row with a code.
    """
    known = symbols.select("key").unionByName(files.select("key")).distinct()
    key = F.col("key")
    name = F.substring_index(key, "::", -1)
    parent = F.when(name.contains("."), F.regexp_replace(key, r"\.[^.]*$", "")).otherwise(
        F.concat(F.lit("file:"), F.substring_index(key, "::", 1))
    )
    rows = definitions.select("key", parent.alias("parent"))
    found = rows.join(known.select(F.col("key").alias("_known")), F.col("parent") == F.col("_known"), "left")
    predicate = F.when(F.col("_known").isNotNull(), F.array(F.lit("contains"), F.lit("defines"))).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    return found.select(
        F.when(F.col("_known").isNotNull(), F.col("parent")).alias("subject_key"),
        F.explode(predicate).alias("predicate"),
        F.col("key").alias("object_key"),
        F.when(F.col("_known").isNull(), UNRESOLVED).alias("code"),
    )


# --- imports -----------------------------------------------------------------

# Forms in which a module root may be stored.
MODULE_FORMS = (".ts", ".tsx", ".py", "/index.ts", "/index.tsx", "/__init__.py")


def relative_candidates(specifier, source_path) -> Column:
    """Array of file paths a relative specifier may name; no form is preferred."""
    specifier, source_path = F.col(specifier), F.col(source_path)
    rest = F.ltrim(specifier, F.lit("."))
    dots = F.length(specifier) - F.length(rest)
    folder = paths.directory(source_path)

    # "./x" and "../x": join and normalize.  Climbing past the root keeps its "..", which names no file.
    joined = paths.normalize_path(F.concat_ws("/", F.nullif(folder, F.lit("")), specifier))
    slashed = F.when(joined.isNotNull(), F.array(joined)).otherwise(F.array().cast("array<string>"))

    # ".pkg.name": one dot stays in the folder, each further dot goes one level up.
    above = F.filter(F.split(folder, "/"), lambda p: p != "")
    kept = F.slice(above, F.lit(1), F.greatest(F.size(above) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    parts = F.filter(F.split(rest, r"\."), lambda p: p != "")
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
            lambda n: F.array_join(F.concat(kept, F.slice(parts, F.lit(1), n)), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))

    roots = F.when(rest.startswith("/"), slashed).otherwise(prefixes)
    forms = F.transform(
        roots,
        lambda root: F.when(root.rlike(r"\.(ts|tsx|py)$"), F.array(root)).otherwise(
            F.array(*[F.concat(root, F.lit(form)) for form in MODULE_FORMS])
        ),
    )
    return F.array_distinct(F.flatten(forms))


def source_roots(files: DataFrame) -> DataFrame:
    """Folders that hold a top-level package, and the repository root (column ``root``)."""
    packages = files.where(paths.basename("path") == "__init__.py").select(paths.directory("path").alias("folder")).distinct()
    parents = packages.select(paths.directory("folder").alias("root")).distinct()
    outer = parents.join(packages, parents["root"] == packages["folder"], "left_anti")
    root = files.sparkSession.range(1).select(F.lit("").alias("root"))
    return outer.unionByName(root).distinct()


def module_files(files: DataFrame) -> DataFrame:
    """(module, target): every dotted-import path under which a Python file is visible.

    A file is seen from each of its ancestor folders that is a source root, so
    roots meet files by an equality on the folder.
    """
    python = files.where(F.col("path").endswith(".py")).select("path")
    seen = python.select("path", F.explode(paths.ancestors("path")).alias("root"))
    visible = seen.join(source_roots(files), "root", "left_semi")
    inside = F.when(F.col("root") == "", F.col("path")).otherwise(
        F.col("path").substr(F.length("root") + 2, F.length("path"))
    )
    module = F.regexp_replace(F.regexp_replace(inside, r"\.py$", ""), "/__init__$", "")
    # "a/__init__.py" is module a, and "a/__init__" would also name it
    both = F.when(
        inside.endswith("/__init__.py"), F.array(module, F.regexp_replace(inside, r"\.py$", ""))
    ).otherwise(F.array(module))
    return visible.select(F.explode(both).alias("module"), F.col("path").alias("target")).distinct()


PYTHON_MODULE = "^[A-Za-z_][A-Za-z0-9_.]*$"


def import_group(specifier, source_path) -> Column:
    """Name of the candidate set an import uses; null when only a package can match."""
    specifier, source_path = F.col(specifier), F.col(source_path)
    absolute = source_path.endswith(".py") & specifier.rlike(PYTHON_MODULE)
    return F.when(
        specifier.startswith("."), F.concat_ws("|", F.lit("rel"), paths.directory(source_path), specifier)
    ).when(absolute, F.concat(F.lit("abs|"), F.translate(specifier, ".", "/")))


def group_candidates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(group, target) for the groups of ``imports`` (source_path, specifier, group)."""
    relative = (
        imports.where(F.col("group").startswith("rel|"))
        .groupBy("group")
        .agg(F.min(F.struct("source_path", "specifier")).alias("_one"))
        .select("group", "_one.*")
        .select("group", F.explode(relative_candidates("specifier", "source_path")).alias("path"))
    )
    by_path = relative.join(files.select("path"), "path").select("group", F.col("path").alias("target"))
    absolute = imports.where(F.col("group").startswith("abs|")).select("group").distinct()
    by_module = absolute.withColumn("module", F.regexp_replace("group", r"^abs\|", "")).join(
        module_files(files), "module"
    )
    return by_path.unionByName(by_module.select("group", "target"))


def resolve_imports(
    imports: DataFrame, files: DataFrame, declared: DataFrame, bindings: DataFrame | None = None
) -> DataFrame:
    """Resolve (source_path, specifier) to a file, else to a declared package.

    ``declared`` has ``dep_key``.  ``bindings`` (source_path, specifier, imported) lets
    ``a.b.c`` also mean member ``c`` of module ``a.b``.  Adds tier, code and target.
    """
    rows = imports.select("source_path", "specifier").distinct()
    rows = rows.withColumn("group", import_group("specifier", "source_path"))
    if bindings is None:
        rows = rows.withColumn("_split", F.lit(None).cast("string"))
    else:
        split = bindings.where(F.col("source_path").endswith(".py")).select(
            "source_path",
            F.concat_ws(".", "specifier", "imported").alias("specifier"),
            import_group("specifier", "source_path").alias("_split"),
        )
        # a dotted path splits once per binding; distinct modules of one path are summarized below
        rows = rows.join(split.where(F.col("_split").startswith("abs|")).distinct(), ["source_path", "specifier"], "left")
    named = rows.select("source_path", "specifier", "group").unionByName(
        rows.where("_split IS NOT NULL").select("source_path", "specifier", F.col("_split").alias("group"))
    )
    ends = summarize(group_candidates(named.where("group IS NOT NULL"), files), ["group"])
    hits = rows.join(ends, "group", "left").join(
        ends.select(F.col("group").alias("_split"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "_split", "left"
    )
    local = hits.groupBy("source_path", "specifier").agg(
        F.min(F.least("lo", "_lo")).alias("_file_lo"), F.max(F.greatest("hi", "_hi")).alias("_file_hi")
    )
    root = paths.package_root("specifier", "source_path")
    keyed = local.withColumn("_npm", F.concat(F.lit("dep:npm:"), root)).withColumn(
        "_pypi", F.concat(F.lit("dep:pypi:"), paths.fold_pypi(root))
    )
    keys = declared.select("dep_key").distinct()
    tagged = keyed.join(keys.select(F.col("dep_key").alias("_has_npm")), F.col("_npm") == F.col("_has_npm"), "left").join(
        keys.select(F.col("dep_key").alias("_has_pypi")), F.col("_pypi") == F.col("_has_pypi"), "left"
    )
    is_file = F.col("_file_lo").isNotNull()
    package_lo, package_hi = F.least("_has_npm", "_has_pypi"), F.greatest("_has_npm", "_has_pypi")
    lo = F.when(is_file, F.concat(F.lit("file:"), "_file_lo")).otherwise(package_lo)
    hi = F.when(is_file, F.concat(F.lit("file:"), "_file_hi")).otherwise(package_hi)
    tier = F.when(is_file, 1).when(package_lo.isNotNull(), 2)
    return tagged.select("source_path", "specifier", tier.alias("tier"), *verdict(lo, hi))


# --- references --------------------------------------------------------------


def reference_candidates(symbols: DataFrame, bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of bound names: (source_path, referent, target).

    ``symbols``: key, path, name, default_export.  ``bindings``: source_path,
    specifier, imported, local.  Work is shared by all bindings that import the
    same name from the same candidate set.  A binding whose own file is not stored
    has no targets.
    """
    present = files.select(F.col("path").alias("source_path")).distinct()
    named = bindings.join(present, "source_path", "left_semi").withColumn("group", import_group("specifier", "source_path")).where("group IS NOT NULL")
    located = group_candidates(named.select("source_path", "specifier", "group"), files).distinct()
    wanted = named.select("group", "imported").distinct().join(located.withColumnRenamed("target", "path"), "group")
    by_default = wanted.where("imported = 'default'").join(symbols.where("default_export"), "path")
    others = wanted.where("imported <> 'default'")
    exact = others.withColumn("key", F.concat_ws("::", "path", "imported")).join(symbols.select("key"), "key")
    rest = others.join(exact.select("group", "imported", "path"), ["group", "imported", "path"], "left_anti")
    by_name = rest.join(symbols.select("path", F.col("name").alias("imported"), "key"), ["path", "imported"])
    columns = ["group", "imported", "key"]
    targets = by_default.select(*columns).unionByName(exact.select(*columns)).unionByName(by_name.select(*columns))
    ends = summarize(targets, ["group", "imported"], "key")
    # the two ends are enough for a verdict and stand in for all candidates
    return (
        named.join(ends, ["group", "imported"])
        .select("source_path", F.col("local").alias("referent"), F.explode(F.array("lo", "hi")).alias("target"))
        .distinct()
    )


def resolve_references(references: DataFrame, symbols: DataFrame, bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve (source_path, referent): full key, same-file definition, then import bindings."""
    keys = symbols.select(F.col("key").alias("target"))
    rows = references.withColumn("_full", F.col("referent")).withColumn(
        "_same", F.concat_ws("::", "source_path", "referent")
    )
    tiers = [
        (["_full"], keys.withColumn("_full", F.col("target"))),
        (["_same"], keys.withColumn("_same", F.col("target"))),
        (["source_path", "referent"], reference_candidates(symbols, bindings, files)),
    ]
    return resolve_tiers(rows, tiers).drop("_full", "_same")


def suppress_shadowed(calls: DataFrame, shadowed: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``message``: set for calls paired with a shadowing marker on all key columns (null-safe)."""
    marker = shadowed.select(F.struct(*keys).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = calls.withColumn("_k", F.struct(*keys)).join(marker, "_k", "left")
    return joined.withColumn("message", F.when(F.col("_hit"), SHADOWED)).drop("_k", "_hit")


def smallest_containing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Smallest span around each distinct (path, start, end); several smallest give a null name.

    Spans (path, start, end, name) are filed under blocks of the power of two
    that covers them, so each lies in at most two blocks and a point looks up one
    block per size that occurs on its path: an equi-join, however many spans or
    points one path holds.
    """
    length = F.col("end") - F.col("start")
    merged = spans.groupBy("path", "start", "end").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    sized = merged.withColumn("level", F.ceil(F.log2(length + 1)).cast("int"))
    filed = sized.select(
        "path",
        "level",
        F.explode(
            F.array_distinct(F.array(F.expr("shiftright(start, level)"), F.expr("shiftright(end, level)")))
        ).alias("block"),
        F.col("start").alias("_s"),
        F.col("end").alias("_e"),
        "n",
        "name",
    )
    places = points.select("path", "start", "end").distinct()
    probes = places.join(sized.select("path", "level").distinct(), "path").withColumn(
        "block", F.expr("shiftright(start, level)")
    )
    inside = (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end"))
    around = probes.join(filed, ["path", "level", "block"]).where(inside)
    by_length = around.groupBy("path", "start", "end", (F.col("_e") - F.col("_s")).alias("length")).agg(
        F.sum("n").alias("n"), F.min("name").alias("name")
    )
    best = by_length.groupBy("path", "start", "end").agg(F.min(F.struct("length", "n", "name")).alias("b"))
    return best.select("path", "start", "end", F.when(F.col("b.n") == 1, F.col("b.name")).alias("name"))


def route_handlers(routes: DataFrame, handlers: DataFrame, subject: str, referent: str) -> DataFrame:
    """Routes with exactly one handler reference; others get a code."""
    counted = handlers.groupBy(subject).agg(F.count("*").alias("_n"), F.min(referent).alias("_only"))
    joined = routes.select(subject).distinct().join(counted, subject, "left")
    code = F.when(F.col("_n").isNull(), UNRESOLVED).when(F.col("_n") > 1, AMBIGUOUS)
    return joined.select(subject, code.alias("code"), F.when(F.col("_n") == 1, F.col("_only")).alias("handler"))


def subject_of_reference(observed_kind, observed_key, containing_key) -> Column:
    """The observed symbol, else the smallest containing symbol, else the file or module."""
    kind, key = F.col(observed_kind), F.col(observed_key)
    return F.coalesce(
        F.when(kind == "symbol", key), F.col(containing_key), F.when(kind.isin("file", "module"), key)
    )


def provenance(resolved: DataFrame, subject: str, predicate: str, producer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, evidence, derivations) of resolved observations.

    ``resolved`` has observation_id, path, start_line, end_line, code, target and the subject column.
    """
    from lodegraph.functions.identity import edge_id

    good = resolved.where("code IS NULL").withColumn("edge_id", edge_id(F.col(subject), F.lit(predicate), F.col("target")))
    edges = good.select(
        "edge_id", F.col(subject).alias("subject_key"), F.lit(predicate).alias("predicate"), F.col("target").alias("object_key")
    ).distinct()
    evidence = good.select("edge_id", "path", "start_line", "end_line", F.lit(producer).alias("extractor")).distinct()
    derivations = good.select(
        "edge_id", F.lit("observation").alias("ref_kind"), F.col("observation_id").alias("ref_identity")
    ).distinct()
    return edges, evidence, derivations


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
