"""Repository paths, stable keys and URL parts as Column expressions.

Inputs are expected in Unicode NFC form: ``text.with_nfc`` brings columns there
once, at ingest, so that no key function needs Python.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def normalize_path(path) -> Column:
    """Repository-relative form of a path, or null when it is absolute or leaves the root."""
    text = _col(path)
    slashed = F.translate(text, "\\", "/")
    segments = F.filter(F.split(slashed, "/"), lambda s: ~s.isin("", "."))
    # The accumulator turns null at the first ".." with nothing to pop and stays null.
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)),
    )
    rejected = text.rlike(r"^\p{L}:") | slashed.startswith("/")
    return F.when(~rejected, F.array_join(folded, "/"))


def is_valid_path(path) -> Column:
    return normalize_path(path).isNotNull()


def directory(path) -> Column:
    """Parent directory, empty for a top-level name."""
    path = _col(path)
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def ancestors(path, include_root: bool = True) -> Column:
    """All directories above a path; the root is the empty string."""
    parts = F.split(_col(path), "/")
    # sequence() would count downwards for a path without a directory, so that case is separate
    nested = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    above = F.when(F.size(parts) > 1, nested).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), above) if include_root else above


def extension(path) -> Column:
    """Lower-case suffix without the dot; null for none and for dot files."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"[^.].*\.([^.]+)$", 1)), F.lit(""))


TOKEN = "^[a-z][a-z0-9_]*$"


def is_token(value) -> Column:
    return F.coalesce(_col(value).rlike(TOKEN), F.lit(False))


def normalize_stable_key(kind, key) -> Column:
    """Normalized stable key of a node kind, or null when the key breaks the kind's form."""
    kind, key = _col(kind), _col(key)
    split = F.instr(key, "::")
    head = F.substring_index(key, "::", 1)
    tail = key.substr(split + 2, F.length(key))
    symbol_path = normalize_path(head)
    file_path = normalize_path(key.substr(F.lit(6), F.length(key)))
    module_path = normalize_path(key.substr(F.lit(5), F.length(key)))
    resource = key.substr(F.lit(5), F.length(key))
    resource_at = F.instr(resource, "::")
    resource_path = normalize_path(F.substring_index(resource, "::", 1))
    resource_name = resource.substr(resource_at + 2, F.length(resource))
    value = (
        F.when(kind == "repository", F.when(key == "repo:root", key))
        .when(kind == "module", F.when(key.startswith("mod:"), F.concat(F.lit("mod:"), module_path)))
        .when(kind == "file", F.when(key.startswith("file:") & (file_path != ""), F.concat(F.lit("file:"), file_path)))
        .when(
            kind == "symbol",
            F.when((split > 0) & (symbol_path != "") & (tail != ""), F.concat(symbol_path, F.lit("::"), tail)),
        )
        .when(kind == "dependency", F.when(key.rlike("^dep:[^:]*:"), key))
        .when(kind == "service", F.when(key.rlike("^svc:.*://"), key))
        .when(
            kind == "iac_resource",
            F.when(
                key.startswith("iac:") & (resource_at > 0) & (resource_path != "") & resource_name.contains("/"),
                F.concat(F.lit("iac:"), resource_path, F.lit("::"), resource_name),
            ),
        )
        .otherwise(key)
    )
    return F.when(kind.rlike(TOKEN) & (key != "") & ~key.rlike(r"[\x00-\x1f]"), value)


def fold_pypi(name) -> Column:
    return F.lower(F.regexp_replace(_col(name), "[-_.]+", "-"))


def dependency_key(ecosystem, name) -> Column:
    ecosystem, name = _col(ecosystem), _col(name)
    folded = F.when(ecosystem == "pypi", fold_pypi(name)).otherwise(name)
    return F.concat(F.lit("dep:"), ecosystem, F.lit(":"), folded)


def service_key(origin) -> Column:
    return F.concat(F.lit("svc:"), _col(origin))


def resource_key(manifest_path, resource_type, name) -> Column:
    return F.concat(
        F.lit("iac:"), normalize_path(manifest_path), F.lit("::"), _col(resource_type), F.lit("/"), _col(name)
    )


def symbol_key(path, qualified_name) -> Column:
    return F.concat(normalize_path(path), F.lit("::"), _col(qualified_name))


def module_key(path) -> Column:
    return F.concat(F.lit("mod:"), directory(normalize_path(path)))


def module_name(path) -> Column:
    return F.nullif(basename(directory(normalize_path(path))), F.lit(""))


def package_root(specifier, source_path) -> Column:
    """Package a module specifier belongs to: dotted for Python, slashed (and scoped) otherwise."""
    specifier = _col(specifier)
    return (
        F.when(_col(source_path).endswith(".py"), F.substring_index(specifier, ".", 1))
        .when(specifier.startswith("@"), F.substring_index(specifier, "/", 2))
        .otherwise(F.substring_index(specifier, "/", 1))
    )


def path_of_key(kind, key) -> Column:
    """Path named by a file, symbol or module key."""
    kind, key = _col(kind), _col(key)
    raw = (
        F.when((kind == "file") & key.startswith("file:"), F.regexp_replace(key, "^file:", ""))
        .when((kind == "symbol") & key.contains("::"), F.substring_index(key, "::", 1))
        .when((kind == "module") & key.startswith("mod:"), F.regexp_replace(key, "^mod:", ""))
    )
    return F.regexp_replace(F.translate(raw, "\\", "/"), "^/+", "")


def http_method(raw) -> Column:
    """Upper-case method made of ASCII letters only, else null."""
    token = F.upper(F.trim(_col(raw)))
    return F.when(token.rlike("^[A-Z]+$"), token)


_URL = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:@\[\]]+)(?::([0-9]*))?(/[^?#]*)?(?:[?#].*)?$"


def url_origin(url) -> Column:
    """``scheme://host[:port]`` without a default port; null when it is no absolute http(s) URL."""
    url = F.trim(_col(url))
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.rtrim(F.lower(F.regexp_extract(url, _URL, 2)), F.lit("."))
    port = F.regexp_extract(url, _URL, 3)
    number = port.try_cast("int")
    default = F.when(scheme == "http", 80).otherwise(443)
    named = F.when(number.isNull() | (number == default), F.lit("")).otherwise(F.concat(F.lit(":"), number))
    usable = (scheme != "") & (host != "") & ((port == "") | (number <= 65535))
    return F.when(usable, F.concat(scheme, F.lit("://"), host, named))


def url_path(url) -> Column:
    """Path of an absolute http(s) URL, ``/`` when empty."""
    path = F.regexp_extract(F.trim(_col(url)), _URL, 4)
    return F.when(url_origin(url).isNotNull(), F.when(path == "", "/").otherwise(path))


def referent(method, url) -> Column:
    """``METHOD|origin|path`` of an HTTP call, null when any part is not proven."""
    # concat, unlike concat_ws, is null as soon as one part is
    return F.concat(http_method(method), F.lit("|"), url_origin(url), F.lit("|"), url_path(url))


def parse_referent(text) -> Column:
    """(method, origin, path) struct; null unless there are exactly three non-empty parts."""
    parts = F.split(_col(text), r"\|")
    good = (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "")
    return F.when(good, F.struct(parts[0].alias("method"), parts[1].alias("origin"), parts[2].alias("path")))


def source_key(url) -> Column:
    """``host/owner/name`` of a repository address, lower-cased."""
    return F.lower(F.regexp_replace(_col(url), "^https?://", ""))


def archive_name(filename) -> Column:
    """Archive name without its suffix; any other name loses its last extension."""
    name = _col(filename)
    suffix = r"(?i)(\.tar\.gz|\.tgz|\.zip|\.tar|\.gz)$"
    stem = F.regexp_replace(basename(name), r"(?<=[^/])\.[^.]+$", "")
    return F.when(name.rlike(suffix), F.regexp_replace(name, suffix, "")).otherwise(stem)


def request_class(method, path) -> Column:
    """Budget class of a request: the first rule that matches, null for exempt ones."""
    method, path = _col(method), _col(path)
    exempt = (
        (method == "OPTIONS") | path.isin("/health", "/ready", "/metrics") | path.rlike(r"^(/docs|/redoc|/openapi\.json)")
    )
    heavy = path.isin("/repositories/upload", "/repositories/github", "/documentation/generate", "/export") | (
        path.startswith("/analysis/") & path.endswith("/start")
    )
    return (
        F.when(exempt, F.lit(None).cast("string"))
        .when((method == "POST") & path.isin("/auth/login", "/auth/register", "/waitlist"), "auth")
        .when((path == "/ai") | path.startswith("/ai/"), "ai")
        .when((method == "POST") & heavy, "heavy")
        .otherwise("default")
    )
