"""Ordered classification rules: the first rule that matches decides."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions import paths


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# File role rules, case-insensitive, in order.
FILE_ROLE_RULES = (
    (r"(^|/)readme", "documentation"),
    (r"(^|/)(test|spec|__tests__)", "test"),
    (r"(^|/)(main|app|index)\.(py|ts|tsx|js|jsx)$", "entrypoint"),
    (r"middleware", "middleware"),
    (r"(/controllers?/|controller)", "controller"),
    (r"(/routes?/|/api/|route)", "route"),
    (r"(/services?/|service)", "service"),
    (r"(/repositories?/|repository|repo)", "repository"),
    (r"(/models?/|/schemas?/|model)", "model"),
    (r"dto", "dto"),
    (r"interface", "interface"),
    (r"enum", "enum"),
    (r"(/config|settings)", "configuration"),
    (r"(/utils?/|/lib/|util)", "utility"),
)

# Symbol suffixes (case-sensitive) and their roles, in order.
SYMBOL_SUFFIX_ROLES = (
    ("Middleware", "middleware"),
    ("Service", "service"),
    ("Repository", "repository"),
    ("Controller", "controller"),
    ("Model", "model"),
    ("DTO", "dto"),
    ("Dto", "dto"),
)

# Fixed value: names of injected targets that guard a route.
GUARD_NAME = r"(?i)(auth|current_user|get_current_|superuser|credential|token|permission|require_user|verify|oauth)"

# Layer of a role (others: shared) and the display order of layers.
ROLE_LAYERS = {
    "presentation": ("entrypoint", "controller", "route"),
    "business-logic": ("service",),
    "domain": ("model", "dto", "interface", "enum"),
    "infrastructure": ("repository", "configuration", "test", "middleware"),
}
LAYER_ORDER = ("presentation", "business-logic", "domain", "infrastructure", "shared", "external")

# Language of a file extension.
LANGUAGES = {
    "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "go": "Go",
    "rs": "Rust", "java": "Java", "kt": "Kotlin", "swift": "Swift", "cs": "C#", "cpp": "C++", "c": "C",
    "html": "HTML", "css": "CSS", "scss": "SCSS", "json": "JSON", "yaml": "YAML", "yml": "YAML",
    "md": "Markdown", "sql": "SQL", "sh": "Shell",
}

# Configuration file names.
CONFIG_FILES = (
    "package.json", "tsconfig.json", "vite.config.ts", "next.config.js", "pyproject.toml", "requirements.txt",
    "Dockerfile", "docker-compose.yml", ".env.example", ".gitignore",
)

# Package managers, entry points and frameworks by priority.
PACKAGE_MANAGERS = (
    ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"), ("package.json", "npm"),
    ("poetry.lock", "poetry"), ("requirements.txt", "pip"), ("pyproject.toml", "pip"),
)
ENTRY_POINTS = (
    "src/main.tsx", "src/main.ts", "src/App.tsx", "src/app.py", "app/main.py", "main.py", "index.js", "package.json",
)
NPM_FRAMEWORKS = (("next", "Next.js"), ("react", "React"), ("vue", "Vue"))
PYTHON_FRAMEWORKS = (("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask"))
CLIENT_FRAMEWORKS = ("React", "Next.js", "Vue")
SERVER_FRAMEWORKS = ("FastAPI", "Django", "Flask")

# License phrases in order, looked for in a license file.
LICENSES = (("mit license", "MIT"), ("apache license", "Apache-2.0"), ("gnu general public license", "GPL"))

# File extensions of scripts and of assets a bundler imports.
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
ASSET_EXTENSIONS = (
    "css", "scss", "sass", "less", "styl", "svg", "png", "jpg", "jpeg", "gif", "webp", "avif", "ico", "bmp",
    "woff", "woff2", "ttf", "otf", "eot", "mp3", "mp4", "webm", "ogg", "wav", "md", "mdx", "txt", "csv", "yaml",
    "yml", "graphql", "gql",
)


def first_match(rules: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Value of the first condition that holds."""
    chain = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def file_role(path) -> Column:
    path = _col(path)
    return first_match([(path.rlike(f"(?i){pattern}"), F.lit(role)) for pattern, role in FILE_ROLE_RULES])


def symbol_role(name) -> Column:
    name = _col(name)
    return first_match(
        [
            (name.endswith(suffix) & (F.length(name) > len(suffix)), F.lit(role))
            for suffix, role in SYMBOL_SUFFIX_ROLES
        ]
    )


def is_guard_name(name) -> Column:
    return _col(name).rlike(GUARD_NAME)


def layer(role) -> Column:
    role = _col(role)
    return first_match([(role.isin(*roles), F.lit(name)) for name, roles in ROLE_LAYERS.items()], F.lit("shared"))


def layer_order(name) -> Column:
    name = _col(name)
    return first_match([(name == layer_name, F.lit(i)) for i, layer_name in enumerate(LAYER_ORDER)], F.lit(99))


def language(path) -> Column:
    suffix = paths.extension(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(known, suffix)


def is_config_file(path) -> Column:
    return paths.basename(path).isin(*CONFIG_FILES)


def is_readme(path) -> Column:
    return F.lower(paths.basename(path)).startswith("readme")


def license_name(text, head: int | None = None) -> Column:
    """License of a license file, by its whole text or its first ``head`` characters."""
    head = F.lower(_col(text) if head is None else F.substring(_col(text), 1, head))
    return first_match([(head.contains(phrase), F.lit(name)) for phrase, name in LICENSES], F.lit("Custom"))


def architecture_type(frameworks) -> Column:
    names = _col(frameworks)
    return first_match(
        [
            (F.arrays_overlap(names, F.array(*[F.lit(n) for n in CLIENT_FRAMEWORKS])), F.lit("Client Application")),
            (F.arrays_overlap(names, F.array(*[F.lit(n) for n in SERVER_FRAMEWORKS])), F.lit("Backend Service")),
        ]
    )


def is_script(path) -> Column:
    return _col(path).rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|mts|cts)$")


def is_asset_import(specifier, source_path) -> Column:
    """A script importing an asset by its extension, or anything through a loader query."""
    specifier = _col(specifier)
    base = F.substring_index(specifier, "?", 1)
    tail = F.lower(F.regexp_extract(base, r"\.([^./]*)$", 1))
    return is_script(source_path) & (specifier.contains("?") | tail.isin(*ASSET_EXTENSIONS))


def module_id(path, role, defines_symbols) -> Column:
    """Module a file belongs to."""
    path, role = F.trim(_col(path), F.lit("/")), _col(role)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    fixed = {
        "api": ("controller", "route"),
        "services": ("service",),
        "repositories": ("repository",),
        "domain": ("model", "dto", "interface", "enum"),
        "middleware": ("middleware",),
        "configuration": ("configuration",),
        "tests": ("test",),
        "documentation": ("documentation",),
    }
    rooted = F.get(parts, F.lit(0)).isin("app", "src", "backend", "frontend", "apps") & (F.size(parts) > 1)
    name = first_match(
        [(role.isin(*roles), F.lit(module)) for module, roles in fixed.items()]
        + [
            (_col(defines_symbols) & (F.size(parts) > 0), path),
            (rooted, F.lower(F.get(parts, F.lit(1)))),
            (F.size(parts) > 0, F.lower(F.get(parts, F.lit(0)))),
        ],
        F.lit("repository"),
    )
    return F.concat(F.lit("module:"), name)


def module_display_name(module) -> Column:
    raw = F.regexp_replace(_col(module), "^module:", "")
    stem = F.regexp_replace(paths.basename(raw), r"(?<=.)\.[^.]+$", "")
    parent = paths.basename(paths.directory(raw))
    nested = F.when(stem.isin("__init__", "index", "mod") & (parent != ""), parent).otherwise(stem)
    return (
        F.when(raw.contains("/"), nested)
        .when(raw.contains("."), raw)
        .otherwise(F.initcap(F.translate(raw, "-", " ")))
    )


def is_environment_path(path) -> Column:
    name = F.lower(paths.basename(path))
    return name.startswith(".env") | name.isin("settings.py", "config.py", "config.ts", "config.js")


def is_deployment_path(path) -> Column:
    """Docker files and workflows outright, YAML only next to a deployment word."""
    name = F.lower(_col(path))
    return (
        name.contains("dockerfile")
        | name.startswith(".github/workflows/")
        | (name.rlike(r"\.(yml|yaml)$") & name.rlike("deploy|compose|ci"))
    )
