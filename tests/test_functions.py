"""Literal cases the driver tables never contain."""


from lodegraph.functions import paths, roles, text
from lodegraph.sources import inventory


def table(spark, column, pairs, schema="a string, want string"):
    df = spark.createDataFrame(pairs, schema)
    return [(r["a"], r["got"], r["want"]) for r in df.select("a", column.alias("got"), "want").collect()]


def same(rows):
    assert not [r for r in rows if r[1] != r[2]]


def test_normalize_path(spark):
    pairs = [
        ("a/./b/../c//d", "a/c/d"), ("../x", None), ("/abs", None), ("C:\\u", None), ("a\\b", "a/b"), ("", ""),
        ("a/..", ""), ("a/../..", None), ("\\x", None), ("a/../../b", None), (None, None),
    ]
    same(table(spark, paths.normalize_path("a"), pairs))


def test_url_origin(spark):
    pairs = [
        ("HTTP://H.Example.com.:80/p", "http://h.example.com"), ("https://h:8443", "https://h:8443"), ("//h/x", None),
        ("ftp://h/", None), ("https://h:bad/", None), ("https://h:70000/", None), ("https://u:p@h/x", "https://h"),
        ("https://h:443?q", "https://h"), ("http:///x", None), ("h/x", None),
    ]
    same(table(spark, paths.url_origin("a"), pairs))
    same(table(spark, paths.url_path("a"), [("HTTP://h:80/p?q", "/p"), ("https://h", "/"), ("//h/x", None)]))


def test_referents(spark):
    rows = spark.createDataFrame([("get", "https://h/x"), ("G T", "https://h"), ("get", "/rel")], "m string, u string")
    assert [r[0] for r in rows.select(paths.referent("m", "u")).collect()] == ["GET|https://h|/x", None, None]
    same(table(spark, paths.parse_referent("a")["origin"], [("GET|o|/p", "o"), ("GET|o", None), ("GET||/p", None), ("a|b|c|d", None)]))


def test_stable_keys(spark):
    pairs = [
        ("repository", "repo:root", "repo:root"), ("repository", "repo:x", None), ("module", "mod:", "mod:"),
        ("file", "file:", None), ("file", "file:a//b", "file:a/b"), ("symbol", "a.py::f", "a.py::f"),
        ("symbol", "a.py::", None), ("symbol", "::f", None), ("dependency", "dep:npm:@a/b", "dep:npm:@a/b"),
        ("dependency", "dep:npm", None), ("service", "svc:https://h", "svc:https://h"), ("service", "svc:h", None),
        ("iac_resource", "iac:a.yml::service/db", "iac:a.yml::service/db"), ("iac_resource", "iac:a.yml::db", None),
        ("future_kind", "any key", "any key"), ("Bad", "x", None), ("future", "x\x01", None), ("future", "", None),
    ]
    df = spark.createDataFrame(pairs, "kind string, key string, want string")
    rows = df.select("want", paths.normalize_stable_key("kind", "key").alias("got"), "key").collect()
    assert not [r for r in rows if r.want != r.got]


def test_extension_and_archive(spark):
    same(table(spark, paths.extension("a"), [("x/a.PY", "py"), (".env", None), ("a.b.ts", "ts"), ("Makefile", None), (".env.example", "example"), ("a.b/c", None)]))
    same(table(spark, paths.archive_name("a"), [("x.tar.gz", "x"), ("x.TGZ", "x"), ("a.b.zip", "a.b"), ("a.txt", "a"), ("noext", "noext")]))


def test_package_root(spark):
    rows = spark.createDataFrame(
        [("a.b.c", "x.py", "a"), (".m", "x.py", ""), ("@s/n/p", "x.ts", "@s/n"), ("react/jsx", "x.tsx", "react"), ("./u", "x.ts", ".")],
        "s string, p string, want string",
    )
    assert not [r for r in rows.select(paths.package_root("s", "p").alias("got"), "want").collect() if r.got != r.want]


def test_request_class(spark):
    rows = spark.createDataFrame(
        [
            ("OPTIONS", "/ai", None), ("GET", "/health", None), ("GET", "/docs/x", None), ("POST", "/auth/login", "auth"),
            ("GET", "/auth/login", "default"), ("GET", "/ai", "ai"), ("GET", "/aix", "default"),
            ("POST", "/analysis/1/start", "heavy"), ("POST", "/export", "heavy"), ("GET", "/export", "default"),
        ],
        "m string, p string, want string",
    )
    assert not [r for r in rows.select(paths.request_class("m", "p").alias("got"), "want").collect() if r.got != r.want]


def test_roles(spark):
    pairs = [
        ("README.md", "documentation"), ("a/test_x.py", "test"), ("tests/readme.md", "documentation"), ("src/main.py", "entrypoint"),
        ("a/auth_middleware.py", "middleware"), ("controllers/route.py", "controller"), ("x/ROUTES/a.py", "route"),
        ("user_service.py", "service"), ("repo.py", "repository"), ("models/a.py", "model"), ("a.txt", None),
    ]
    same(table(spark, roles.file_role("a"), pairs))
    same(table(spark, roles.symbol_role("a"), [("UserService", "service"), ("Service", None), ("userservice", None), ("XDTO", "dto")]))
    same(table(spark, roles.module_display_name("a"), [("module:src/click/core.py", "core"), ("module:a/b/__init__.py", "b"), ("module:app.py", "app.py"), ("module:my-lib", "My Lib")]))


def test_text_helpers(spark):
    same(table(spark, text.strip_discriminator("a"), [("group#5", "group"), ("a#b", "a#b")]))
    flags = [("${X}", "true"), ("$X", "true"), ("$$X", "false"), ("$", "false"), ("a$$${y}", "false")]
    same(table(spark, text.has_interpolation("a").cast("string"), flags))
    same(table(spark, text.import_binding("a")["local"], [("m|x|y", "y"), ("m||y", None), ("m|x", None), ("m|x|y|z", "y|z")]))
    same(table(spark, text.producer_parts("a")["version"], [("a@b@1", "1"), ("plain", ""), ("x@", "")]))
    same(table(spark, text.logical_line_count("a").cast("string"), [("", "1"), ("a\n", "2"), ("a\nb", "2")]))


def test_nfc(spark):
    df = spark.createDataFrame([("e\u0301",), ("é",), ("plain",), (None,)], "a string")
    rows = [r[0] for r in text.with_nfc(df, "a").collect()]
    assert sorted(rows, key=str) == sorted(["é", "é", "plain", None], key=str)


def test_triage_and_scan(spark, tmp_path):
    tree = {
        "src/a.py": b"x = 1\n", "src/nul.py": b"a\x00b", "src/bad.py": b"\xc3\x28", "src/empty.py": b"",
        "src/big.py": b"x" * (512 * 1024 + 1), "src/edge.py": b"x" * (512 * 1024), "node_modules/m.js": b"1",
        "src/._a.py": b"1", ".DS_Store": b"1", "src/zero.py": b"\x70\x05",
    }
    for name, data in tree.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    files = inventory.scan_tree(spark, str(tmp_path))
    got = {r.path: r.code for r in inventory.triage(files, text.SERVICE_LIMIT).select("path", "code").collect()}
    assert got == {
        "src/a.py": None, "src/nul.py": "RI-SRC-BINARY", "src/bad.py": "RI-SRC-MALFORMED", "src/empty.py": None,
        "src/big.py": "RI-LIMIT-SKIP", "src/edge.py": None, "src/zero.py": None,
    }


def test_requirements(spark):
    body = "# c\n\n-r x.txt\n./local\nFlask>=1 # note\nfoo[bar]==2\nbaz @ https://h/a.whl#sha256=1\r\nlast"
    df = spark.createDataFrame([(1, body)], "id int, text string")
    rows = [(r.line_number, r.name, r.version) for r in inventory.requirements(df, "id").orderBy("line_number").collect()]
    assert rows == [(5, "Flask", ">=1"), (6, "foo", "[bar]==2"), (7, "baz", "@ https://h/a.whl#sha256=1"), (8, "last", None)]


def test_npm_malformed_roots(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "not json"), (3, '{"dependencies":{}}'), (4, "{}")], "id int, text string")
    good, bad = inventory.npm_declarations(df, "id")
    assert good.count() == 0
    assert sorted(r.id for r in bad.collect()) == [1, 2]


def test_module_name_and_prefix(spark):
    from lodegraph.operators import summaries

    df = spark.createDataFrame([("g", "a/b/c.py"), ("g", "a/b/d/e.py"), ("h", "x.py"), ("h", "y/z.py")], "k string, path string")
    rows = {r.k: r.p for r in df.groupBy("k").agg(summaries.path_prefix("path").alias("p")).collect()}
    assert rows == {"g": "/a/b", "h": "/"}
    names = df.select("path", paths.module_name("path").alias("n"))
    assert {r.path: r.n for r in names.collect()}["x.py"] is None


def test_mode_tie_and_null_version(spark):
    from lodegraph.operators import summaries

    df = spark.createDataFrame([("m", "model", "b"), ("m", "service", "a"), ("m", None, "0")], "k string, v string, path string")
    assert summaries.dominant(df, ["k"], "v", "path").first().v == "service"
    versions = spark.createDataFrame([("d", None), ("d", "1"), ("e", "2"), ("e", "2"), ("f", None)], "k string, v string")
    got = {r.k: (r.v, r.t) for r in versions.groupBy("k").agg(summaries.single_or_null("v").alias("v"), summaries.single_or("v", "multiple").alias("t")).collect()}
    assert got == {"d": (None, "multiple"), "e": ("2", "2"), "f": (None, None)}
