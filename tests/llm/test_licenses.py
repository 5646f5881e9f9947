from conftest import EDGES, FOLDER
from oracle import check, duck

from lodegraph.llm import license_scan, queries


APACHE = max((text for name, text in license_scan.TEMPLATES if name == "Apache-2.0"), key=len)


def test_query(spark):
    name = "op9_licenses"
    good, note = check(spark, FOLDER, name, queries.QUERIES[name], queries.CHECKS[name], duck(FOLDER))
    assert good, note


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = license_scan.scan(df, ["id"]).orderBy("id").collect()
    return [[(x["license"], x["first_line"], x["last_line"]) for x in r["notices"]] for r in rows]


def test_notices(spark):
    long = APACHE
    words = long.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    texts = [
        None, "", "nothing here", "Some prose.\nReleased under the MIT License.\nMore prose.",
        f"prose before\n\n{wrapped}\n\nprose after", f"{wrapped.upper()}",
        "LICENSED  under the Apache License -- Version 2.0", "the license of a poet is no licence at all",
        "Released under the MIT License.\nReleased under the MIT License.", "license " * 3000,
    ]
    got = found(spark, texts)
    assert got[:4] == [[], [], [], [("MIT", 1, 1)]]
    assert [x[0] for x in got[4]] == ["Apache-2.0"] and [x[0] for x in got[5]] == ["Apache-2.0"]
    assert got[6] == [("Apache-2.0", 0, 0)] and got[7] == [] and got[8] == [("MIT", 0, 0)] and got[9] == []


def test_edges(edges, nothing):
    assert license_scan.scan(edges, ["doc_id", "score"]).count() == len(EDGES)
    assert license_scan.scan(nothing, ["doc_id"]).collect() == []


def test_texts_without_anchors_stay_under_the_limit():
    for _, text in license_scan.TEMPLATES:
        bigrams = license_scan.bigrams_of(text)
        anchors = license_scan.anchors_of(bigrams, license_scan.LEAST)
        free = [b for b in bigrams if not anchors & set(b.split())]
        # a text that has just these bigrams is as near as one without anchors can be
        assert 2 * len(free) / (len(free) + len(bigrams)) < license_scan.LEAST


def test_notices_inside_lines(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    body = APACHE
    texts = [
        "Copyright (c) 2021 Jane Doe. Released under the MIT License.",
        f"{long} Released under the MIT License. {long}",
        f"first\n{long} {body} {long}\nlast",
        f"some words before\nof the copyright: Released under\nthe MIT License, and so on {long}",
        "Released under the. " * 2000 + "Released under the MIT License.",
    ]
    got = found(spark, texts)
    assert got[0] == [("MIT", 0, 0)] and got[1] == [("MIT", 0, 0)]
    assert got[2] == [("Apache-2.0", 1, 1)] and got[3] == [("MIT", 1, 2)] and ("MIT", 0, 0) in got[4]


def brute(text):
    """The best coefficient of each licence over all runs of words."""
    words = license_scan.re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    pairs, best = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], {}
    for name, template in license_scan.TEMPLATES:
        own = set(license_scan.bigrams_of(template))
        lo, hi = len(own) * 0.7 / 1.3, len(own) * 1.3 / 0.7
        for a in range(len(pairs)):
            for b in range(a, min(len(pairs), a + int(hi))):
                run = set(pairs[a : b + 1])
                dice = round(2 * len(run & own) / (len(run) + len(own)), 9)
                if b - a + 1 >= lo and dice >= 0.7:
                    best[name] = max(best.get(name, 0), dice)
    return best


def test_coefficients_as_from_all_runs(spark):
    import random

    draw, texts = random.Random(8), []
    for _, template in license_scan.TEMPLATES:
        words = template.split()
        for at in draw.sample(range(len(words)), len(words) // 6):
            words[at] = "other"
        texts.append(" ".join(["some words", *words, "and a few", *template.split()[:9], "more"]))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = license_scan.scan(df, ["id"]).collect()
    got = {r["id"]: {x["license"]: x["dice"] for x in r["notices"]} for r in rows}
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert {i: set(x) for i, x in got.items()} == {i: set(x) for i, x in want.items()}
    assert got == want


def test_a_run_of_words_goes_before_a_worse_line(spark):
    """A line that matches with words around it, and a better run in it."""
    df = spark.createDataFrame([(1, "It is released under the MIT License.\nx")], "id long, text string")
    notices = license_scan.scan(df, ["id"]).first()["notices"]
    assert [(x["license"], x["dice"], x["first_line"], x["last_line"]) for x in notices] == [("MIT", 1.0, 0, 0)]


def test_related_licences_and_conditions(spark):
    body = {name: text for name, text in license_scan.TEMPLATES}
    df = spark.createDataFrame([(n, f"x\n{body[n]} y") for n in ("AGPL-3.0", "LGPL-3.0", "BSD-2-Clause")], "id string, text string")
    for row in license_scan.scan(df, ["id"]).collect():
        assert max(row["notices"], key=lambda x: x["dice"])["license"] == row["id"]


def test_query_against_its_sql_with_notices_inside_lines(spark, tmp_path):
    import random

    draw, rows = random.Random(5), []
    for _, template in license_scan.TEMPLATES:
        words = template.split()
        for k in (0, 8, 5):
            own = [w if not k or draw.randrange(k) else "other" for w in words]
            own = [w + draw.choice((" ", " ", "\n")) for w in own]
            rows.append((len(rows), f"some words before {''.join(own)} and after, {' '.join(words[:5])}"))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "license", "dice", "first_line", "last_line"]
    want = con.execute(f"select {', '.join(names)} from ({queries.CHECKS['op9_licenses']})").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op9_licenses"](spark, str(tmp_path)).select(names).collect()]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > len(rows)


def test_many_short_lines_of_anchor_words(spark):
    """Work grows with the marks, not with the pairs of lines."""
    import time

    begin = time.monotonic()
    lists = ["license\nsoftware\n" * 2500, "all\ncan\ndo\n0\nmay\nfree\ncopy\n" * 3000]
    body = APACHE.replace(" ", "\n")
    got = found(spark, [*lists, "\n".join([*lists, body, *lists])])
    assert got[0] == got[1] == [] and got[2] and time.monotonic() - begin < 60
