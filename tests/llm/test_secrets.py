import hashlib
import random

import brute_secrets
from conftest import EDGES, FOLDER

from lodegraph.llm import queries
from lodegraph.llm.secret_scan import scan, written


def test_query(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = queries.op5_secrets(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_secrets.base(texts[r["doc_id"]])
        kinds = [x[3] for x in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert r["base_sha256"] == hashlib.sha256(brute_secrets.written(base).encode()).hexdigest()
        assert r["spans"] == brute_secrets.written(brute_secrets.spans(texts[r["doc_id"]]))
    assert any(r["spans"] for r in rows)


def compare(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in scan(df, ["id"]).select("id", written("base").alias("base"), written("spans").alias("spans")).collect():
        text = texts[r["id"]] or ""
        assert r["base"] == brute_secrets.written(brute_secrets.base(text)), text
        assert r["spans"] == brute_secrets.written(brute_secrets.spans(text)), text


def test_random_strings(spark):
    draw = random.Random(3)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "A", "Z9", "0a", "f"]
    parts += ["é", "日", "\U0001f642", "xQ7", "-", "/", "+", "ſecret", "9f8e", "example", "\n"]
    compare(spark, ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(1500)])


def test_named_cases(spark):
    key = "kJ8sP2vX9qLmT4wZ7rBn"
    compare(
        spark,
        [
            None, "", "token=short", f"x {key} y", f"{key}{key[::-1]}{key}", f"example{key}",
            "550e8400-e29b-41d4-a716-446655440000", "0123456789abcdefghij", "a1" * 40, "F" * 30,
            "9A3F00B7C2D4E8811F5A", "token=password=abcdefghijklmnop", "token: \"abc\" secret='abcdefghijkl'",
            "AKIA" * 5, "AKIAAKIA12345678901", "word " * 5000 + key,
        ],
    )


def test_edges(edges, nothing):
    assert scan(edges, ["doc_id", "ids"]).count() == len(EDGES)
    assert scan(nothing, ["doc_id"]).collect() == []


def test_allow_list_leaves_base_kinds(spark):
    text = "token = example0123456789abcdefX"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert [s["kind"] for s in scan(df, ["id"]).first()["spans"]] == ["assign", "hex"]


def test_allow_list_suppresses_what_it_touches(spark):
    key = "kJ8sP2vX9qLmT4wZ7rBnC5dF1gH3yE6uA0iOxQtS"
    known = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = [f"/samples/dl/{key}", f"{key}example{key}", known, f"{known}/{key}", f"{key}01234567890{key}"]
    compare(spark, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    spans = {r["id"]: r["spans"] for r in scan(df, ["id"]).collect()}
    assert [(s["a"], s["b"]) for s in spans[0]][-1][1] == len(texts[0]) and len(spans[1]) == 2 and not spans[2]


def test_candidates_longer_than_blocks(spark):
    draw = random.Random(5)
    letters = "".join(chr(c) for c in range(48, 123) if chr(c).isalnum()) + "+/"
    longs = ["".join(draw.choice(letters) for _ in range(n)) + "1a" for n in (509, 510, 511, 528, 529, 530, 531, 1022, 1041, 4000)]
    mixed = ["".join(draw.choice(["ab1" * 9, "sample", *draw.sample(longs, 1)[0][:60]]) for _ in range(400)) for _ in range(4)]
    compare(spark, longs + mixed + ["".join(draw.choice("0123456789ABCDEF") for _ in range(3000))])


def test_a_very_long_candidate(spark):
    draw = random.Random(6)
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=200_000))
    compare(spark, [text])
