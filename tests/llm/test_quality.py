from conftest import EDGES, FOLDER

from lodegraph.llm import queries
from lodegraph.llm.quality import score_documents


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = "pmod(xxhash64(doc_id, 7), 3) = 0"
    scored = score_documents(docs, labels.where(f"not {held}"), ["doc_id"]).join(labels.where(held), "doc_id").collect()
    good = [r for r in scored if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r for r in scored if r["quality"] == 0]
    assert len(good) > 50 and len(bad) > 5
    assert sum(r["score"] >= 0.5 for r in good) >= 0.93 * len(good)
    assert sum(r["score"] < 0.5 for r in bad) >= 0.85 * len(bad)


def test_query_scores_every_document(spark, documents):
    rows = queries.op10_quality(spark, FOLDER).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r["score"] <= 1 and r["keep"] == (r["score"] >= 0.5) for r in rows)
    again = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, FOLDER).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_edges(spark, edges, nothing):
    schema = "doc_id bigint, quality int, toxic int, text string"
    labels = spark.createDataFrame(
        [(1, 1, 0, "x"), (2, None, None, None), (3, 0, None, "x"), (4, 1, 1, "x"), (4, 1, 1, "x"), (None, 0, 0, "x"), (77, 0, 0, "x")],
        schema,
    )
    rows = score_documents(edges, labels, ["doc_id", "ids"]).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert score_documents(nothing, labels, ["doc_id"]).collect() == []
    unlabelled = score_documents(edges, labels.limit(0), ["doc_id"]).collect()
    assert len(unlabelled) == len(EDGES) and {r["score"] for r in unlabelled} == {1.0}


def test_unlabelled_documents_teach_at_any_number(spark):
    """Words that only unlabelled documents have, few of them, among many others."""
    import random

    draw = random.Random(3)
    pick = lambda kind, n: " ".join(f"{kind}{draw.randrange(40)}" for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        rows.append((i, f"{pick('well' if good else 'poor', 12)} {pick('plain', 30)}", "en", "site" if good else "spam"))
        labels.append((i, good, 0))
    # their source tells what they are; their words are in no labelled document
    for i in range(400, 460):
        good = i % 2
        rows.append((i, f"{pick('fine' if good else 'foul', 12)} {pick('plain', 30)}", "en", "site" if good else "spam"))
    for i in range(460, 480):
        rows.append((i, f"{pick('fine' if i % 2 else 'foul', 12)} {pick('plain', 30)}", "en", "unknown"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    plain = "array_join(transform(sequence(1, 30), j -> 'plain' || pmod(xxhash64(id, j), 40)), ' ') as text"
    others = spark.range(1_000, 101_000).selectExpr("id as doc_id", plain, "'en' as lang", "'other' || id % 5 as source")
    docs = docs.unionByName(others)
    scored = score_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), ["doc_id"])
    got = {r["doc_id"]: r["text_score"] for r in scored.where("doc_id >= 460 and doc_id < 480").collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2) + 0.2
