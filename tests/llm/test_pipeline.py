import public_tokenizers
import pytest
import tiktoken
from conftest import EDGES, FOLDER
from pyspark.sql import functions as F
from test_lines import brute as brute_lines

import corpus_pipeline
from lodegraph.llm import bpe
from lodegraph.llm.decontaminate import MIN_CHARS, normal
from lodegraph.llm.simhash import grams_of

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark, documents):
    """The documents after each stage, in order."""
    docs, out = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns_and_counts(documents, kept):
    counts = [documents.count(), *(d.count() for d in kept)]
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2] and counts[4] == counts[5]
    assert all(d.columns == documents.columns for d in kept[:4])


def test_first_stage_follows_the_labels(spark, kept):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    ids = {r[0] for r in kept[0].select("doc_id").collect()}
    good = [r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()]
    bad = [r["doc_id"] for r in labels.where("quality = 0").collect()]
    assert sum(i in ids for i in good) >= 0.95 * len(good)
    assert sum(i not in ids for i in bad) >= 0.8 * len(bad)


def test_lines_as_brute_force(kept):
    before = [(r["doc_id"], r["text"]) for r in kept[0].collect()]
    want = {d: text for d, _, _, text in brute_lines(before, 40, 5)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept[1].collect()} == {d: (t, len(t)) for d, t in want.items()}


def test_one_of_each_as_brute_force(kept):
    """The smallest id of each class of texts that a chain of similarities of 0.8 connects, from all pairs of sets."""
    texts = sorted((r["doc_id"], r["text"]) for r in kept[1].collect())
    sets = [set(grams_of((t or "").encode(), 5)) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        for j in range(i):
            if 0.8 * max(len(own), len(sets[j])) <= min(len(own), len(sets[j])):
                both = len(own & sets[j])
                if both >= 0.8 * (len(own) + len(sets[j]) - both) - 1e-9:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    assert {r[0] for r in kept[2].select("doc_id").collect()} == {d for i, (d, _) in enumerate(texts) if find(i) == i}


def test_benchmark_passages_are_gone(spark, kept):
    items = [normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = lambda t: any(len(p) >= MIN_CHARS and p in normal(t) for p in items)
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in kept[2:4])
    assert set(after) <= {d for d, t in before.items() if not held(t)}
    assert len(before) - len(after) <= sum(map(held, before.values())) + 2


def test_ids_as_the_library(kept):
    ranks = bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in kept[3].collect()}
    for r in kept[4].collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]])
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_edges_of_each_stage(spark, edges, nothing, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words " * 9), (2, None)], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, edges, str(tmp_path))
        assert stage(spark, nothing, str(tmp_path)).collect() == []
        if name != "byte-level BPE":
            assert rows.columns == edges.columns
        n = rows.count()
        if name == "SimHash near-dedup":
            ids = [r["doc_id"] for r in rows.collect()]
            assert 10 not in ids and {1, 3, 9} <= set(ids) and ids.count(None) == 2
        else:
            assert n == len(EDGES)


def test_copies_leave_one(spark, documents):
    copies = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    ids = [r[0] for r in STAGES["SimHash near-dedup"](spark, copies, FOLDER).select("doc_id").collect()]
    assert ids and max(ids) < 1_000_000 and len(set(ids)) == len(ids)


def test_near_dedup_runs_simhash_on_every_text(spark, documents, monkeypatch):
    """The stage's candidates come from op4's operator, too, and from all rows with an id."""
    seen, run = [], corpus_pipeline.simhash.near_duplicates

    def watched(df, *args, **kwargs):
        seen.append(run(df, *args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(corpus_pipeline.simhash, "near_duplicates", watched)
    STAGES["SimHash near-dedup"](spark, documents, FOLDER).collect()
    found = seen[0].select("doc_id", "component_id")
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in documents.where("doc_id is not null").collect())
    assert found.where("doc_id <> component_id").count() > 0
