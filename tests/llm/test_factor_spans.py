"""Repeated word sequences against a plain version of the contract."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodegraph.llm import factor_spans, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=13):
    first = defaultdict(lambda: float("inf"))
    words = [WORD.findall(t or "") for _, t in docs]
    for (i, _), own in zip(docs, words):
        if i is not None:
            for a in range(len(own) - window + 1):
                first[tuple(own[a : a + window])] = min(first[tuple(own[a : a + window])], i)
    out = []
    for (i, _), own in zip(docs, words):
        gone = [False] * len(own)
        if i is not None:
            for a in range(len(own) - window + 1):
                if first[tuple(own[a : a + window])] < i:
                    gone[a : a + window] = [True] * window
        out.append((i, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return sorted(out, key=repr)


def found(df, window=13):
    rows = factor_spans.remove_repeats(df, ["doc_id"], window).collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows), key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def mixed(draw, texts, words, phrases):
    """Texts of random words, phrases, and parts of earlier texts."""
    common = [[f"p{i}x{j}" for j in range(draw.randint(5, 40))] for i in range(phrases)]
    made: list[list[str]] = []
    for _ in range(texts):
        own: list[str] = []
        for _ in range(draw.randint(0, 8)):
            kind = draw.random()
            if kind < 0.4:
                own += [f"w{draw.randrange(words)}" for _ in range(draw.randint(1, 40))]
            elif kind < 0.7:
                own += draw.choice(common)
            elif made:
                other = draw.choice(made)
                a = draw.randrange(len(other) + 1)
                own += other[a : a + draw.randint(1, 60)]
        made.append(own)
    return [draw.choice([" ", " ", "\n"]).join(x) for x in made]


@pytest.mark.parametrize("hot", [10_000, 2])
@pytest.mark.parametrize("words", [3, 5000])
def test_random(spark, monkeypatch, hot, words):
    """Small chunks and blocks; with ``hot`` of 2 most anchors send single runs."""
    monkeypatch.setattr(factor_spans, "HOT", hot)
    monkeypatch.setattr(factor_spans, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(factor_spans, "BLOCK_BYTES", 2_000)
    draw = random.Random(words + hot)
    texts = mixed(draw, 150, words, 6)
    docs = list(zip(draw.sample(range(1000), 150), texts))
    assert found(frame(spark, docs)) == brute(docs)


def test_windows(spark):
    draw = random.Random(1)
    docs = list(enumerate(mixed(draw, 60, 4, 3)))
    for window in (2, 5, 6, 30):
        assert found(frame(spark, docs), window) == brute(docs, window)


def test_hot_phrase(spark, monkeypatch):
    """One phrase in a third of all documents, each time between other words."""
    monkeypatch.setattr(factor_spans, "HOT", 50)
    monkeypatch.setattr(factor_spans, "CHUNK_BYTES", 20_000)
    phrase = " ".join(f"hot{j}" for j in range(20))
    draw = random.Random(2)
    own = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randint(0, 30)))
    docs = [(i, f"{own()} {phrase} {own()}" if i % 3 == 0 else own()) for i in range(900)]
    assert found(frame(spark, docs)) == brute(docs)


def test_documents(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(documents) == brute(docs)


def test_edges(spark, edges, nothing):
    assert found(edges) == brute([(r["doc_id"], r["text"]) for r in edges.collect()])
    assert found(nothing) == []


def test_defined_results(spark):
    words = [f"w{i}" for i in range(40)]
    whole = " ".join(words)
    docs = [
        (5, whole), (5, whole), (3, " ".join(words[:13])), (9, whole + " \t\x0b" + whole), (None, whole), (None, None),
        (2, "a b " * 30), (1, None), (-4, " ".join(words[20:32])), (7, " ".join(words[:12])), (8, "x" * 3_000_000 + " " + whole),
    ]
    assert found(frame(spark, docs)) == brute(docs)


def test_longest_factor():
    """The index against a search in all pieces."""
    draw = random.Random(4)
    pieces = [[str(draw.randrange(3)) for _ in range(draw.randint(1, 21))] for _ in range(60)]
    ids = [draw.randrange(12) for _ in pieces]
    block = factor_spans.ReferenceBlock(np.array(ids), [" ".join(p).encode() for p in pieces], 13)
    for d, own, begin in zip(ids, pieces, block.begin.tolist()):
        for a in range(len(own)):
            best = 0
            for other, o in zip(ids, pieces):
                if other < d:
                    for b in range(len(o)):
                        n = 0
                        while a + n < len(own) and b + n < len(o) and own[a + n] == o[b + n]:
                            n += 1
                        best = max(best, n)
            assert block.longest(np.array([begin + a])).tolist() == [best]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, "z")], "doc_id bigint, text string, chunk int, _id int, spans string")
    assert factor_spans.remove_repeats(df, ["doc_id", "chunk", "_id"]).first()["_id"] == 2


def test_query_reads_all(spark, documents):
    assert queries.op12_substring_dedup(spark, "/root/testdata/sf0.001").count() == documents.count()
