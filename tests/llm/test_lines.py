from collections import defaultdict

import numpy as np
from conftest import EDGES, LINE

from lodegraph.llm import lines, perfect_hash


def brute(rows, min_chars, min_docs):
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    count, last = defaultdict(int), {}
    for d, own in docs:
        if d is None:
            continue
        for k in {key(x) for x in own}:
            count[k] += 1
            last[k] = max(last.get(k, d), d)
    out = []
    for d, own in docs:
        kept = [
            x for x in own
            if d is None or len(key(x)) < min_chars or count[key(x)] < min_docs or last[key(x)] == d
        ]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def ran(df, **settings):
    rows = lines.drop_frequent_lines(df, ["doc_id", "score"], **settings).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows), key=str)


def test_edges(edges, nothing):
    want = brute([(r[0], r[1]) for r in EDGES], 40, 5)
    assert sum(x[2] for x in want) > 3 and any(LINE in x[3] for x in want)
    assert ran(edges, min_chars=40, min_docs=5) == want
    assert ran(nothing, min_chars=40, min_docs=5) == []


def test_documents_with_short_keys(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute(rows, 8, 2)
    got = lines.drop_frequent_lines(documents, ["doc_id"], min_chars=8, min_docs=2).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=str) == want
    assert sum(x[2] for x in want) > 0


def test_line_in_a_third_of_all_documents(spark):
    rows = [(i, LINE if i % 3 == 0 else f"document number {i} has a line of its own, as long as others") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    dropped = lines.drop_frequent_lines(df, ["doc_id"]).where("n_dropped > 0").select("doc_id").collect()
    assert sorted(r[0] for r in dropped) == [i for i in range(0, 5997, 3)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64))
    index = perfect_hash.Index(*perfect_hash.build(keys))
    assert sorted(index(keys).tolist()) == list(range(len(keys)))
    assert perfect_hash.Index(*perfect_hash.build(keys[:0]))(keys[:5]).tolist() == [-1] * 5
