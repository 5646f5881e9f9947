"""The filter audit against a plain version of the contract."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import byte_scan, filter_audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute_counts(text):
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    ids = defaultdict(set)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].add(i)
    rows = []
    for i, t, lang in docs:
        n, d, c, p, s = brute_counts(t or "")
        copy = i is not None and i > min(ids[t or ""])
        rows.append((lang or "", i, "".join(x for x, y in zip("ABCDE", (n < 100, 100 * d < 80 * n, 100 * c > 10 * p, s > 0, copy)) if y)))
    out = {}
    shapley = defaultdict(int)
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                here = [r for r in left if letter in r[2]]
                left = [r for r in left if letter not in r[2]]
                all_failing = sum(letter in r[2] for r in own)
                out[part, "".join(order), step] = [
                    len(left), len(here), all_failing - len(here), sum(r[2] == letter for r in own),
                    sum(r[1] in good for r in here), sum(r[1] in toxic for r in here),
                ]
                shapley[part, letter] += len(here)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in df.collect()}


@given(st.lists(st.text(alphabet=st.sampled_from("aAbB #$|\t\n\x0b\x0c\r\x1cé日\U0001f642"), max_size=60), max_size=8))
@settings(max_examples=200, deadline=None)
def test_counts(texts):
    if texts:
        found = filter_audit.counts_of([t.encode() for t in texts])
        assert list(zip(*(found[n].tolist() for n in ("words", "distinct", "capitals", "points", "symbols")))) == [
            brute_counts(t) for t in texts
        ]


def test_counts_over_blocks(monkeypatch):
    """Texts and words longer than a block."""
    draw = random.Random(5)
    texts = ["".join(draw.choice("aB \n#é") * draw.randint(1, 9) for _ in range(300)) for _ in range(4)] + ["x" * 500, "", "x" * 500 + " " + "x" * 500]
    monkeypatch.setattr(byte_scan, "BLOCK", 64)
    found = filter_audit.counts_of([t.encode() for t in texts])
    assert list(zip(*(x.tolist() for x in found.values()))) == [brute_counts(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(byte_scan, "word_hashes", lambda text, starts, ends: np.zeros(len(starts), np.uint64))
    text = "one two three one a-word-of-over-16-bytes a-word-of-over 16-bytes a-word-of-0ver-16-bytes two a-word-of-over-16-bytes"
    assert filter_audit.counts_of([text.encode()] * 3)["distinct"].tolist() == [7] * 3


def test_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    found = rows_of(filter_audit.audit(documents, labels))
    assert found == brute(docs, [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert found == rows_of(queries.op13_filter_audit(spark, "/root/testdata/sf0.001"))


def test_edges(spark, edges, nothing):
    told = [(4, 1, 0), (4, 0, 1), (1, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(told, "doc_id bigint, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in edges.collect()]
    assert rows_of(filter_audit.audit(edges, labels)) == brute(docs, [x for x in told if x[0] is not None])
    none = labels.where("doc_id = 0")
    assert filter_audit.audit(nothing, none).collect() == []
    assert rows_of(filter_audit.audit(edges, none)) == brute(docs, [])


def test_many_copies(spark):
    draw = random.Random(3)
    texts = ["W " * 120, "w " * 30, " ".join(map(str, range(130))), "a # b", "", None]
    docs = [(draw.randrange(300), draw.choice(texts), draw.choice(["en", "de", "", None])) for _ in range(600)]
    told = [(i, draw.randrange(2), draw.randrange(2)) for i in range(0, 300, 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(told, "doc_id bigint, quality int, toxic int")
    assert rows_of(filter_audit.audit(df, labels)) == brute(docs, told)


def test_clashing_names(spark):
    row = [(1, "a b", "x", 1, 2, "z")]
    df = spark.createDataFrame(row, "doc_id bigint, text string, lang string, id int, failed int, digest string")
    labels = spark.createDataFrame([(1, 1, 0, 5)], "doc_id bigint, quality int, toxic int, id int")
    assert len(rows_of(filter_audit.audit(df, labels))) == 600
