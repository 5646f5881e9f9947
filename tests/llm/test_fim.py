"""Fill-in-the-middle forms against a plain version of the contract."""

import hashlib
import re

import pytest

from lodegraph.llm import fim, queries

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed=7, share=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def same(df, rows, **options):
    out = fim.rearranged(df, ["doc_id"], **options)
    out = out.select("*", fim.restored().alias("restored")).collect()
    found = sorted((tuple(r)[:6] for r in out), key=repr)
    assert found == sorted(((i, *brute(i, t, **options)) for i, t in rows), key=repr)
    assert sorted(r["restored"] for r in out) == sorted(t or "" for _, t in rows)


def test_documents(spark, documents):
    same(documents, [(r["doc_id"], r["text"]) for r in documents.collect()])


@pytest.mark.parametrize("options", [{}, {"seed": 1, "share": 50, "spm": 0}, {"share": 0}, {"spm": 100}])
def test_edges(edges, nothing, options):
    same(edges, [(r["doc_id"], r["text"]) for r in edges.collect()], **options)
    assert fim.rearranged(nothing, ["doc_id", "score"]).collect() == []


def test_odd_texts(spark):
    texts = [
        "\n", "\n\n\n", "a", "a\n", "a\r\nb\x0b\x85 c", "$1 \\1 $", "x<P>y", "<S", "<M>", "a<\n<b\n>c", "<\nS>\n<P",
        "é\U0001f642\n日本\n" * 50, "line\n" * 200_000, "no end " * 200_000, "\n" * 100_000 + "x",
    ]
    rows = [(10 * i + j, t) for i, t in enumerate(texts) for j in range(4)]
    same(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "x", "y", 3)], "doc_id bigint, text string, n string, output string, _text int")
    row = fim.rearranged(df, ["doc_id", "_text"]).first()
    assert row["_text"] == 3 and row["n"] == 2


def test_query_reads_all(spark):
    found = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(found) == len(rows)
    digests = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows}
    assert all(r["restored_sha256"] == digests[r["doc_id"]] for r in found)
