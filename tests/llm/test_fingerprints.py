import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import EDGES, FOLDER, LONG

from lodegraph.llm import fingerprints as fp
from lodegraph.llm import queries


def share(a, b):
    a, b = (Counter(fp.pieces(x.encode())) for x in (a, b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def brute(rows):
    """Rows in the order of the operator."""
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), share(text, edited), share(text, after))
    return out


def test_query(spark, documents):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()), reverse=True)
    want, prints = brute(rows), {}
    got = queries.op1_fingerprints(spark, FOLDER).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, sha, near_edited, near_next = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(near_edited), pytest.approx(near_next))
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_edges(spark, edges, nothing):
    rows = fp.fingerprint_versions(edges).collect()
    assert len(rows) == len(EDGES)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == "0" * len(by_id[1]["fingerprint"])
    assert by_id[9]["fingerprint"] == by_id[10]["fingerprint"] and by_id[10]["near_next"] == 1.0
    assert by_id[3]["n_chars"] == len(LONG)
    assert fp.fingerprint_versions(nothing).collect() == []
    one = spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")
    row = fp.fingerprint_versions(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_peeling_recovers_what_differs_and_grows():
    draw = np.random.default_rng(1)
    common = draw.integers(0, 2**63, 5000).astype(np.uint64)
    a, b = [], []
    for n in (0, 1, 3, 40, 900):
        more, less = (draw.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        a.append(np.concatenate([common, more]))
        b.append(np.concatenate([less, common]))
    for x, y, (more, less) in zip(a, b, fp.differing(a, b), strict=True):
        assert sorted(more) == sorted(set(x) - set(y)) and sorted(less) == sorted(set(y) - set(x))


def test_repeated_pieces_count():
    one, two = fp.digests(b"same line\nsame line\n"), fp.digests(b"same line\n")
    (more, less), = fp.differing([one], [two])
    assert len(more) > 0 and len(less) == 0
    assert fp.sketch([one], fp.CELLS).hex() != fp.sketch([two], fp.CELLS).hex()


def test_an_edit_stays_local():
    text = LONG.encode()
    changed = text[:50_000] + b"inserted" + text[50_000:]
    (more, less), = fp.differing([fp.digests(text)], [fp.digests(changed)])
    assert 1 <= len(more) <= 3 and 1 <= len(less) <= 3
