import random

import xxhash
from conftest import EDGES, FOLDER
from pyspark.sql import functions as F

from lodegraph.llm import queries, simhash
from lodegraph.llm.components import components


def brute_print(text, shingle=3):
    lower = {i: i + 32 for i in range(65, 91)}
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(lower)).split(" ") if w]
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_classes(prints, bits):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query(spark, documents):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in documents.collect()}
    classes = brute_classes(prints, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", classes[i]) for i in prints}
    assert len(set(classes.values())) < len(classes)


def test_edges(edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    zero = {r["component_id"] for r in rows if r["f0"] == 0}
    assert zero == {1}  # texts without words are a class
    assert {r["component_id"] for r in rows if r["doc_id"] in (9, 10)} == {9}
    assert simhash.near_duplicates(nothing).collect() == []


def test_links_of_a_large_group(spark):
    """Hundreds of fingerprints that share block keys: classes are the same as from all pairs."""
    draw = random.Random(11)
    base, prints = draw.getrandbits(64), {}
    for i in range(400):
        value = base
        for _ in range(draw.choice((0, 1, 1, 2, 3, 4))):
            value ^= 1 << draw.randrange(64)
        prints.setdefault(value, i)
    for i in range(400, 460):
        prints.setdefault(draw.getrandbits(64), i)
    by_node = {n: v for v, n in prints.items()}
    signed = [(n, v - (1 << 64) if v >> 63 else v) for n, v in by_node.items()]
    df = spark.createDataFrame(signed, "node bigint, f0 bigint")
    found = simhash.links(df, ["f0"], bits=2, blocks=4, equal=2)
    for a, b in found.collect():
        assert (by_node[a] ^ by_node[b]).bit_count() <= 2
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    assert {n: roots.get(n, n) for n in by_node} == brute_classes(by_node, 2)


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(150)] + [(None, 1), (5, 5), (order[0], order[1])]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    members = order[:151]
    assert {(r["node"], r["root"]) for r in got} == {(m, min(members)) for m in members if m != min(members)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_stage_settings_find_near_copies(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    rows = []
    for i in range(60):
        words = [draw.choice(vocabulary) for _ in range(300)]
        copy = list(words)
        for _ in range(3):
            copy[draw.randrange(300)] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.near_duplicates(df, shingle=5, bits=33, blocks=8, equal=3, words=3)
    roots = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert sum(roots[2 * i + 1] == 2 * i for i in range(60)) >= 55
    assert all(roots[2 * i] == 2 * i for i in range(60))
    assert got.where(F.col("component_id").isNull()).count() == 0


def test_links_inside_a_group_that_shares_its_keys(spark):
    """Fingerprints of three parts that share keys without being near, and near ones among them."""
    draw = random.Random(5)
    shared, by_node = draw.getrandbits(24), {}
    for i in range(0, 80, 2):  # the first 24 bits of each part are boilerplate
        parts = [shared | draw.getrandbits(40) << 24 for _ in range(3)]
        by_node[i] = tuple(parts)
        if i % 8 == 4:
            # all other blocks differ, in twelve bits
            flips = sum(1 << b for b in (24, 32, 40, 48))
            by_node[i + 1] = tuple(p ^ flips ^ (1 << 56) for p in parts)
    signed = [(n, *(v - (1 << 64) if v >> 63 else v for v in p)) for n, p in by_node.items()]
    df = spark.createDataFrame(signed, "node bigint, f0 bigint, f1 bigint, f2 bigint")
    found = {tuple(r) for r in simhash.links(df, ["f0", "f1", "f2"], bits=33, blocks=8, equal=3, paired=8).collect()}
    whole = {n: sum(v << 64 * k for k, v in enumerate(p)) for n, p in by_node.items()}
    assert found == {(a, b) for a in whole for b in whole if a < b and (whole[a] ^ whole[b]).bit_count() <= 33}
    assert len(found) >= 10
