"""Strongly connected components against a plain search."""

import random

from lodegraph.operators import cycles


def plain(links):
    """Components of nodes that reach themselves, by a search from every node."""
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    reach = {}
    for start in {x for link in links for x in link}:
        seen, left = set(), list(out.get(start, ()))
        while left:
            node = left.pop()
            if node not in seen:
                seen.add(node)
                left += out.get(node, ())
        reach[start] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}


def found(spark, links):
    rows = cycles.components(spark.createDataFrame(links, "source long, target long")).collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["component"] for r in rows}


def test_random_graphs(spark):
    """Many graphs side by side; rings with tails, a shared node and a chord; a grid of one-way streets."""
    links = []
    for seed in range(12):
        rng = random.Random(seed)
        nodes = rng.choice([6, 15, 40])
        for _ in range(int(nodes * rng.choice([0.8, 1.1, 1.6]))):
            links.append((1000 * seed + rng.randrange(nodes), 1000 * seed + rng.randrange(nodes)))
    links += [(100, 101), (101, 102), (102, 103), (103, 101), (103, 104), (101, 110), (110, 111), (111, 101), (110, 101)]
    for i in range(5):
        for j in range(5):
            links += [(200 + 10 * i + j, 200 + 10 * i + (j + 1) % 5), (200 + 10 * i + j, 200 + 10 * ((i + 1) % 5) + j)]
    links += [(300 + i, 300 + (i + d) % 7) for i in range(7) for d in (1, 2)] + [(244, 300)]
    # a node that links to itself between two rings is a component of its own
    links += [(401, 402), (402, 401), (402, 403), (403, 403), (403, 404), (404, 405), (405, 404)]
    assert found(spark, links + links[:30]) == plain(links)


def test_small_cases(spark):
    assert found(spark, [(1, 2), (2, 3)]) == {}
    assert found(spark, [(1, 2), (2, 1)]) == {1: 1, 2: 1}
    links = spark.createDataFrame([(1, None), (None, 1), (None, None), (2, 2)], "source long, target long")
    assert [tuple(r) for r in cycles.components(links).collect()] == [(2, 2)]
    assert cycles.components(links.where("source = 9")).collect() == []


def test_rounds_on_long_chains(spark, monkeypatch):
    """Chain, ring and binary tree of 10,000 links take rounds like their logarithm, not like their length."""
    rounds, inner = [], cycles._degrees
    monkeypatch.setattr(cycles, "_degrees", lambda links: rounds.append(1) or inner(links))
    size = 10_000
    links = [(i * 7919 % size, (i + 1) * 7919 % size) for i in range(size)]
    links += [(size + i * 7919 % size, size + (i + 1) * 7919 % size) for i in range(size - 1)]
    links += [(3 * size + i, 3 * size + i // 2) for i in range(1, size)]
    assert found(spark, links) == {i: 0 for i in range(size)}
    assert len(rounds) <= 40


def test_trees_are_trimmed_before_degrees_are_counted(spark):
    """What only leads to a cycle or away from it goes by semi-joins that at least halve the links."""
    from lodegraph.operators import cycles

    rows = [(f"o{i}", f"p{i % 20}") for i in range(200)] + [(f"p{i}", "a") for i in range(20)]
    rows += [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("a", "b")]
    links = spark.createDataFrame(rows, "s string, t string")
    assert {tuple(r) for r in cycles._trimmed(links).collect()} == {("a", "b"), ("b", "a"), ("b", "x"), ("x", "y")} - {("x", "y")}
    found = cycles.components(links.toDF("source", "target"))
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a")}
