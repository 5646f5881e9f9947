"""Anchored windows against a plain loop; streams against batches."""

import datetime
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.streaming import anchored, jobs

START = datetime.datetime(2024, 1, 1)


def loop(rows, width):
    """The counting rule, hit by hit."""
    state, out = {}, {}
    for key, seconds, number in sorted(rows, key=lambda r: (r[1], r[2])):
        start, count = state.get(key, (None, 0))
        if start is None or seconds - start >= width:
            start, count = seconds, 0
        state[key] = (start, count + 1)
        left = width - (seconds - start)
        out[number] = (count + 1, max(1, -int(-left // 1)))
    return out


def frame(spark, rows):
    data = [(k, START + datetime.timedelta(seconds=s), n) for k, s, n in rows]
    return spark.createDataFrame(data, "key string, ts timestamp, n long")


def counted(df, width, chunk=None):
    hits = anchored.anchored_hits(df, "key", "ts", "n", width, F.shiftright("n", 3), chunk=chunk)
    return {r.n: (r.hit_count, r.reset_seconds) for r in hits.collect()}


def test_literal_window(spark):
    rows = [("a", s, i) for i, s in enumerate((0, 9, 10, 11, 30))]
    got = counted(frame(spark, rows), 10)
    assert [got[i][0] for i in range(5)] == [1, 2, 1, 2, 1]
    assert [got[i][1] for i in range(5)] == [10, 1, 10, 9, 10]


@pytest.mark.parametrize("width,chunk", [(10, 20), (10, 1000), (60, 50), (7, 7)])
def test_against_loop(spark, width, chunk):
    rng = random.Random(width)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(900) / 2, i) for i in range(500)]
    assert counted(frame(spark, rows), width, chunk) == loop(rows, width)


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_hot_key_over_several_levels(spark, monkeypatch, fan):
    """A key with most hits, in many chunks of less than a window: the tree has several levels."""
    monkeypatch.setattr(anchored, "FAN", fan)
    rng = random.Random(fan)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(4000) / 4, i) for i in range(800)]
    assert counted(frame(spark, rows), 17, 6) == loop(rows, 17)


def test_hot_key_is_spread(spark, monkeypatch):
    """No task composes, or runs through, more than one node's children."""
    monkeypatch.setattr(anchored, "FAN", 4)
    size = 300
    entries = spark.range(size).selectExpr(
        "'hot' AS _key", "id AS _node", "id * 10 AS _entry", "id * 10 + 15 AS _exit"
    )
    found = anchored.entry_values(entries, None, 15, size)
    dealt = re.findall(r"hashpartitioning\((.*?)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and all("_parent" in columns or "_node" in columns for columns in dealt)
    state, want = -1, {}
    for node in range(size):
        want[node] = state
        if node * 10 >= state:
            state = node * 10 + 15
    assert {r["_node"]: r["_open"] for r in found.collect()} == want


def serial(state, *functions):
    for entry, ends in functions:
        at = int(np.searchsorted(entry, state))
        state = int(ends[at]) if at < len(entry) else state
    return state


def test_composition_equals_application():
    """Composed functions of random chunks give what one after the other gives, for every state that can occur."""
    rng = random.Random(8)
    for _ in range(300):
        width, span = rng.randint(1, 40), rng.randint(1, 30)
        functions = []
        for chunk in range(rng.randint(2, 6)):
            times = np.array(sorted(rng.sample(range(chunk * span, (chunk + 1) * span), rng.randint(1, span))))
            entry, ends = times, []
            for t in times:
                opened = t
                while True:
                    later = times[times >= opened + width]
                    if not len(later):
                        break
                    opened = later[0]
                ends.append(opened + width)
            functions.append((entry, np.array(ends)))
        whole = functions[0]
        for other in functions[1:]:
            whole = anchored.composed(whole, other, width)
        first = int(functions[0][0][0])
        for state in (-1, *range(first, first + width)):
            assert serial(state, whole) == serial(state, *functions)


def test_no_hits_and_nulls(spark):
    df = frame(spark, [("a", 1, 1)]).unionByName(frame(spark, [(None, 2, 2)])).selectExpr("*", "1 AS x")
    assert counted(df, 10) == {1: (1, 10)}
    assert counted(df.where("n > 5"), 10) == {}


def test_stream_of_several_batches_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted([(f"k{rng.randrange(4)}", rng.randrange(400), i) for i in range(200)], key=lambda r: (r[1], r[2]))
    # the tie order of equal times must agree with arrival
    rows = [(k, s, i) for i, (k, s, _) in enumerate(rows)]
    source = tmp_path / "in"
    for i in range(0, 200, 50):
        frame(spark, rows[i : i + 50]).coalesce(1).write.mode("append").parquet(str(source))
    stream = (
        spark.readStream.schema("key string, ts timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(source))
    )
    out = str(tmp_path / "out")
    jobs.count_hits(stream, "key", "ts", "n", 30, F.shiftright("n", 3), out).awaitTermination()
    got = {r.n: (r.hit_count, r.reset_seconds) for r in spark.read.parquet(f"{out}/hits").collect()}
    assert got == loop(rows, 30)


def test_ingest_drops_replays_and_reports_conflicts(spark, tmp_path):
    schema = "k string, v string, e string"
    source = tmp_path / "in"
    batches = [[("a", "1", "x"), ("b", "1", "x"), ("a", "1", "y")], [("a", "1", "x"), ("c", "2", "z")], [("b", "9", "x")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "out")
    jobs.ingest_facts(stream, ["k"], ["v"], ["e"], out).awaitTermination()
    found = jobs.ingested(spark, out, ["k"])
    assert sorted((r.k, r.v) for r in found["facts"].collect()) == [("a", "1"), ("c", "2")]
    assert [r.k for r in found["conflicts"].collect()] == ["b"]
    assert sorted((r.k, r.e) for r in found["evidence"].collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")]


def test_ingest_does_not_depend_on_the_cuts(spark, tmp_path):
    """A key that conflicts stays so when it comes again; null keys and scalars are values."""
    schema = "k string, v string, e string"
    rows = [("a", "1", "x"), ("a", "2", "y"), ("a", "1", "x"), (None, "1", "x"), (None, "1", None), ("n", None, "x"), ("n", "1", "x"), ("o", "1", "x")]
    results = []
    for i, cut in enumerate((1, 3, 8)):
        source, out = tmp_path / f"in{i}", str(tmp_path / f"out{i}")
        for at in range(0, len(rows), cut):
            spark.createDataFrame(rows[at : at + cut], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        jobs.ingest_facts(stream, ["k"], ["v"], ["e"], out).awaitTermination()
        found = jobs.ingested(spark, out, ["k"])
        parts = (found["facts"].select("k", "v"), found["conflicts"].select("k"), found["evidence"].select("k", "e"))
        results.append([sorted(map(str, x.collect())) for x in parts])
    assert results[0] == results[1] == results[2]
    assert len(results[0][0]) == 2 and len(results[0][1]) == 2 and len(results[0][2]) == 6


def test_over_budget(spark):
    hits = spark.createDataFrame([("ai", 21), ("ai", 20), ("x", 121)], "class string, hit_count long")
    rows = anchored.over_budget(hits, "class", {"ai": 20}, 120).collect()
    assert [r.over_budget for r in rows] == [True, False, True]


def ingest(spark, tmp_path, batches, schema, name):
    """The batches as one file each, one file to a micro-batch; and the rows that each query reported to read."""
    source, out = tmp_path / f"in-{name}", str(tmp_path / f"out-{name}")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    running = jobs.ingest_facts(stream, ["a", "b"], ["v", "w"], ["e"], out)
    running.awaitTermination()
    found = jobs.ingested(spark, out, ["a", "b"])
    return {k: sorted(map(tuple, d.collect()), key=repr) for k, d in found.items()}, running.queries


def expected(rows):
    first, clash, spans = {}, set(), set()
    for a, b, v, w, e in rows:
        if first.setdefault((a, b), (v, w)) != (v, w):
            clash.add((a, b))
        spans.add((a, b, e))
    counts = Counter((a, b) for a, b, *_ in rows)
    facts = [(*k, *x, counts[k]) for k, x in first.items() if k not in clash]
    return {"facts": sorted(facts, key=repr), "evidence": sorted(spans, key=repr), "conflicts": sorted(clash, key=repr)}


SCHEMA = "a string, b long, v long, w timestamp, e string"


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_ingest_does_not_depend_on_batches(spark, tmp_path, cut):
    """Null keys and scalars, numbers beyond doubles, replays, and a hot key."""
    rng = random.Random(1)
    rows = []
    for i in range(210):
        a, b = ("hot", None) if rng.random() < 0.4 else (rng.choice(["x", None, ""]), rng.randrange(12))
        v = 2**60 + (b or 0) if rng.random() < 0.97 else None
        rows.append((a, b, v, START if rng.random() < 0.99 else None, rng.choice(["e1", "e2", None])))
    rows += rows[:50]
    found, _ = ingest(spark, tmp_path, [rows[i::cut] for i in range(cut)], SCHEMA, cut)
    # which content came first matters only for facts without conflict, and these have one content
    assert found == expected(rows)


def test_ingest_reads_a_batch_once(spark, tmp_path):
    """A later batch reads its own rows, not those of the batches before."""
    batches = [[("k", i, 1, START, f"e{i}") for i in range(n, n + 40)] for n in range(0, 400, 40)]
    _, queries = ingest(spark, tmp_path, batches, SCHEMA, "cost")
    for query in queries:
        reads = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        assert len(reads) == 10 and set(reads) == {40}


def test_ingest_goes_on_after_a_stop(spark, tmp_path):
    """A second run takes up the state of the first one."""
    schema, source, out = "k string, v string, e string", tmp_path / "in", str(tmp_path / "out")
    for rows in ([("a", "1", "x"), ("b", "1", "x")], [("a", "2", "x"), ("b", "1", "y"), ("b", "1", "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.ingest_facts(stream, ["k"], ["v"], ["e"], out).awaitTermination()
    found = jobs.ingested(spark, out, ["k"])
    assert [tuple(r) for r in found["facts"].collect()] == [("b", "1", 3)]
    assert [r.k for r in found["conflicts"].collect()] == ["a"]
    assert found["evidence"].count() == 3
