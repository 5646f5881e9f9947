import random

from conftest import EDGES, FOLDER

from lodegraph.llm import queries
from lodegraph.llm.decontaminate import MIN_CHARS, Passages, normal, one_byte, passages_in


def distance(passage, text):
    """Least edits between a passage and a part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i] + [0] * len(text)
        for j, x in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_query_finds_exact_passages(spark, documents):
    items = {r["item_id"]: normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: normal(r["text"]) for r in documents.collect()}
    want = {(d, i) for d, t in texts.items() for i, p in items.items() if len(p) >= MIN_CHARS and p in t}
    rows = queries.op8_decontamination(spark, FOLDER).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["edits"] == 0} == want and want
    for r in rows:
        words = texts[r["doc_id"]].split(" ")[r["start_word"] : r["end_word"] + 1]
        assert r["passage"] in " ".join(words)


def test_edited_passages_as_brute_force(spark):
    draw = random.Random(5)
    items = [normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    passages = Passages(list(enumerate(items)))
    inside = outside = 0
    for _ in range(120):
        n = draw.randrange(len(items))
        signs = list(items[n])
        for _ in range(draw.randrange(0, int(len(signs) * 0.14) + 1)):
            at, kind = draw.randrange(len(signs)), draw.random()
            if kind < 0.4:
                signs[at] = draw.choice("abcdé日 ")
            elif kind < 0.7:
                del signs[at]
            else:
                signs.insert(at, draw.choice("abcde"))
        other = draw.choice(items)
        text = normal(f"{other[: draw.randrange(len(other))]} {''.join(signs)} {draw.choice(items)[:50]}")
        found = [h for h in passages.find(["x y z", text, ""]) if h[:2] == (1, n)]
        edits = distance(items[n], text)
        assert bool(found) == (edits <= passages.budget[n])
        if found:
            _, _, told, start, end = found[0]
            assert told == edits == distance(items[n], text[start:end])
        inside, outside = inside + bool(found), outside + (not found)
    assert inside > 30 and outside > 10


def test_edges(spark, edges, nothing):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, text, 1), (1, text, 2), (2, None, 1), (3, "", 1), (4, "too short", 1), (None, text.upper(), 1)]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string, doc_id int")
    more = [(20, f"x\n{text.replace(' ', chr(10))} y", None, None, None, None, None), (None, text, *[None] * 5)]
    docs = edges.unionByName(spark.createDataFrame(more, edges.schema))
    found = passages_in(docs, benchmark).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in found) == sorted(
        (d, i) for d in ("20", "None") for i in ("1", "1", "None")
    )
    assert all((r["edits"], r["end_word"] - r["start_word"]) == (0, 11) for r in found)
    assert passages_in(nothing, benchmark).collect() == []
    assert passages_in(edges, benchmark.limit(0)).collect() == []
    assert len(EDGES) == edges.count()


def test_characters_above_one_byte():
    assert one_byte("aé") == b"a\xe9" and len(one_byte("日本\U0001f642")) == 3
    passage = "日本語の文章はここから始まりここで終わりますので探してください"
    assert [h[:3] for h in Passages([(0, passage)]).find([f"xx {passage} yy", passage[:-1] + "め", "語" * 500])] == [
        (0, 0, 0), (1, 0, 1),
    ]
