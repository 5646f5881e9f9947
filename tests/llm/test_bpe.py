import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from conftest import EDGES, FOLDER  # noqa: F401
from pyspark.sql import functions as F

from lodegraph.llm import bpe, queries

RANKS = bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY))
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)


def test_random_strings_as_the_library():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(5)
    signs = " \n\t 　ab'sZé1٣,.​日本\U0001f642\r"
    for _ in range(20_000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(14)))
        assert encoder.encode(text) == LIBRARY.encode_ordinary(text)
    for text in ("ab" * 5000, " " * 3000, "x" * 63 + " " + "y" * 64 + " " + "z" * 65):
        assert encoder.encode(text) == LIBRARY.encode_ordinary(text)


def test_short_and_long_folds_agree():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(7)
    for _ in range(500):
        word = bytes(draw.choice(b"abcdeinorst") for _ in range(draw.randrange(65, 90)))
        singles = [encoder.singles[b] for b in word]
        assert encoder.fold(word) == encoder.fold_short(singles)


def test_edges_and_round_trip(edges, nothing):
    ids = bpe.encode(edges, RANKS, public_tokenizers.PATTERN, ["doc_id", "text", "score"])
    rows = bpe.decode(ids, RANKS).collect()
    assert len(rows) == len(EDGES)
    for row in rows:
        assert row["ids"] == LIBRARY.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect() == []


def test_query_as_the_library(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = queries.op2_byte_bpe(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_fold_of_higher_order_functions(spark):
    """A small vocabulary whose merges depend on their order, as columns."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cab", b"aa", b"aab", b"bab"]
    ranks = {token: i for i, token in enumerate(tokens)}
    words = ["".join(random.Random(i).choice("abc") for _ in range(1 + i % 12)) for i in range(80)]
    vocabulary = bpe.Vocabulary(ranks, r"\w+")
    encoder = bpe.Encoder(ranks, r"\w+")
    rows = spark.createDataFrame([(w, list(w.encode())) for w in words], "word string, bytes array<int>")
    ids = vocabulary.using(
        lambda rank, pieces: bpe.let(
            vocabulary.encode(rank, F.col("bytes")),
            lambda ids: F.struct(ids.alias("ids"), vocabulary.decode(pieces, ids).alias("decoded")),
        )
    )
    for row in rows.select("word", ids.alias("x")).collect():
        assert row["x"]["ids"] == encoder.fold_short([encoder.singles[b] for b in row["word"].encode()])
        assert bytes(row["x"]["decoded"]) == row["word"].encode()


def test_incomplete_vocabulary():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Vocabulary({b"a": 0}, r"\w+")
