import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
LINE = "a line of more than forty characters that many documents share"

#: Nulls, empty and very long texts, ties, repeated rows, and columns named like those inside operators.
EDGES = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", "s", 0, "x", 1),
    (3, LONG, "en", "s", len(LONG), "x", 1),
    (4, LINE, "en", "s", 3, "x", 1),
    (4, LINE, "en", "s", 3, "x", 1),
    (5, f"{LINE}\nown words here\n{LINE.upper()}  ", "de", None, 3, "x", 1),
    (6, f"one two three\r\n{LINE}\n", None, "s", 3, "x", 1),
    (7, f"{LINE}\n\n", "fr", "t", 3, None, None),
    (None, f"{LINE}\nno id", "fr", "t", 3, None, None),
    (None, None, None, None, None, None, None),
    (8, " \t\n ", "fr", "t", 3, "x", 1),
    (9, "É日本 \U0001f642 ß x", "fr", "t", 3, "x", 1),
    (10, "É日本 \U0001f642 ß x", "fr", "t", 3, "x", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids int"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
