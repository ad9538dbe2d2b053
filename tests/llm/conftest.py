import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[1])]

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Extra columns whose names the operators use inside.
        T.StructField("n", T.LongType()),
        T.StructField("_uid", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("ids", T.LongType()),
    ]
)

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

#: doc_id, text: nulls, empty and very long texts, ties, repeated rows, repeated ids, near and exact copies, shared passages.
ROWS = [
    (1, "alpha beta gamma delta " * 30),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, LONG),
    (6, LONG),
    (7, "One two  three\nfour.\n\nFive, six!! <|endoftext|> don't\x00stop"),
    (8, f"before {PASSAGE} after the passage"),
    (9, f"Something else comes first here. {PASSAGE}"),
    (9, "the same id, another text"),
    (10, "a repeated row"),
    (10, "a repeated row"),
    (None, "no id at all"),
    (None, None),
    (11, "A Repeated Row"),
    (12, " ".join(f"near{i}" for i in range(200))),
    (13, " ".join(f"near{i}" for i in range(199)) + " changed"),
    (14, "word"),
    (15, "x" * 5000),
    (16, "ä ö ü ß 中 文 \U0001f600 é"),
]


def rows(pairs):
    return [(i, t, "en", "s", None if t is None else len(t), 5, "u", 7, 8) for i, t in pairs]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(ROWS), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
