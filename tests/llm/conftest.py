"""Small documents with the awkward cases that every operator has to stand."""

import pytest
from pyspark.sql import types as T

#: Extra columns whose names clash with those that operators make or use.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("row_key", T.StringType()),
    ]
)

LONG_LINE = " ".join(f"word{i}" for i in range(60))


def rows():
    prose = "The quick brown fox jumps over the lazy dog near the old river bank today."
    very_long = " ".join(f"tok{i % 977} filler{i % 13}" for i in range(30_000))
    texts = [
        (1, prose),
        (2, prose),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, f"Intro one.\n{LONG_LINE}\nOutro."),
        (7, f"Other start.\n{LONG_LINE}\nOther end."),
        (8, very_long),
        (9, "Mail jane.doe+x@mail.example.com or +1 (555) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111.\ntoken = \"9742a250774262d69ad6a86100194ed53da5a0ef\""),
        (10, "Licensed under the Apache License, Version 2.0."),
        (11, "日本語のテキスト 🎉 é ﬁ İstanbul\r\n x"),
        (None, "A row without an id."),
        (12, prose),
        (12, prose),
    ]
    return [(i, t, "en", "src1", len(t) if t is not None else None, "k", "i", "c", "r") for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
