"""Rows that every operator has to cope with."""

import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORDS = "the quick brown fox jumps over a lazy dog while seven grey geese walk slowly past an old stone mill".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i + seed * i + seed) % len(WORDS)] + str((i * 7 + seed * 13) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = prose(30_000, 3)
    texts = [
        (1, prose(120, 1)), (2, prose(120, 1)), (2, prose(120, 1)), (3, None), (4, ""), (5, "  \t\n "), (6, "x"),
        (7, long), (8, long + " end"), (9, long), (10, "päß ü€𝕏 日本語 ́ " * 20), (11, "=" * 5000), (12, prose(120, 1).replace(" ", "  ")),
        (None, prose(40, 2)), (None, None), (None, prose(120, 1)), (13, prose(200, 4)),
    ]
    return [(i, t, None if i == 6 else "en", None if i == 7 else "s", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def clashing(df):
    """The same rows with columns named like those that operators use."""
    from pyspark.sql import functions as F

    names = "id uid kept keep_id group_size text_sha256 fp fingerprint component_id root base spans cands score predicted held_out part rank length ids recipe __sha __id lots sig"
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names.split())])


@pytest.fixture(scope="session")
def clash():
    return clashing
