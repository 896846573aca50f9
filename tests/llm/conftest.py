"""Documents with the awkward cases that every operator must take: nulls, blanks, long texts, repeats, clashing names."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHES = ("fp", "key", "tag", "words", "length", "row", "score", "labels", "base", "spans", "bytes", "piece", "ids",
           "kept", "rank", "n", "root", "component_id", "lang_pred", "held_out", "found", "place", "__found")

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, and the dog sleeps on the mat all day."),
    (2, None), (3, ""), (4, "  \n\t \n"), (5, "12345 67890 !!"), (None, "A row without an id has words too."),
    (6, "The quick brown fox jumps over the lazy dog, and the dog sleeps on the mat all day."),
    (7, "word " * 30000), (8, "tie tie tie"), (8, "tie tie tie"), (9, "é ñ 日本語 😀 ß" * 40),
    (10, "Mail a.b@c.org or call +1 (375) 555-4393 from 10.0.0.1. MIT License."),
]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
