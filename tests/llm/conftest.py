"""Small frames with the awkward cases that every operator has to take."""

import pytest

from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Null and repeated ids, null, empty, blank and long texts, repeated rows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()
    long = " ".join(words[(7 * k * k + k) % 19] + str(k % 97) for k in range(60_000))
    return [
        (1, None, "en", None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, "a", 4),
        (4, "one two three four five six seven", "en", "a", 33),
        (4, "one two three four five six seven", "en", "a", 33),
        (None, "one two three four five six seven", None, None, 33),
        (5, "ONE two three four five six seven", "en", "b", 33),
        (6, long, "en", "b", len(long)),
        (7, "123 456 !!!", "de", "c", 11),
        (8, "line one here\nline two here\n\nline one here", "en", "c", 42),
        (9, "é è ê 漢字 🙂 mixed Ünïcode", "fr", "c", 24),
        (10, "word", "en", "c", 4),
    ]


def as_files(spark, tmp_path, rows, schema, name):
    path = f"{tmp_path}/{name}.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def odd(spark, tmp_path, odd_rows):
    return as_files(spark, tmp_path, odd_rows, DOCS, "documents")


@pytest.fixture
def empty(spark, tmp_path):
    return as_files(spark, tmp_path, [], DOCS, "documents_empty")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")
