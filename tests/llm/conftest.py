import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk long, digest string, sha string, bin int, salt int, rank int, path string, ids string, n_tokens string, keep_id string, at int, component_id string, word string, spans string, kept string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = "alpha beta gamma delta epsilon " * 4000
    odd = "Grüße aus Köln\x0b\x1c! <|endoftext|> don't\t中文 ΟΔΟΣ éa 😀"
    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, ""), (6, long_text), (7, odd), (8, odd), (8, odd), (9, "x" * 30000), (10, "   \n\t "), (11, "12 34 -- !!"), (None, "one two three four five six seven"), (None, None), (12, "a b"), (13, "a b")]
    data = [(i, t, "en" if (i or 0) % 3 else None, None, None, 5, "d", None, 1, 2, 3, "p", "i", None, "k", 4, "c", "w", "s", "x") for i, t in rows]
    return spark.createDataFrame(data, EDGE_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
