import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that the operators use."""
    long = " ".join(f"word{i % 97} und{i}" for i in range(60_000))
    texts = ["", None, "a", "Hello there, this is one text that two rows hold.", "Hello there, this is one text that two rows hold.", long, "퟿ é 中 😀 " * 50, " \n\t ", "x" * 5000, long[:4000]]
    rows = [(i, t, "en", "s", len(t or ""), "l", "k", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], (5, "another text under an id that is there", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 0, 0), (2, 1, 0), (3, None, 1), (4, 1, 1), (4, 0, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
