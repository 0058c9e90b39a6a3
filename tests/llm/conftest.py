import pytest
from pyspark.sql import functions as F

LONG = "Ein langes Wort und noch eins. " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, very long, repeated and tied rows, with columns whose names operators might use inside."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
        (2, "", "en", "a"),
        (3, None, None, None),
        (None, "no id here, but words all the same", "en", "b"),
        (None, "no id here, but words all the same", "en", "b"),
        (4, LONG, "de", "b"),
        (5, "\n\t  ", "en", None),
        (6, "日本語 ünïcode 😀 it's we're", "xx", "c"),
        (7, "z" * 5000, "en", "c"),
    ]
    names = ["score", "Rate", "copies", "_copies", "_mark", "_mark_", "_found", "key", "f", "a", "b", "root", "node", "w", "t", "c0", "m0", "k0", "id", "mark", "bad", "n_tokens", "n.dots"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
