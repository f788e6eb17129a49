import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, a very long one, repeats, a clash."""
    long = " ".join(f"word{i} and some more of it" for i in range(20_000))
    rows = [
        (1, "The cat sat on the mat and looked at the door for a while.", "en", "a"),
        (1, "The cat sat on the mat and looked at the door for a while.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n\x0b\x0c\r ", "en", "b"),
        (None, "a null id with ▁ blank marks  and two blanks", "en", None),
        (5, long, "en", "a"),
        (6, "***&&& ### \u0001 \u0002 <|> %%%", None, "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "'x' as score", "1 as kept", "'y' as node", "2 as n_words", "'z' as __text"
    )


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
