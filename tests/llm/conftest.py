import pytest

#: Texts that every operator on documents must handle.
ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "two words",
    "The same line of text that is long enough to count.\nThe same line of text that is long enough to count.\nmore",
    "The same line of text that is long enough to count.\nother",
    " ".join(f"word{i % 9000}" for i in range(30_000)),
    "emoji \U0001f600 and 中文字符 and ﬁne   spaces\x1c\x0b\x0c<|endoftext|> end",
    "a" * 50_000,
    "x\n" * 500,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash."""
    rows = [(i, t, "en", "s1", 7, True, "w") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "no id here " * 20, None, None, None, None, None), (-3, "below zero " * 30, "fr", None, 1, False, "k")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean, stats string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
