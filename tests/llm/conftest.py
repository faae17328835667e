import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = ["", None, " ", "\n\n", "a", "A", "one two", "same text here", "same text here", "x" * 30_000, "word " * 9_000, "tab\tand\x0bfeed\x0cand  two  spaces ", "▁literal▁ <|endoftext|> </s>", "日本語テキスト ñandú 😀 é", "\x00\x01 nul", "it's 12 o'clock, isn't it?\r\n  yes \n "]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empties, long texts, ties, a repeated row and a column with a clashing name."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[7], (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "'x' as sample")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
