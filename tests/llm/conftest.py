import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, size string, score string, __score int"
WORDS = "the quick brown fox jumps over a lazy dog while rain falls on old stone walls near the river bank today".split()


def row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text), 7, "size", "score", 1)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and white-space texts, a very long text, equal and repeated rows, clashing column names."""
    long_text = " ".join(f"{w}{i % 997}" for i in range(3000) for w in WORDS)
    some = [row(i, " ".join(WORDS[j % 20] + str(i * j % 7) for j in range(30 + i)), "abc"[i % 3]) for i in range(40)]
    odd = [
        row(100, None), row(101, ""), row(102, " \n\t "), row(None, "no id here", None), row(None, None, None),
        row(103, "same text"), row(103, "same text"), row(104, "same text", None), row(105, long_text, "z"),
        row(106, "<|endoftext|> 你好 \U0001f600 é", "c"), row(107, "one"), row(108, "X" * 50_000),
    ]
    return spark.createDataFrame([*some, *odd], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
