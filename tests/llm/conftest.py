import pytest

from tidewater.llm import tables

EN = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strong green tea in tall glass jars near old stone walls"


@pytest.fixture(autouse=True)
def workers_import(spark):
    tables.importable(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, EN, "en", "a", 1), (2, EN, "en", "b", 2), (2, EN, "en", "b", 2), (3, None, "en", "a", 3), (4, "", None, None, None), (5, "   \n\t ", "en", "a", 4),
        (6, "one two", "en", None, 5), (7, "one two", "en", "a", 6), (8, long, "en", "a", 7), (9, long + " tail", "en", "c", 8), (None, EN + " extra", "en", "a", 9),
        (10, "café 日本語 \U0001f600 ▁ \x00 end", "fr", "c", 10), (11, "\n\n\n", "en", "a", 11), (12, "x" * 5000, "en", "a", 12),
    ]
    names = "score node part size copies held_out label block source_size target counts taken feature nth n_copies".split()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", *[f"cast({i} as int) as {n}" for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.where("false")
