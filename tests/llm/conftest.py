import pytest

COPY = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood again and again until night"
LINE = "Subscribe to our newsletter today"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, COPY, "en", "a"),
        (2, COPY, "en", "a"),
        (3, COPY.upper() + "  ", "en", None),
        (4, COPY.replace("lazy", "idle"), None, "b"),
        (5, None, "en", "a"),
        (6, "", None, None),
        (7, "   \n\t ", "de", "a"),
        (8, "short", "de", "b"),
        (None, "short", "fr", "b"),
        (9, "line one\n" + LINE + "\nline two\n", "en", "a"),
        (10, "word " * 30000, "en", "a"),
        (11, "Ünï çödé <|endoftext|> x\u0000y 🎉 it's 12 ½ ٣٤", "es", "c"),
        (11, "Ünï çödé <|endoftext|> x\u0000y 🎉 it's 12 ½ ٣٤", "es", "c"),
    ]
    rows += [(100 + k, f"Unique text number {k} here.\n  {LINE.lower()} \t\nEnd of {k}.", "en", "a") for k in range(12)]
    rows += [(200 + k, f"alpha{k} beta{k} gamma{k} " * (k + 1), "en", f"s{k % 4}") for k in range(20)]
    full = [(*r, k, k, True, 1.0) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long, kept boolean, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
