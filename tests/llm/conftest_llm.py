"""Helpers of these tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, line string, seed long, word string"


def documents(spark, pairs):
    """Documents of (doc_id, text), with columns whose names clash with what the operators use inside."""
    rows = [(d, t, "xx", "s", None if t is None else len(t), 1, "l", 2, None) for d, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    return (text or "").encode().split()
