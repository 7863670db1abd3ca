import pytest

#: Names that operators use inside or return: an input may carry them all.
CLASHES = ("id", "key", "size", "row", "fp", "score", "rows", "found", "value", "kind", "taken", "mask", "mark",
           "shard", "slot", "component_id", "fingerprint", "label", "toxic", "held_out", "license", "dir")

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 4000


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, source): null and empty texts, blanks, a long text, ties, repeated rows, a null id."""
    return [
        (1, "one two three four five six", "b"), (1, "one two three four five six", "b"),
        (2, None, "a"), (3, "", None), (4, " \t\n ", "a"), (5, LONG, "c"), (6, "ONE two Three four five six", "b"),
        (None, "no id here at all", "a"), (8, "é😀 ünï 中文 words", None), (9, "x" * 5000, "c"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    clash = ", ".join(f"'clash' AS {c}" for c in CLASHES)
    rows = [(i, t, s, None, None) for i, t, s in edge_rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return frame.selectExpr("*", *clash.split(", "))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
