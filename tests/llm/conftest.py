import pytest

#: Texts at the edges: null, empty, blank, short, repeated, long.
LONG = "palabra larga con muchas letras y más " * 3000


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, repeated rows, ties, a very long text, and extra columns with the operators' own names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "no id here at all"), (5, LONG), (6, LONG.upper()), (7, "é" * 50), (8, "a b c d e f g h"), (9, "a b c d e f g h")]
    made = [(i, t, "en", "src", 5, "x", 0.5, 1, "k") for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, rank int, digest string")


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
