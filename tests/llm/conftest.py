import pytest

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, None),
    (3, ""),
    (4, "  two  spaces\n\n and\ttabs  "),
    (4, "  two  spaces\n\n and\ttabs  "),
    (None, "a row without a key"),
    (5, "▁marks▁ and 　 spaces of other kinds\x1c\x00"),
    (6, "<|endoftext|> <s> </s> special strings"),
    (7, "été naïve 漢字 🙂🙂 ñandú ½ ²"),
    (8, "x" * 3000),
    (9, "word " * 30_000),
    (10, "!!! ... ???"),
    (11, "It's the dogs' and we'll see, they'd've"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null keys and texts, empty and long texts, repeated rows, and other columns with clashing names."""
    schema = "doc_id long, text string, n_tokens string, ids string, key string, score string, lang string"
    return spark.createDataFrame([(i, t, "x", "y", "z", "w", "en") for i, t in EDGES], schema)


@pytest.fixture(scope="session")
def edges():
    return EDGES


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/written"
