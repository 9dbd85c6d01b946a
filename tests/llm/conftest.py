import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def document(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text))


#: Every awkward row: null id, null text, null in other columns, empty, blank, no words, very long, repeated, tied.
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
AWKWARD = [
    document(1, "A plain sentence of some words, nothing else in it."),
    document(1, "A plain sentence of some words, nothing else in it."),
    document(2, "A plain sentence of some words, nothing else in it."),
    document(3, None),
    document(3, None),
    document(None, "Text without an id, but with words."),
    document(None, "Text without an id, but with words."),
    (4, "", None, None, None),
    document(5, ""),
    document(6, "   \n\t "),
    document(7, "!!! ... ???"),
    document(8, LONG),
    document(9, "x" * 50_000),
    document(10, "日本語 текст ελληνικά 😀 é   end"),
    document(-5, "negative id"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """With columns whose names operators use themselves."""
    rows = [(*r, "x", 0.5, "k", 1, "b", None, 2, "r", "f", 3) for r in AWKWARD]
    return spark.createDataFrame(rows, DOCS + ", id string, score double, key string, `__key` long, a string, b string, part int, row string, f0 string, v int").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOCS)
