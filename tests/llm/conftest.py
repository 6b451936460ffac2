import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHES = "digest string, spans string, fp string, key string, slice int, component string, n long, start long, cell string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text) pairs, with extra columns of clashing names."""

    def documents(rows):
        extra = [None] * len(CLASHES.split(","))
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *extra) for i, t in rows], f"{DOCUMENTS}, {CLASHES}")

    return documents


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


#: Rows that every operator must bear: nulls, empty and blank texts, repeats, a long text.
ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, "x " * 60_000), (7, "é ü 日本 🙂")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
