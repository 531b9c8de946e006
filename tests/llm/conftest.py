import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"

# Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "one two three four", None, None, None),
    (3, "one two three four", None, None, None),
    (4, "one two three four", "en", "", 18),
    (None, "five six\nseven eight nine ten", "en", "b", 5),
    (None, None, None, None, None),
    (5, " \t\n ", "en", "b", 4),
    (6, "word " * 50_000, "en", "b", 250_000),
    (7, "x" * 200_000, "en", "a", 200_000),
    (8, "Ünïcode — 東京   étude I'll <|endoftext|> don't 12,5%", "fr", "c", 20),
]

# Names that operators might use inside.
CLASHING = (
    "size start row key words hash place score _score _n _keep _leaked _id _row _copy _times "
    "text_hash taken leaf member label rank slot block chunk n id removed first host rule verdict"
).split()


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
