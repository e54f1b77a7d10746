import pytest

LONG = "lorem ipsum " * 20_000
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 77),
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 77),
    (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", None, 4), (None, "words without an id but with enough of them to stay in the corpus", None, "b", 64), (None, None, None, "b", None),
    (5, LONG, "en", "b", len(LONG)), (6, "x" * 50_000, "en", "b", 50_000), (7, "ünïcode 日本語 😀 password=abcdef123456789 end", "de", "b", 44),
]
CLASH = ["fp", "fingerprint", "component_id", "root", "node", "word", "tile", "part", "at", "ids", "rid", "rest", "c", "block", "copies", "weight", "src", "row", "pass", "held_out", "score", "n_tokens", "n_words", "kept", "spans", "quality", "x", "a.b", "c`d"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, long texts, repeats, and columns named like those that operators make."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def documents(spark):
    from support import DATA

    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
