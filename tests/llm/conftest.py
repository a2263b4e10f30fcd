import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, block int, bucket string, key string, score string, copy int, words string, component string, n int"


def rows_of(texts, source="src0"):
    return [(k, t, "en", source, len(t or ""), *[None] * 10) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents, with columns whose names operators use inside."""
    def make(rows):
        return spark.createDataFrame([tuple(r) + (None,) * (15 - len(r)) for r in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def messy(documents):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "word other thing stone river " * 20_000
    prose = "The quiet river and the old stone house of the miller were on that side of the hill. " * 3
    return documents([
        (0, prose, "en", "a", 9), (0, prose, "en", "a", 9), (1, None, None, None, None), (2, "", "en", "b", 0), (None, prose, None, None, None),
        (None, None, None, None, None), (3, " \n\t ", "fr", "a", 1), (4, long, "en", "b", 1), (5, prose + "!", "xx", "b", 1), (6, "Hi", "de", None, 2),
        (7, "pass<|endoftext|>word's  'tis été \U0001f600 " * 3, "fr", "c", 1), (8, "password: Zx9Qk2LmP4Rt token = abc", "en", "c", 3)])
