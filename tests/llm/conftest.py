import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "kept boolean, sequence_id string, rank int, bucket int, mix_block int, lang_pred string, len int")

LOREM = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and a "
         "small river runs by the mill where grain was once ground into flour for all the village people").split()


def prose(n, seed):
    """n words that differ with the seed."""
    return " ".join(f"{LOREM[(i * 7 + seed * i // 3 + seed) % len(LOREM)]}{chr(97 + (i * seed) % 26)}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    base = prose(300, 5)
    texts = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base, "en", None), (4, None, "en", "b"),
        (5, "", None, "b"), (6, "  \t\n ", "fr", "b"), (7, "12 34 -- 56", "fr", "a"), (None, base + " extra", "fr", "a"),
        (None, None, None, None), (8, prose(40_000, 3), "fr", "c"), (8, prose(40_000, 3), "fr", "c"),
        (9, "word " * 500, "de", "c"), (10, "one", "de", "c"), (11, "one two", "de", "c"), (11, "one two", "de", "c"),
        (12, prose(60, 9) + " " + base, "de", "d"), (13, "é" * 50 + "  x y  z", "de", "d"),
        (14, "a\nb\n\nc <|endoftext|> d\r\n", "de", "d"), (15, base.replace("foxh", "fax", 1), "en", "d"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), True, "s", 1, 2, 3, "xx", 4) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
