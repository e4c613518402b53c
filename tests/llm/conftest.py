import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997} of the v{i}" for i in range(20_000))
PROSE = " ".join(f"the {a} word of {b} and so on." for a, b in zip("abcdefghijklmnop", "qrstuvwxyzabcdef", strict=True))
EDGE = [
    (None, None, None, None, None),
    (1, "", "en", "s1", 0),
    (2, " \t\n\r\x0b\x0c ", "en", None, 8),
    (3, "word", None, "s1", 4),
    (4, LONG, "en", "s2", len(LONG)),
    (5, PROSE, "en", "s1", 1),
    (5, PROSE, "en", "s1", 1),
    (6, PROSE, "fr", "s2", 1),
    (None, PROSE, "fr", "s2", 1),
    (7, "ünïcödé wörds ß 中文 🙂 a b", "de", "s3", 1),
    (8, "12345 67890", "de", "s3", 1),
]
#: Names that operators use inside or return.
CLASHING = ("n_words", "size", "node", "class_id", "taken", "label", "band", "score", "lang_pred", "kept", "_w", "_doc", "_text", "source_size", "target", "epochs", "hub", "words", "grams", "_key", "_any")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
