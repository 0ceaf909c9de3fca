import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, fingerprint string"


def rows(texts):
    return [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, True, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties and copies; columns that operators use as names of their own."""
    long = " ".join(f"word{i % 977} the of" for i in range(40_000))
    texts = [None, "", "   \n\t ", "one", "the quick brown fox jumps over the lazy dog", "the quick  brown\nfox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog <|endoftext|>!", "12 34 ###", long, long + " x", "", "ñandú élan über\x85　z", "a b c d e f g h i j k l m n"]
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
