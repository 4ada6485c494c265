import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, taken string, uid string, key string, th string, score string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents from ``(doc_id, text[, source[, lang]])``, with extra columns whose names operators use inside."""

    def make(rows):
        full = []
        for doc_id, text, *more in rows:
            source, lang = (*more, *(["s", "en"][len(more) :]))
            full.append((doc_id, text, lang, source, len(text or ""), "r", 1, "t", "u", "k", "h", "s"))
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion of forgotten herbs under the old stone bridge near town"
ODD = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "  \n "), (None, PROSE + " x"), (6, "one two"), (7, "ÄÖ 漢字 😀 é"), (8, "x" * 50_000),
    (9, "word " * 20_000), (10, PROSE, None), (11, PROSE, "s", None), (12, PROSE.upper()),
]


@pytest.fixture(scope="session")
def odd(corpus):
    return corpus(ODD)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
