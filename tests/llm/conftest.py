import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rid long, h long, extra map<string,int>"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source), with extra columns whose names the operators use inside."""

    def build(rows):
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 7, 8, {"a": 1}) for r in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def hard():
    """Nulls in every column, an empty, a blank and a long text, repeated rows, one id with two texts."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    long = " ".join(words[k * k % 8] + str(k % 97) for k in range(6000))
    plain = "Das ist ein Satz mit vielen guten Worten."
    return [
        (1, plain, "de", "a"), (1, plain, "de", "a"), (2, plain + " ", "de", None), (3, "", "de", "a"), (4, None, None, "b"), (None, "the quick brown fox jumps over it", "en", "b"),
        (5, long, "en", "c"), (6, " \t\n", "en", "c"), (7, "a", None, "c"), (8, "the quick brown fox jumps over it", "en", "b"), (8, "another text of the same id", "en", "b"), (-9, "x" * 3000, "en", "d"),
        (None, None, None, None), (10, "naïve <|endoftext|> façade 漢字 \x00 end", "fr", "d"),
    ]
