import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text, lang) as a documents table."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCUMENT)

    return make


@pytest.fixture(scope="session")
def clashing():
    """df with columns that clash with one another and with what operators call theirs."""
    from pyspark.sql import functions as F

    def make(df):
        return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("TEXT", "Doc_Id", "media", "node", "f0", "kept", "c0", "count", "token", "a.b", "rank"))])

    return make


@pytest.fixture(scope="session")
def oddities():
    """Texts that break careless code, with ids: null, empty, white space, marks, ties and repeats."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
    many = [None, "", " \t\n\x0b\x0c\r ", "a", "A a\x00b", "é\u0301 ﬁ İ Σ ς", "日本語 🎉👍🏽", "<|endoftext|> x <|startoftext|>", "it's we'll ''s 'r", "x" * 70_000, " " * 9_000 + "y", "\n".join(["same line here"] * 40), long, "%%% ### $$$"]
    return [(i, t, "en") for i, t in enumerate(many)] + [(3, "a", "en"), (3, "a", "en"), (None, "no id", None), (40, "a", None)]
