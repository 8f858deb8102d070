import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample(spark):
    """Real documents, few enough for brute force."""
    return spark.read.parquet(f"{SF}/documents.parquet").limit(150).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, long texts, ties, repeated rows, and columns named as the operators name theirs."""
    word = "moron " * 3 + "plain words of a text that goes on for more than one hundred bytes so that it can repeat itself elsewhere too "
    rows = [
        (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, word, "en"), (5, word.upper(), "de"), (6, word.replace(" ", "\n"), None), (7, word, "en"), (7, word, "en"),
        (None, word, "en"), (None, None, None), (8, "x", "fr"), (9, "Grüße 😀 ▁   end. Released under the MIT License.", "de"), (10, (word + "tail ") * 3000, "en"), (11, "a" * 5000, "en"), (12, "mail bob@example.com, +1 (171) 555-2028, 4111 1111 1111 1111, 10.0.0.1", "en"),
    ]
    names = "digest hash body key node ring bucket records marks doc at kind score held_out ids _at _digest _kept _gone keep_id kept y near hits lang2 _l _v"
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names.split()}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


def texts(df):
    """doc_id, text of every row, null as empty."""
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
