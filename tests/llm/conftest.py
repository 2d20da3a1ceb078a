import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    rows = [
        (None, None, None, None, None),
        (1, "", "en", "s", 0),
        (2, None, "en", None, None),
        (3, " \t\n ", "en", "s", 4),
        (4, "one two three", "en", "s", 13),
        (4, "one two three", "en", "s", 13),
        (5, "One two\nthree four five six seven " * 3000, "en", "s", 1),
        (6, "é" * 5000, "fr", "s", 5000),
        (7, "x\x1cy\x00z <|endoftext|> it's 100%", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
