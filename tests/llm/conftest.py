import pytest
from pyspark.sql import functions as F

LONG_WORDS = 60_000


def edge_rows():
    """Null and empty texts, white space, one word, repeated rows, a null id, clashing ids and a very long text."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards box with one another near the old mill at dawn today "
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(LONG_WORDS))
    return [
        (900001, None, None, None, None),
        (900002, "", "en", "s", 0),
        (900003, " \t\n ", "en", None, 3),
        (900004, "Alone", None, "s", 5),
        (900005, base * 3, "en", "s", 1),
        (900005, base * 3, "en", "s", 1),
        (900006, base * 3 + "extra", None, "s", 2),
        (None, base * 3, "en", "s", 1),
        (None, None, None, None, None),
        (900007, long, "en", "s", len(long)),
        (900008, "Ünïcode ß 中文 пример, licensed CC-BY; General Public License. all RIGHTS reserved cc by cc by", "xx", "s", 9),
        (900009, "\u0000\u0001 a b ퟿ \U0001f600 " + "x" * 5000, "en", "s", 7),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the callers' own that have the names of columns the operators make.
CLASH = ["shard", "slot", "size", "cls", "token", "n_words", "h1", "h2", "score", "kept", "sig", "__arc", "label", "id", "key"]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir, edges):
    """The small documents table and the edge rows."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(edges)


@pytest.fixture(scope="session")
def clashing(docs):
    return docs.withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
