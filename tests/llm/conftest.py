import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("row", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("fp", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (doc_id, text) rows, with extra columns of clashing names."""

    def make(rows, partitions=2):
        full = [(i, t, "en", None, None if t is None else len(t), "r", None, "x") for i, t in rows]
        return spark.createDataFrame(full, DOCS).coalesce(partitions)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "word " * 30000 + "user@host.example.com token = abcdef0123456789abcdef0123 " + "x" * 50000
    return make_docs([(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "no id at all"), (None, None)])


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def save(tmp_path_factory):
    """A folder with documents.parquet (and others) as the queries read it."""

    def folder(**tables):
        base = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{base}/{name}.parquet")
        return str(base)

    return folder
