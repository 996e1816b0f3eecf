import pyarrow.dataset as ds
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts(sf_dir):
    """{doc_id: text} of the small table."""
    t = ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, white space alone, repeated rows, one very long text, and columns whose names clash with those that operators make."""
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "a b c d", "en", "a", 7), (4, " \t\n\x0b\x0c\r ", "en", None, 7), (5, "a b c d", "en", "a", 7), (5, "a b c d", "en", "a", 7), (6, long, "en", "b", len(long)), (7, "Ünï çödé 中文 \U0001f600 ﬁ <|endoftext|>", "fr", "b", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("key", "word", "fp", "hash", "n", "rank", "root", "size", "host", "label", "start", "_words", "kept", "arc", "pos", "position"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
