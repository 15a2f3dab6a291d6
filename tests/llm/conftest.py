import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def llm_duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, ids used twice, columns
    with the names that the operators use inside."""
    long = " ".join(f"Word{i % 977} goes on and on." for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta. " * 8, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t\n ", "en", "b"),
        (5, long, "en", "hot"), (6, long, "en", "hot"), (7, "one", "en", "hot"), (7, "one", "en", "hot"),
        (8, "same id, first text here", "en", "c"), (8, "same id, other text there", "en", "c"),
        (None, "no id at all", "en", "c"), (None, None, None, None), (9, "Éa ñ 日本語 ✨ <|endoftext|> </s> \x01\x02", "fr", "d"),
        (10, "a\nb\nc\n\n\nd  e   f\n", "en", "d"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    clash = ["fp", "id", "score", "stats", "kept", "__rules", "__score", "__id", "__th", "__cuts", "__row", "n_lines", "h1", "lines"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
