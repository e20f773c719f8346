import pytest

from cohorta.llm.tokenizer import public_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def vocab():
    return public_path


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows."""
    prose = ("the and of that with from this was for are by in it is on as be not or at "
             "Thonded ertion shing wher eston ander thing ouning, blest reand.")
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [(1, prose, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 4),
            (5, long, "en", "a", len(long)), (6, prose, "en", "a", 1), (6, prose, "en", "a", 1), (None, prose, None, "b", 1),
            (None, None, None, None, None), (7, "?? !! ...", "en", "a", 9), (8, "x" * 50_000, "en", None, 50_000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), DOCS)
    for name in ("node", "kept", "score", "row", "doc", "n_words", "key", "task", "length"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
