import os

import pandas as pd
import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(os.path.join(sf, "documents.parquet"))


@pytest.fixture(scope="session")
def pdocs(sf):
    return pd.read_parquet(os.path.join(sf, "documents.parquet"))


@pytest.fixture(scope="session")
def vocab():
    from skarn.llm.queries import vocabulary_path

    return vocabulary_path()


#: Nulls in every column, empty and white texts, ties, repeated rows, a very long text, and clashing names of columns.
LONG = "Wort " * 30_000 + "x" * 20_000
ODD = [
    (1, None, None, 1, "a", 1, None),
    (2, "", "en", 1, "b", 2, "x"),
    (3, " \t\n\x0b ", "en", None, None, None, "x"),
    (4, "one two three four five six seven eight nine ten eleven twelve", "en", 1, "c", 3, "y"),
    (5, "one two  three four five\nsix seven eight nine ten eleven twelve", None, 1, "c", 3, "y"),
    (5, "one two  three four five\nsix seven eight nine ten eleven twelve", None, 1, "c", 3, "y"),
    (None, "one two three four five six seven eight nine ten eleven twelve", "fr", 2, "d", 4, "z"),
    (None, "a text of its own, with É and 日本 and <|endoftext|> in it", "fr", 2, "d", 4, "z"),
    (8, LONG, "de", 9, "e", 5, "z"),
    (9, "  ", "de", 9, "e", 5, "z"),
    (10, "a", "xx", 9, "e", 5, "z"),
    (11, "a", "xx", 9, "e", 5, "z"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, group_size int, source string, n long, key string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
