import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id -> text"""
    return {r["doc_id"]: r["text"] for r in documents.collect()}


# Nulls, empty and blank texts, one very long one, repeated rows, a row without an id, and names that operators use themselves.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two"),
    (5, LONG),
    (6, "The same words stand here twice, for all to see."),
    (6, "The same words stand here twice, for all to see."),
    (7, "The same words stand here twice, for all to see."),
    (None, "nobody's text with password=hunter2000 in it"),
    (8, "\x00\x01 12 !? \U0001f600 ÉÀ é"),
]
CLASH = "lang string, score double, _lang string, _secrets int, ids int, bytes int, kept int, component_id int, id int, rep int"


@pytest.fixture(scope="session")
def odd(spark):
    blank = (None,) * len(CLASH.split(", "))
    return spark.createDataFrame([(*r, *blank) for r in ODD], f"doc_id long, text string, {CLASH}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

