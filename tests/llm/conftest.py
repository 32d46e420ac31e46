import pytest
from pyspark.sql import functions as F

EDGE_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e f g h i j",
    "a b c d e f g h i j",
    "Größe ² naïve — 日本語 <|endoftext|> 's it's\r\n\n  x   \x85 y \x1c!\x1c",
    "word " * 6000,
    "x" * 5000,
    "many words here " * 4000,
    "y" * 20_000,
    "line one here\nline one here\n\nline two there\nline one here\n",
]

# Columns of the input whose names the operators once used, or use, inside.
OWN_NAMES = "_stratum _limits _score _kept _stats _base_failed _id_0 _text_0 row id kept limits own copy_key text_key unit class_id label".split()


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "src", i, "held", -1, 7) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[4], rows[4], (None, "no id at all", None, None, 0, None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, key long, stratum string, size int, score int"
    ).repartition(3)
    return docs.withColumns({name: F.lit(f"own {name}") for name in OWN_NAMES})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
