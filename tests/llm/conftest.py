import pytest
from pyspark.sql import types as T

PROSE = "the quick brown fox jumps over the lazy dog while seven old sailors mend their nets by the grey harbour wall at dawn"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

# Nulls in every column, empty and blank texts, ties, repeated rows, one very long text.
EDGE_ROWS = [
    (1, PROSE, "en", "a", len(PROSE)),
    (2, PROSE.upper(), "en", "b", len(PROSE)),
    (2, PROSE.upper(), "en", "b", len(PROSE)),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "fr", None, 4),
    (None, "word", "en", None, 4),
    (None, PROSE, None, "a", len(PROSE)),
    (6, "12 34 !!", "fr", "c", 8),
    (7, "long " * 60_000 + "tail", "en", "c", 300_004),
    (8, "Éa là où ça naît être été", "fr", "b", 25),
    (9, "Released under the MIT License.\nReleased under the MIT License.", "en", "c", 62),
    (10, PROSE + " again", None, "d", len(PROSE) + 6),
]

CLASHES = ["kept", "SHARD", "size", "copies", "h", "pattern", "survives", "row_key", "nth", "at", "bucket", "bits", "marked", "gone_id",
           "whole_text", "node", "score", "chunk", "plan_pattern"]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """The edge rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
