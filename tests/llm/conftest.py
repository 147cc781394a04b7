import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tests_llm_rows import CLASHING, ROWS


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})
    return docs.withColumns({c: F.lit("extra") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
