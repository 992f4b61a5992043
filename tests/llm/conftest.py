import pytest
from corners import corner_texts


@pytest.fixture(scope="session")
def corner(spark):
    """Corner-case documents, with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F
    rows = spark.createDataFrame(corner_texts(), "doc_id long, text string")
    return rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
                       F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("d"), F.lit(2).alias("t"),
                       F.lit(3).alias("count"), F.lit("z").alias("words"), F.lit("q").alias("kept"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
