from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty texts and repeated rows, beside columns whose names operators use."""
    from pyspark.sql import functions as F

    rows = [(1, "plain words in a short text", "en", "s", 27), (1, "plain words in a short text", "en", "s", 27), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "some other words", "en", None, 16), (4, "!!! ... ", "xx", "s", 8)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "row", "spans", "candidates", "log_weight", "_label", "id", "node", "h", "k1", "t1", "tag", "doc", "item", "start", "length", "sequence_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)
