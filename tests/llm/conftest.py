import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """docs((1, "text"), (2, None, "en", "s1"), ...) -> DataFrame with the columns of documents"""

    def build(*rows, extra=""):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        df = spark.createDataFrame(full, WIDE)
        # columns whose names an operator might use itself
        return df.selectExpr("*", "'x' AS kept", "1 AS fp", "2 AS size", "'y' AS shard") if extra else df

    return build
