from pyspark.sql import functions as F

from shelfwise.llm.common import likely


def test_likely_loses_nothing(spark):
    df = spark.range(4000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("word"))
    keys = df.where("id % 40 = 3").select("h")
    got = {r.id for r in likely(df, "h", keys).collect()}
    assert got >= set(range(3, 4000, 40)) and len(got) < 130
    assert likely(df, "h", keys).columns == df.columns
    assert likely(df, "h", keys.limit(0)).count() == 0
