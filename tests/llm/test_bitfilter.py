from pyspark.sql import functions as F

from quorix.llm import bitfilter as B


def test_no_key_is_lost_and_most_others_are_dropped(spark):
    keys = spark.range(5000).select(F.xxhash64(F.col("id") * 3).alias("k"))
    f = B.BitFilter.of(keys.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), 5000)
    df = spark.range(15000).select("id", F.xxhash64("id").alias("k")).union(spark.sql("SELECT -1L, CAST(NULL AS BIGINT)"))
    hit, miss = f.split(df, "k")
    got = {r.id for r in hit.collect()}
    assert {i for i in range(15000) if i % 3 == 0} <= got and len(got) < 6500
    assert {r.id for r in miss.collect()} == {-1, *range(15000)} - got


def test_empty_and_full_filter(spark, monkeypatch):
    none = spark.sql("SELECT 1L AS k").where("k > 1")
    assert B.BitFilter.of(none, 0).split(spark.range(10), "id")[0].count() == 0
    monkeypatch.setattr(B, "MOST_WORDS", 1 << 10)
    f = B.BitFilter.of(spark.range(1 << 17), 1 << 40)
    assert f.words == 1 << 10 and f.split(spark.range(1000), "id")[0].count() == 1000
