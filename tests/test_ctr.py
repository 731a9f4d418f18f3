import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quorix.etl import ctr
from quorix.plans.models import QUERIES


def test_users_beyond_the_test_table_keep_their_own_features(spark, tmp_path):
    e = spark.range(400).select(F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1.0).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = [r.features for r in QUERIES["ctr_features"](spark, str(tmp_path)).collect()]
    at = ctr.CtrLayout(users=400, queries=60, ads=24, query_tokens=20, keyword_tokens=20, id_bins=10).offsets()
    assert len(got) == 400
    assert sorted(x - at["user_id"] for f in got for x in f[:-1] if at["user_id"] <= x < at["ad_id"]) == list(range(400))
    bins = [x - at["user_bin"] for f in got for x in f[:-1] if at["user_bin"] <= x < at["query_bin"]]
    assert [bins.count(b) for b in range(10)] == [40] * 10


def test_id_outside_its_block_raises(spark):
    log = spark.createDataFrame([(1, 1, 0, 0, 3, 0, 0, 0, 0, 0, 7)], "clicks int, impressions int, ad int, advertiser int, depth int, position int, query int, keyword int, title int, description int, user int")
    lists = spark.createDataFrame([(0, [0])], "id int, tokens array<int>")
    profile = spark.createDataFrame([(7, 1, 1)], "user int, gender int, age int")
    for users in (8, 7):
        layout = ctr.CtrLayout(users=users, queries=1, ads=1, query_tokens=1, keyword_tokens=1, id_bins=1)
        rows = ctr.features(log, log, {e: lists for e, _ in ctr.LENGTHS}, profile, layout)
        if users == 8:
            assert len(rows.collect()) == 1
        else:
            with pytest.raises(PySparkException, match="user_id outside its 7 features"):
                rows.collect()
