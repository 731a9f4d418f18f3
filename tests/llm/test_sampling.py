import random

from pyspark.sql import functions as F

from quorix.llm import sampling as S

SCHEMA = "rec_id bigint, row_idx int, col_idx int, batch_no int, probability string, weight string, sample_probability string"


def records(seed=0, n=4000):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, None, rng.randrange(60)]), rng.choice([None, rng.randrange(40)]) if i % 9 == 0 else rng.randrange(40), rng.choice([None, *range(6)]), "p", "w", "s") for i in range(n)]


def cells(df, **kw):
    return {(r.row_idx, r.col_idx) for r in S.selected_cells(S.batch_weights(df), **kw).collect()}


def test_growing_keeps_selected_cells(spark):
    df = spark.createDataFrame(records(), SCHEMA)
    before = set()
    for b in range(6):
        now = cells(df.where(F.col("batch_no") <= b), rate=0.1)
        assert before <= now
        before = now
    assert before


def test_state_equals_full_recompute(spark):
    df = spark.createDataFrame(records(1), SCHEMA)
    state = S.batch_weights(df.where("batch_no <= 2"))
    for b in range(3, 6):
        state = S.advance(state, df.where(F.col("batch_no") == b))
    full = S.batch_weights(df.where("batch_no IS NOT NULL"))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, full.collect()))


def test_all_or_no_records_and_partitioning(spark):
    rows = records(2)
    df = spark.createDataFrame(rows, SCHEMA)
    weights = S.batch_weights(df)
    picked = cells(df)
    for part in (df.coalesce(1), df.repartition(11)):
        got = S.sample_records(part, weights)
        assert {r.rec_id for r in got.collect()} == {r[0] for r in rows if (r[1], r[2]) in picked}
        assert set(got.columns) == set(df.columns)
    assert all(0 < r.sample_probability <= 1 for r in S.sample_records(df, weights).collect())


def test_share_is_near_expectation_and_empty(spark):
    df = spark.range(20000).select(F.col("id").alias("rec_id"), F.col("id").cast("int").alias("row_idx"), F.lit(1).alias("col_idx"), F.lit(0).alias("batch_no"))
    assert 800 < len(cells(df, rate=0.05)) < 1200
    assert not cells(df.limit(0))


def test_hot_and_other_cells_give_all_their_records(spark, monkeypatch):
    """One cell holds 40 % of the Records; the salted way, the plain way and both together give the same."""
    rows = [(i, 1 if i % 5 < 2 else i % 50, 1 if i % 5 < 2 else i % 7, i % 6, "p", "w", "s") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    weights = S.batch_weights(df)
    picked = cells(df)
    want = sorted(r[0] for r in rows if (r[1], r[2]) in picked)
    assert (1, 1) in picked and len(picked) > 3
    for share in (1e-9, 0.1, 1.0):
        monkeypatch.setattr(S, "HOT_SHARE", share)
        assert sorted(r.rec_id for r in S.sample_records(df, weights).collect()) == want
    monkeypatch.setattr(S, "SLOTS", 2)
    assert sorted(r.rec_id for r in S.sample_records(df, weights).collect()) == want
    assert S.sample_records(df.limit(0), weights.limit(0)).count() == 0


def test_weights_stored_batch_by_batch(spark):
    df = spark.createDataFrame(records(5), SCHEMA)
    got = S.stored_weights(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.batch_weights(df).collect()))
    assert S.stored_weights(df.limit(0)).count() == 0
