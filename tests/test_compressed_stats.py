import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quorix.operators import compressed_stats as cs

SCHEMA = "row_idx int, col_idx int, value float, n int, side string"


def rows(seed=1, n=3000):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        row = rng.choice([1, 1, 1, 2, None, rng.randrange(50)])
        out.append((row, rng.randrange(5), rng.choice([None, float("nan"), -0.0, 0.0, 1.5, 2.5, 3.0]), 9, "clash"))
    return out


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = {(r.side, r.key_id): r for r in cs.key_stats(cs.compress(df, {"row": "row_idx", "col": "col_idx"}, "value")).collect()}
    groups = defaultdict(list)
    for r in data:
        for side, k in (("row", r[0]), ("col", r[1])):
            if k is not None:
                groups[side, k].append(r[2])
    assert set(got) == set(groups)
    for k, values in groups.items():
        v = sorted(x for x in values if x is not None and not math.isnan(x))
        g = got[k]
        assert (g.n, g.n_values, g.n_distinct) == (len(values), len(v), len(set(v)))
        if not v:
            assert g.value_sum is None and g.value_median is None and g.value_mode is None
            continue
        assert g.value_sum == sum(v) and math.isclose(g.value_mean, sum(v) / len(v))
        c = Counter(v)
        assert g.value_mode == min(x for x in c if c[x] == max(c.values()))
        assert g.value_median == v[(len(v) - 1) // 2]


def test_heavy_keys_and_quantiles(spark):
    data = rows(2)
    c = cs.compress(spark.createDataFrame(data, SCHEMA), {"row": "row_idx"}, "value")
    want = {k for k, n in Counter(r[0] for r in data).items() if k is not None and n >= 0.02 * len(data)}
    assert {r.key_id for r in cs.heavy_keys(c, 0.02).collect()} == want
    q = {r.key_id: r for r in cs.weighted_quantiles(c, [0.0, 0.5, 1.0]).collect()}
    for k in want:
        v = sorted(r[2] for r in data if r[0] == k and r[2] is not None and not math.isnan(r[2]))
        assert (q[k].q0, q[k].q1, q[k].q2) == (v[0], v[math.ceil(len(v) / 2) - 1], v[-1])


def test_empty(spark):
    c = cs.compress(spark.createDataFrame([], SCHEMA), {"row": "row_idx", "col": "col_idx"}, "value")
    assert cs.key_stats(c).count() == 0 and cs.heavy_keys(c, 0.02).count() == 0


def test_quantiles_of_a_hot_key_with_many_values(spark):
    """Negative, tiny, infinite and repeated values; one key holds nearly all of 20,000 distinct ones."""

    rng = random.Random(3)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30) for _ in range(20000)] + [0.0, -0.0, float("inf"), float("-inf"), 5e-324] * 3
    rows = [(1, v) for v in values] + [(2, 1.5), (2, 1.5), (2, 2.5), (3, None), (3, float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "k int, value double").repartition(7)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.key_id: r for r in cs.weighted_quantiles(cs.compress(df, {"s": "k"}, "value"), shares).collect()}
    assert set(got) == {1, 2}
    values.sort()
    for i, p in enumerate(shares):
        assert got[1][f"q{i}"] == values[max(0, math.ceil(len(values) * p) - 1)]
    assert [got[2][f"q{i}"] for i in range(5)] == [1.5, 1.5, 1.5, 2.5, 2.5]
    ranges = df.where("k = 1").distinct().groupBy(cs.value_range(F.col("value")).alias("r")).count()
    assert ranges.agg(F.max("count")).first()[0] < 200
