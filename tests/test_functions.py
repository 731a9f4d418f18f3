import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorix.functions import exprs as X
from quorix.functions import special as S
from quorix.functions import vectors as V


def test_special_functions():
    x = np.array([0.05, 0.5, 1.0, 3.3, 20.0, 400.0])
    h = 1e-5
    lg = S.lgamma
    assert np.allclose(S.digamma(x), (lg(x + h) - lg(x - h)) / (2 * h), rtol=1e-6)
    assert np.allclose(S.trigamma(x), (S.digamma(x + h) - S.digamma(x - h)) / (2 * h), rtol=1e-6)
    assert np.allclose(S.tetragamma(x), (S.trigamma(x + h) - S.trigamma(x - h)) / (2 * h), rtol=1e-5)
    assert math.isclose(S.digamma(np.array([1.0]))[0], -0.5772156649015329, rel_tol=1e-12)
    assert np.allclose(S.row_normalise(np.array([[1.0, 3.0]])), [[0.25, 0.75]])
    a = np.array([[1.0, 2.0], [3.0, 4.0]])
    assert np.allclose(S.dirichlet_expectation(a)[1], S.dirichlet_expectation(a[1]))
    assert np.allclose(S.log_sum(np.array([0.0]), np.array([0.0])), math.log(2))
    assert S.sigmoid(np.array([-11.0, 11.0])).tolist() == [4.5398e-05, 1 - 1e-05]
    assert S.clamped_exp(np.array([-11.0, 11.0])).tolist() == [4.54e-5, 22026.0]


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_hand_checked_expressions(spark):
    L = F.lit
    got = one(
        spark,
        X.smoothed_rate(L(5), L(25)),
        X.l1_prox(L(3.0), L(2.0), 1.0),
        X.l1_prox(L(-0.5), L(2.0), 1.0),
        X.l2_prox(L(3.0), L(2.0), 1.0),
        X.max_norm(F.array(L(3.0), L(4.0)), F.array(L(1.0), L(1.0)), 1.0),
        X.savgm_fix(L(1.0), L(2.0), 0.1),
        X.sigmoid(L(-11.0)),
        X.sigmoid(L(11.0)),
        X.log_likelihood(L(0.0)),
        X.log_likelihood(L(-20.0)),
        X.day_number(L("1999-02-03")),
        X.l1_prox(L(3.0), L(0.0), 1.0),
        X.bucketize(L(9.9), 0.1, 50),
    )
    assert got[:4] == (0.0875, 1.0, 0.0, 1.0)
    assert got[4] == pytest.approx([0.6, 0.8])
    assert got[5] == pytest.approx(0.8 / 0.9)
    assert got[6:10] == (4.5398e-05, 1 - 1e-05, pytest.approx(-math.log(2)), -20.0)
    assert got[10:] == (33, 0.0, 49)


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))
    short = F.array(F.lit(1.0))
    got = one(spark, V.dot(a, b), V.add(a, b), V.divide(a, b), V.mean(a), V.variance(a), V.distance(a, b), V.dot(a, short), V.indicator(3, F.lit(1)), V.plus_dot(a, a, b), V.scale_down(a, 2.0), V.filled(2, 1.0), V.negate(a), V.shift(a, 1.0))
    assert got[0] == 13 and got[1] == [4, 7] and got[3] == 1.5 and got[4] == 0.25
    assert got[5] == pytest.approx(math.sqrt(13)) and got[6] is None and got[7] == [0, 1, 0] and got[8] == 26
    assert got[9] == [0.5, 1.0] and got[10] == [1.0, 1.0] and got[11] == [-1, -2] and got[12] == [2, 3]


def test_sparse(spark):
    idx, val, none = F.array(F.lit(2), F.lit(0)), F.array(F.lit(0.5), F.lit(4.0)), F.lit(None).cast("array<double>")
    got = one(spark, V.densify(idx, val, 4), V.densify(idx, none, 3), V.sparse_squared_norm(idx, none), V.sparse_l1_norm(idx, val), V.sparse_get(idx, val, F.lit(1)), V.sparse_contains(idx, F.lit(2)), V.sparse_dot_dense(idx, val, F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))), V.gather(idx, F.array(F.lit(7.0))))
    assert got == ([4.0, 0.0, 0.5, 0.0], [1.0, 0.0, 1.0], 2.0, 4.5, 0.0, True, 5.0, [0.0, 7.0])


def test_sparse_distance_with_tails(spark):
    a = spark.createDataFrame([(1, [0, 9], [1.0, 2.0])], "k int, idx array<int>, val array<double>")
    b = spark.createDataFrame([(1, [0, 3], [3.0, 1.0])], "k int, idx array<int>, val array<double>")
    r = V.sparse_distances(a, b, "k").first()
    assert (r.squared_distance, r.l1_distance) == (4 + 4 + 1, 2 + 2 + 1)
