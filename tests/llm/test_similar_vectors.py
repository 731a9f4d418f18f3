import numpy as np
import pytest
from pyspark.sql import functions as F

from quorix.llm import similar_vectors as S

SCHEMA = "side string, id int, f array<float>, cos string, rank string"


def clustered(seed=0, n=1500, dim=48):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[: n // 3] = rng.normal(size=dim) * 2 + 0.7 * x[: n // 3]  # one crowded direction
    twins = x[rng.choice(n, 100)] + 0.12 * rng.normal(size=(100, dim))
    x = np.concatenate([x, twins, x[:1]]) * np.exp(rng.normal(size=(n + 101, 1)))
    return x.astype(np.float32)


def rows(x, side="r"):
    out = [(side, i, [float(v) for v in r], "c", "k") for i, r in enumerate(x)]
    bad = len(x)
    out += [(side, bad, None, "", ""), (side, bad + 1, [], "", ""), (side, bad + 2, [1.0] * 47, "", ""), (side, bad + 3, [0.0] * 48, "", "")]
    out += [(side, bad + 4, [float("nan")] + [1.0] * 47, "", ""), (side, bad + 5, [float("inf")] + [1.0] * 47, "", ""), (side, bad + 6, [None] + [1.0] * 47, "", "")]
    return out + [out[0], (None, 1, out[1][2], "", ""), (side, None, out[1][2], "", "")]


def true_pairs(x, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T, 1) >= least)
    return set(zip(a.tolist(), b.tolist())), u


def test_pairs_recall_and_precision(spark):
    x = clustered()
    df = spark.createDataFrame(rows(x), SCHEMA).repartition(5)
    got = {(r.id_a, r.id_b) for r in S.similar_pairs(df, min_cos=0.95).collect()}
    want, _ = true_pairs(x, 0.95)
    assert len(want) > 50 and got <= want and len(got) >= 0.99 * len(want)


def test_exhaustive_search_is_exact(spark):
    x = clustered(1, 600)
    df = spark.createDataFrame(rows(x), SCHEMA)
    got = S.similar_vectors(df, k=5, asks=F.col("id") % 20 == 0, exhaustive=True).collect()
    _, u = true_pairs(x, 0.95)
    for i in range(0, len(x), 20):
        c = u @ u[i]
        c[i] = -2
        want = np.sort(c)[-5:][::-1]
        mine = sorted((r for r in got if r.id == i), key=lambda r: r["rank"])
        assert np.allclose([r.cos for r in mine], want, atol=1e-6) and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]


def test_grid_of_tiles_gives_the_same(spark, monkeypatch):
    x = clustered(2, 500)
    df = spark.createDataFrame(rows(x), SCHEMA)
    plain = {tuple(r) for r in S.similar_pairs(df).collect()}
    monkeypatch.setattr(S, "TILE_ROWS", 64)
    assert {tuple(r) for r in S.similar_pairs(df).collect()} == plain
    monkeypatch.setattr(S, "BROADCAST_PAIRS", 0)
    assert {tuple(r) for r in S.similar_pairs(df).collect()} == plain


def test_bounds_hold():
    x = clustered(3, 200)
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    code, scale, err = S.quantise(u)
    ids = np.arange(len(u))
    i, j, lower, upper = S.tile_pairs(ids, (code, scale, err), ids, (code, scale, err), len(u), -2.0)
    true = (u.astype(float) @ u.astype(float).T)[i, j]
    assert len(i) == len(u) * (len(u) - 1) and (lower <= true).all() and (true <= upper).all()


def test_two_sides_two_versions_and_empty(spark):
    v, w = [1.0] * 48, [1.0] * 24 + [-1.0] * 24
    data = [("r", 1, v, "", ""), ("c", 2, v, "", ""), ("r", 3, w, "", ""), ("r", 3, v, "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert [tuple(r) for r in S.similar_pairs(df).collect()] == [("r", 1, 3)]
    assert S.similar_pairs(df.limit(0)).count() == 0


def test_unit_rows_on_extremes():
    import pyarrow as pa

    x, at = S.unit_rows(pa.array([[3e38] * 2, [1e-40, 0.0], [0.0, 0.0], None], pa.list_(pa.float32())), 2)
    assert at.tolist() == [0, 1] and np.allclose(np.linalg.norm(x, axis=1), 1)


@pytest.mark.parametrize("n", [1, 2, 700])
def test_few_vectors(spark, n):
    x = clustered(4, 700)[:n]
    got = {(r.id_a, r.id_b) for r in S.similar_pairs(spark.createDataFrame(rows(x)[:n], SCHEMA)).collect()}
    assert got == true_pairs(x, 0.95)[0]


def top_ten(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    c = u @ u.T
    np.fill_diagonal(c, -2)
    return {(i, int(j)) for i, row in enumerate(np.argpartition(-c, 10, axis=1)[:, :10]) for j in row}


def test_recall_of_the_nearest_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 32)  # 94 cells
    x = np.random.default_rng(5).normal(size=(3000, 48)).astype(np.float32)
    x[:, 12:] *= 0.4
    df = spark.createDataFrame([("r", i, [float(v) for v in r], "", "") for i, r in enumerate(x)], SCHEMA)
    got = {(r.id, r.nbr) for r in S.similar_vectors(df, k=10).select("id", "nbr").collect()}
    assert len(got & top_ten(x)) >= 0.9 * len(x) * 10


def test_probes_needed_follow_the_pairs_asked_for():
    cos = np.concatenate([np.full(100, 0.97), np.full(900, 0.4)])
    rank = np.concatenate([np.full(100, 1), np.arange(900) % 50])
    assert S.probes_needed(cos, rank, 0.95, 0.999) == S.PROBES and S.probes_needed(cos, rank, -1.0, 0.95) > 40


def test_ids_delivered_many_times_leave_room_for_others(spark):
    x = clustered(6, 600)
    x[:300] = x[:1] + 0.3 * np.abs(x[:1]).mean() * np.random.default_rng(6).normal(size=(300, 48))  # close together
    df = spark.createDataFrame([r for r in rows(x)[: len(x)] for _ in range(12)], SCHEMA)
    got = S.similar_vectors(df, k=10, asks=F.col("id") % 20 == 0, exhaustive=True).collect()
    plain = S.similar_vectors(df.distinct(), k=10, asks=F.col("id") % 20 == 0, exhaustive=True).collect()
    assert {(r.id, r.nbr, r["rank"]) for r in got} == {(r.id, r.nbr, r["rank"]) for r in plain}
    assert len(got) == 10 * len(range(0, len(x), 20))


def test_versions_of_an_id_count_once_for_the_kth_bound():
    x = clustered(7, 300)
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    near = np.argsort(-(u @ u[0]))[1:31]
    some = u[near]
    versions = np.concatenate([some, np.repeat(some[:3], 20, axis=0)])  # three ids with 21 rows each
    ids = np.concatenate([near, np.repeat(near[:3], 20)])
    _, j, _, _ = S.tile_pairs(np.array([-1]), S.quantise(u[:1]), ids, S.quantise(versions), 10, -1.0)
    assert set(near[:10].tolist()) <= set(ids[j].tolist())


def test_a_hub_answers_its_own_k_only():
    """Reverse pairs: the k nearest visiting rows of each base row, in slices of any size, with ids of several rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 48)).astype(np.float32)
    x[1:] = 0.6 * x[1:] + x[0]  # all are near row 0
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.repeat(np.arange(200), 2).astype(np.int32)
    code = S.quantise(x)
    heaps, base = S._Heaps(3, 5, -1.0), tuple(p[:3] for p in code)
    for at in S._slices(ids[3:], 37):
        rows = np.arange(3, 400)[at]
        assert set(ids[rows]).isdisjoint(ids[np.setdiff1d(np.arange(3, 400), rows)])
        heaps.add(*(m.copy() for m in S.bounds(tuple(p[rows] for p in code), base)), ids[rows])
    row, other, low, up = heaps.pairs()
    true = x[:3].astype(float) @ x[3:].T.astype(float)
    for r in range(3):
        best = {i: true[r][ids[3:] == i].max() for i in set(ids[3:].tolist())}
        assert set(sorted(best, key=best.get)[-5:]) <= set(other[row == r].tolist())
        assert 5 <= (row == r).sum() < 40 and (low[row == r] <= up[row == r]).all()


def test_index_recall_of_a_query_set(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 32)
    x = np.random.default_rng(9).normal(size=(3000, 48)).astype(np.float32)
    x[:, 12:] *= 0.4
    df = spark.createDataFrame([("r", i, [float(v) for v in r], "", "") for i, r in enumerate(x)], SCHEMA)
    got = {(r.id, r.nbr) for r in S.similar_vectors(df, k=10, asks=F.col("id") % 20 == 0).select("id", "nbr").collect()}
    want = {(i, j) for i, j in top_ten(x) if i % 20 == 0}
    assert len(got & want) >= 0.9 * len(want)
