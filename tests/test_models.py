import numpy as np
import pytest
from pyspark.sql import functions as F

from quorix import synth
from quorix.models import kernels_lr as K
from quorix.models.lda import fit_lda
from quorix.models.lr import fit_lr
from quorix.models.mf import fit_mf
from quorix.models.tf import fit_tf
from quorix.schema import LdaParams, LdaStrategy, LrParams, LrStrategy, MfParams, MfStrategy, Optimizer, TfParams


def last(history, metric):
    return [r.value for r in history.where(F.col("metric") == metric).orderBy("iteration").collect()]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=6)
    rows = []
    for i in range(400):
        x = np.r_[1.0, rng.normal(size=5)]
        y = 1 if x @ w + 0.3 * rng.normal() > 0 else -1
        rows.append((i, y, list(range(6)), [float(v) for v in x]))
    return spark.createDataFrame(rows, "row_id bigint, label int, idx array<int>, val array<double>").cache()


@pytest.mark.parametrize("strategy", list(LrStrategy))
def test_all_lr_strategies_learn(vectors, strategy):
    m = fit_lr(vectors, LrParams(strategy=strategy, blocks=3, outer=3, inner=4, reg=0.1, stop_auc=-1.0))
    assert last(m.history, "auc")[-1] > 0.95
    assert m.weights.count() == 6


def test_one_block_is_the_local_solver(vectors):
    m = fit_lr(vectors, LrParams(strategy=LrStrategy.AVGM, blocks=1, outer=1, inner=5))
    rows = vectors.orderBy("row_id").collect()
    x = K.Design(len(rows), 6, np.repeat(np.arange(len(rows)), 6), np.tile(np.arange(6), len(rows)), np.concatenate([r.val for r in rows]))
    want, _, _ = K.solve_cd(x, np.array([r.label for r in rows], float), np.zeros(6), np.zeros(6), 5, 1.0, 1.0)
    assert np.allclose([r.w for r in m.weights.orderBy("feature").collect()], want)


def test_lr_does_not_depend_on_partitioning(vectors):
    p = LrParams(strategy=LrStrategy.HMEM, blocks=3, outer=2, inner=2)
    a = [r.w for r in fit_lr(vectors, p).weights.orderBy("feature").collect()]
    b = [r.w for r in fit_lr(vectors.repartition(11), p).weights.orderBy("feature").collect()]
    assert np.allclose(a, b, rtol=1e-12)


def test_admm_blocks_agree_more_and_more(vectors):
    short = fit_lr(vectors, LrParams(strategy=LrStrategy.ADMM, blocks=3, outer=1, inner=10, stop_auc=-1.0))
    long = fit_lr(vectors, LrParams(strategy=LrStrategy.ADMM, blocks=3, outer=6, inner=10, stop_auc=-1.0))
    assert last(long.history, "llh")[-1] >= last(short.history, "llh")[-1]


def test_impossible_options_raise_at_once():
    with pytest.raises(ValueError):
        LrParams(strategy=LrStrategy.DGM, optimizer=Optimizer.CD).resolved()
    with pytest.raises(ValueError):
        MfParams(strategy=MfStrategy.ADMM, optimizer="ALS").resolved()


def test_binary_features_and_empty_input(spark):
    rows = [(i, 1 if i % 3 else -1, [0, 1 + i % 3], None) for i in range(60)]
    schema = "row_id bigint, label int, idx array<int>, val array<double>"
    m = fit_lr(spark.createDataFrame(rows, schema), LrParams(strategy=LrStrategy.AVGM, blocks=2, outer=1))
    assert last(m.history, "auc")[-1] == 1.0
    empty = fit_lr(spark.createDataFrame([], schema), LrParams(strategy=LrStrategy.HMEM, blocks=2, outer=1))
    assert empty.weights.count() == 0


@pytest.fixture(scope="module")
def matrix(spark):
    return synth.synth_matrix(spark, 60, 40, rank=2, density=0.5, noise_precision=1e4, seed=3).cache()


@pytest.mark.parametrize("strategy", list(MfStrategy))
def test_all_mf_strategies_learn(matrix, strategy):
    exact = strategy in (MfStrategy.DMAP, MfStrategy.DVB)
    p = MfParams(strategy=strategy, rank=2, outer=8 if exact else 4, inner=6, gamma=0.05, em_bayes=True, row_blocks=2, col_blocks=1)
    m = fit_mf(matrix.where("is_train"), p, validate=matrix.where("NOT is_train"))
    base = matrix.where("NOT is_train").agg(F.sqrt(F.avg(F.col("value") * F.col("value")))).first()[0]
    if exact or strategy is MfStrategy.HECMEM:
        assert last(m.history, "rmse")[-1] < 0.8 * base
    if not exact:  # plain averages of factors that are only defined up to a rotation needn't predict well
        assert last(m.history, "local_rmse")[-1] < 0.5 * base
    assert m.predict(matrix).count() == matrix.count()


def test_als_recovers_noiseless_factors(spark, matrix):
    m = fit_mf(matrix.where("is_train"), MfParams(strategy=MfStrategy.DMAP, rank=2, outer=10, gamma=1e-3), validate=matrix.where("NOT is_train"))
    e = last(m.history, "rmse")
    assert e[-1] < 0.05


def test_mf_ignores_nulls(spark):
    rows = [(1, 1, 2.0), (1, 2, None), (None, 1, 1.0), (2, 1, float("nan")), (2, 2, 1.0), (1, 1, 2.0)]
    m = fit_mf(spark.createDataFrame(rows, "row int, col int, value float"), MfParams(rank=1, outer=1, inner=1))
    assert np.isfinite(last(m.history, "rmse")[-1])


def test_tensor_learns(spark):
    cells = synth.synth_tensor(spark, (20, 12, 5), rank=2, density=0.5, noise_precision=1e4, seed=1).cache()
    for options in ({}, {"vb": True, "dual": False}, {"markov": 0.01}):
        m = fit_tf(cells.where("is_train"), TfParams(rank=2, outer=3, inner=6, blocks=(2, 1, 1), gamma=(0.1, 0.1, 0.1), **options))
        e = last(m.history, "local_rmse")
        assert e[-1] < 0.9 * cells.agg(F.sqrt(F.avg(F.col("value") * F.col("value")))).first()[0]


@pytest.mark.parametrize("strategy", list(LdaStrategy))
def test_topics_improve(spark, strategy):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(80):
        words = np.sort(rng.choice(np.arange(10) + 10 * (i % 2), 6, replace=False))
        rows.append((i, [int(w) for w in words], [int(c) for c in rng.integers(1, 6, 6)]))
    rows += [(1000, [], []), (1001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, words array<int>, counts array<int>")
    m = fit_lda(docs, LdaParams(strategy=strategy, topics=2, outer=4, inner=10, alpha=0.1, blocks=3, sample_docs=20, update_alpha=strategy is LdaStrategy.MRLDA))
    p = last(m.history, "perplexity")
    assert p[-1] <= p[0] * 1.01 and p[-1] < 16
    assert m.topics.count() == 2 * 20


def test_generators_are_reproducible(spark):
    a = synth.synth_matrix(spark, 30, 20, row_blocks=2, seed=5)
    b = synth.synth_matrix(spark, 30, 20, row_blocks=2, seed=5).repartition(5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.groupBy("row", "col").count().where("count > 1").count() == 0
    m = synth.moments(synth.synth_tensor(spark, (20, 20, 20), density=0.2)).first()
    assert 1200 < m.n_train + m.n_test < 2000


def test_routed_sums_equal_plain_ones_with_a_hot_id(spark):
    """An id with most ratings is spread over blocks; ids without factor and repeated ratings are handled."""
    from quorix.models.mf import Links, triangle

    rng = np.random.default_rng(4)
    rows = np.where(rng.random(3000) < 0.6, 7, rng.integers(0, 50, 3000))
    cols, vals = rng.integers(0, 80, 3000), rng.normal(size=3000)
    data = [(int(r), int(c), float(v)) for r, c, v in zip(rows, cols, vals)] + [(1, 2, 0.5)] * 3 + [(5, 999, 1.0)]
    links = Links.of(spark.createDataFrame(data, "row int, col int, value double"), "row", "col", 4)
    assert links.data.where("id = 7").select("block").distinct().count() == 4
    assert links.data.where("id = 8").select("block").distinct().count() == 1
    f = rng.normal(size=(80, 3))
    other = spark.createDataFrame([(i, [float(x) for x in f[i]], [2.0] * 3) for i in range(80)], "id int, f array<double>, prec array<double>")
    got = {}
    for r in links.normal_equations(other, 3).collect():
        got[r.id] = got.get(r.id, 0) + np.r_[r.n, r.packed]
    a, b = triangle(3)
    known = [(r, c, v) for r, c, v in data if c < 80]
    for i in {r for r, _, _ in known}:
        x, y = np.array([f[c] for r, c, _ in known if r == i]), np.array([v for r, _, v in known if r == i])
        assert np.allclose(got[i], np.r_[len(y), (x.T @ x)[a, b], x.T @ y, np.full(3, len(y) / 2)])
    assert set(got) == {r for r, _, _ in known}


def test_global_step_names_its_blocks_and_keeps_local_factors(spark):
    from quorix.models import consensus as C

    rows = [(b, 0, i, [1.0 * i, 2.0], [0.5, 0.0], [1.0 + b, 1.0], 2.0) for i in (1, 2) for b in range(i)] + [(0, 1, 9, [3.0, 4.0], [0.0, 0.0], [1.0, 1.0], 1.0)]
    state = spark.createDataFrame(rows, "block int, dim int, id int, f array<double>, lag array<double>, gamma array<double>, n_obs double")
    got = {(r.dim, r.id): (r.f, r.blocks) for r in C.global_step(state, lam=1.0, regularizer="L1", dual=True, weighted=True, plain=False, own_only=F.col("dim") == 1, blocks=True).collect()}
    assert got[(0, 1)] == ([0.0, 0.0], [0]) and got[(1, 9)] == ([3.0, 4.0], [0])
    assert np.allclose(got[(0, 2)][0], [(2.5 * 6 - 1) / 6, (2.0 * 4 - 1) / 4]) and got[(0, 2)][1] == [0, 1]


def test_lr_options_reach_their_solvers(spark, vectors):
    base = dict(blocks=3, outer=3, inner=4, reg=0.1, stop_auc=-1.0)
    for options in (
        dict(strategy=LrStrategy.HMEM, ard=True),
        dict(strategy=LrStrategy.HECMEM, elastic=0.01),
        dict(strategy=LrStrategy.AVGM, optimizer=Optimizer.CG, t_prior=(1.0, 1.0)),
        dict(strategy=LrStrategy.ADMM, optimizer=Optimizer.CG, clip=10.0, inner_stop=1e-3),
        dict(strategy=LrStrategy.ADMM, inner_stop=1e-3, bound="JAAKKOLA"),
    ):
        assert last(fit_lr(vectors, LrParams(**base, **options)).history, "auc")[-1] > 0.95
    early = fit_lr(vectors, LrParams(**base, strategy=LrStrategy.AVGM, target_auc=0.9))
    assert len(last(early.history, "auc")) == 1
    for bad in (dict(strategy=LrStrategy.AVGM, ard=True), dict(strategy=LrStrategy.AVGM, t_prior=(1.0, 1.0))):
        with pytest.raises(ValueError):
            LrParams(**bad).resolved()


def test_t_prior_is_heavy_tailed():
    """The solver climbs its own objective; a far optimum is pulled less than by the Gaussian prior of the same weight at 0."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = np.where(x @ np.array([3.0, -2.0, 1.0]) + 0.3 * rng.normal(size=400) > 0, 1.0, -1.0)
    d = K.Design(400, 3, np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400), x.ravel())
    zero = np.zeros(3)

    def value(w, shape, scale):
        return K.log_likelihood(d, y, w) - (shape + 1.5) * np.log1p((w @ w) / (2 * scale))

    found = [K.solve_t_prior(d, y, zero, zero, r, 20.0, 1.0) for r in (1, 3, 30)]
    assert value(found[0], 20.0, 1.0) < value(found[1], 20.0, 1.0) <= value(found[2], 20.0, 1.0) + 1e-9
    near = found[2] + 0.01 * rng.normal(size=(20, 3))
    assert all(value(n, 20.0, 1.0) <= value(found[2], 20.0, 1.0) + 1e-6 for n in near)
    weight, r = K.t_weight(zero, zero, 20.0, 1.0)
    gauss = K.solve_gradient(d, y, zero, zero, weight, 30, "CG")
    assert r == 0 and np.linalg.norm(found[2]) > np.linalg.norm(gauss)


def test_bound_objective_touches_the_likelihood():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 2))
    y = np.where(rng.random(50) < 0.5, 1.0, -1.0)
    d = K.Design(50, 2, np.repeat(np.arange(50), 2), np.tile(np.arange(2), 50), x.ravel())
    w = rng.normal(size=2)
    exact = K.log_likelihood(d, y, w)
    assert np.isclose(K.bound_objective(d, y, w, "JAAKKOLA"), exact) and K.bound_objective(d, y, w, "TAYLOR") == exact
    assert K.bound_objective(d, y, w, "JAAKKOLA", np.ones(2)) < exact


def test_topic_bound_and_pass_match_the_local_kernels(spark):
    """Routed rows give the statistics, metrics and bound of the plain kernels; unknown words are left out."""
    from quorix.models import kernels_lda as KL
    from quorix.models import lda as L

    rng = np.random.default_rng(7)
    eta = rng.gamma(2.0, 1.0, (3, 30))
    docs = [(i, sorted(int(w) for w in rng.choice(30, 8, replace=False)), [int(c) for c in rng.integers(1, 5, 8)]) for i in range(25)]
    rows = spark.createDataFrame([(w, [float(x) for x in eta[:, w]]) for w in range(30)], "word int, eta array<double>")
    topics = L.Topics.of(rows.cache(), 3, 0.1)
    assert np.isclose(topics.bound(0.1), KL.topic_bound(eta, 0.1)) and topics.vocabulary == 30
    blocks = L.DocBlocks.of(spark.createDataFrame([*docs, (98, [], []), (99, None, None)], "doc_id bigint, words array<int>, counts array<int>"), 3)
    found = L.e_pass(blocks, topics, np.full(3, 0.5), 4)
    exp_beta, total, llh = L.S.exp_dirichlet_expectation(eta), np.zeros(eta.shape), 0.0
    for _, w, c in docs:
        g, s = KL.e_step(np.array(w), np.array(c, float), exp_beta[:, w], np.full(3, 0.5), np.ones(3), 4)
        total[:, w] += s
        llh += KL.log_likelihood(np.array(w), np.array(c, float), g, L.S.row_normalise(eta)[:, w])
    assert np.isclose(found.llh, llh) and found.n_docs == 25
    new = np.zeros(eta.shape)
    for r in L.m_step(found, topics, 0.1).rows.collect():
        new[:, r.word] = r.eta
    assert np.allclose(new, KL.m_step(total, exp_beta, 0.1))
    model = L.LdaModel(topics.long(), np.full(3, 0.5), None, topics)
    got = {r.doc_id: r.gamma for r in model.document_topics(spark.createDataFrame([(1, [2, 40], [3, 1]), (2, [41], [1])], "doc_id bigint, words array<int>, counts array<int>"), 5).collect()}
    want, _ = KL.e_step(np.array([2]), np.array([3.0]), exp_beta[:, [2]], np.full(3, 0.5), np.ones(3), 5)
    assert np.allclose(got[1], want) and set(got) == {1, 2}
