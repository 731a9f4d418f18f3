"""Distributed logistic regression: exact gradient, averaging, hierarchical and consensus strategies.

Data are vectors (row_id, label, idx, val); blocks are a hash of row_id. The model state is rows
(block, feature, w, lag) and one row of scalars per block; nothing is mutated, every step maps old rows
to new ones, so lost tasks can be recomputed. The global step is a group-by on feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix.functions import exprs
from quorix.models import kernels_lr as K
from quorix.operators import metrics
from quorix.operators.partition import even_block, hash_block
from quorix.schema import LrParams, LrStrategy, Regularizer
from quorix.session import release, ship_package, snapshot

_OUT = pa.schema([("block", pa.int32()), ("feature", pa.int32()), ("w", pa.float64()), ("lag", pa.float64()), ("gamma", pa.float64()), ("gse", pa.float64())])
#: Groups in which the elastic global step runs; a group holds whole features.
ELASTIC_BUCKETS = 256
_OUT_DDL = "block int, feature int, w double, lag double, gamma double, gse double"


@dataclass
class LrModel:
    """weights (feature, w) and history (iteration, metric, value)."""

    weights: DataFrame
    history: DataFrame


def blocked(vectors: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """Vectors with `block`: their own column of this name, else a hash of row_id."""
    return vectors if "block" in vectors.columns else vectors.withColumn("block", even_block(vectors.sparkSession, blocks, hash_block(blocks, "row_id", seed=seed)))


def _design(data: pa.Table) -> tuple[K.Design, np.ndarray, np.ndarray, pa.Array]:
    """The block's matrix in row_id order, its labels, its sorted features and the row ids."""
    data = data.take(pa.array(np.argsort(data["row_id"].to_numpy(), kind="stable")))
    idx, val = data["idx"].combine_chunks(), data["val"].combine_chunks()
    lengths = np.asarray(idx.value_lengths().fill_null(0)).astype(np.int64)
    values = np.ones(int(lengths.sum()))
    values[np.repeat(np.asarray(val.is_valid()), lengths)] = np.asarray(val.flatten(), np.float64)
    known, cols = np.unique(np.asarray(idx.flatten()), return_inverse=True)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return K.Design(len(lengths), len(known), rows, cols, values), np.asarray(data["label"].to_numpy(), np.float64), known, data["row_id"].combine_chunks()


_ROUTED = {
    "scores": pa.schema([("row_id", pa.int64()), ("label", pa.int32()), ("score", pa.float64())]),
    "gradient": pa.schema([("feature", pa.int32()), ("g", pa.float64())]),
    "curvature": pa.schema([("h", pa.float64())]),
}


def _routed(kind: str):  # noqa: ANN202
    """A block's scores, partial gradient or partial curvature from its vectors and the weights of its features."""
    schema = _ROUTED[kind]

    def run(data: pa.Table, weights: pa.Table) -> pa.Table:
        if not data.num_rows:
            return pa.Table.from_batches([], schema)
        x, y, known, ids = _design(data)
        w, d = np.zeros(len(known)), np.zeros(len(known))
        at = np.searchsorted(known, weights["feature"].to_numpy())
        w[at] = weights["w"].to_numpy()
        if kind == "scores":
            columns = [ids, pa.array(y.astype(np.int32)), pa.array(x.times(w))]
        elif kind == "gradient":
            columns = [pa.array(known.astype(np.int32)), pa.array(K.gradient(x, y, w))]
        else:
            d[at] = weights["d"].to_numpy()
            columns = [pa.array([K.curvature(x, y, w, d)])]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


@dataclass
class Blocks:
    """Vectors that stay where they are, in blocks, and (block, feature): which block needs which weight.

    A weight travels once to each block that holds its feature; partial gradients come back as one row per
    block and feature. The vectors themselves are shuffled once, when the blocks are made.
    """

    data: DataFrame
    links: DataFrame

    @staticmethod
    def of(vectors: DataFrame, blocks: int, seed: int = 0) -> Blocks:
        picked = blocked(vectors, blocks, seed).select("row_id", "label", "idx", F.col("val").cast("array<double>").alias("val"), "block")
        data = picked.repartition(blocks, "block").persist(StorageLevel.MEMORY_AND_DISK)
        links = data.select("block", F.explode("idx").alias("feature")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        return Blocks(data, links)

    def release(self) -> None:
        self.data.unpersist()
        self.links.unpersist()

    def _run(self, kind: str, weights: DataFrame) -> DataFrame:
        ship_package(self.data.sparkSession)
        routed = self.links.join(weights, "feature").toDF("feature", "block", *weights.columns[1:])  # columns of its own
        ddl = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'double'}" for f in _ROUTED[kind])
        return self.data.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(_routed(kind), ddl)

    def scores(self, weights: DataFrame) -> DataFrame:
        """(row_id, label, score): w . x; features without weight count 0."""
        return self._run("scores", weights.select("feature", "w"))

    def gradient(self, weights: DataFrame) -> DataFrame:
        """(feature, g): sum over rows of y (1 - sigmoid(margin)) x."""
        return self._run("gradient", weights.select("feature", "w")).groupBy("feature").agg(F.sum("g").alias("g"))

    def curvature(self, weights: DataFrame) -> DataFrame:
        """One row, h: sum over rows of max(s (1 - s), 1e-5) (d . x)^2 with s the sigmoid of the margin; weights (feature, w, d)."""
        return self._run("curvature", weights.select("feature", "w", "d")).agg(F.sum("h").alias("h"))


def _local_step(p: LrParams, strategy: LrStrategy, rho: float):  # noqa: ANN202
    """The cogrouped function: a block's data and its state with priors give its new state."""
    opt = p.resolved().value if strategy is not LrStrategy.DGM else "CG"

    def run(data: pa.Table, state: pa.Table) -> pa.Table:
        if not data.num_rows:
            return pa.Table.from_batches([], _OUT)
        x, y, known, _ = _design(data)
        w, lag, prior, gamma = np.zeros(len(known)), np.zeros(len(known)), np.zeros(len(known)), p.gamma
        if state.num_rows:
            at = np.searchsorted(known, state["feature"].to_numpy())
            w[at], lag[at], prior[at] = (state[c].to_numpy() for c in ("w", "lag", "prior"))
            gamma = float(state["gamma"][0].as_py())
            if p.ard:
                gamma = np.full(len(known), p.gamma)
                gamma[at] = state["gamma"].to_numpy()
        intercept = 0 if len(known) and known[0] == 0 else -1
        gse = 0.0
        target = np.zeros(len(known))
        weight = p.reg
        if strategy in (LrStrategy.ADMM, LrStrategy.HECMEM):
            lag = lag + w - prior
            target = prior - lag
        elif strategy is LrStrategy.HMEM:
            target = prior
        if strategy is LrStrategy.ADMM:
            weight = p.rho
        if strategy in (LrStrategy.HMEM, LrStrategy.HECMEM):
            w, gamma, gse = K.solve_cd(x, y, w, target, p.inner, rho, gamma, p.bound, em_bayes=True, ard=p.ard, l1=p.elastic, stop=p.inner_stop)
        elif opt == "CD":
            w, _, _ = K.solve_cd(x, y, w, target, p.inner, 1.0, weight, p.bound, l1=p.elastic, stop=p.inner_stop)
        elif p.t_prior is not None:
            w = K.solve_t_prior(x, y, w, target, p.inner, *p.t_prior, stop=p.inner_stop, intercept=intercept)
            gamma, gse = K.t_weight(w, target, *p.t_prior)
        else:
            w = K.solve_gradient(x, y, w, target, weight, p.inner, opt, intercept, clip=p.clip, stop=p.inner_stop)
        n = len(known)
        block = data["block"][0].as_py()
        columns = [np.full(n, block, np.int32), known.astype(np.int32), w, lag, np.broadcast_to(np.asarray(gamma, np.float64), n), np.full(n, gse)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_OUT)

    return run


def _with_prior(state: DataFrame, weights: DataFrame) -> DataFrame:
    """Route the global weights to the blocks that hold the feature."""
    return state.join(weights.select("feature", F.col("w").alias("prior")), "feature", "left").select("block", "feature", "w", "lag", F.coalesce("prior", F.lit(0.0)).alias("prior"), "gamma")


def block_step(data: DataFrame, state: DataFrame, weights: DataFrame, p: LrParams, strategy: LrStrategy, rho: float) -> DataFrame:
    """(block, feature, w, lag, gamma, gse): all blocks solved locally once."""
    return data.groupBy("block").cogroup(_with_prior(state, weights).groupBy("block")).applyInArrow(_local_step(p, strategy, rho), _OUT_DDL)


def global_step(state: DataFrame, p: LrParams, strategy: LrStrategy) -> DataFrame:
    """(feature, w): plain average over the blocks holding the feature, or the precision-weighted prox.

    With `elastic`, the minimum of each feature's absolute and squared distances from its blocks.
    """
    w = F.col("w") + F.col("lag") if p.include_dual else F.col("w")
    if strategy in (LrStrategy.HMEM, LrStrategy.HECMEM) and p.elastic > 0:
        ship_package(state.sparkSession)
        # a feature has at most one row per block
        rows = state.select("feature", w.alias("w"), "gamma", F.pmod(F.xxhash64("feature"), F.lit(ELASTIC_BUCKETS)).alias("bucket"))
        return rows.groupBy("bucket").applyInArrow(_elastic(p.elastic, p.reg), "feature int, w double")
    if strategy in (LrStrategy.HMEM, LrStrategy.HECMEM):
        sums = state.groupBy("feature").agg(F.sum(F.col("gamma") * w).alias("num"), F.sum("gamma").alias("den"))
        prox = exprs.l1_prox if Regularizer(p.regularizer) is Regularizer.L1 else exprs.l2_prox
        return sums.select("feature", prox(F.col("num"), F.col("den"), p.reg).alias("w"))
    return state.groupBy("feature").agg(F.avg(w).alias("w"))


def _elastic(eta: float, lam: float):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("feature", "ascending"), ("w", "ascending")])
        feature, w, gamma = (group[c].to_numpy() for c in ("feature", "w", "gamma"))
        first = np.nonzero(np.diff(feature, prepend=feature[:1] - 1))[0]
        last = np.append(first[1:], len(feature))
        found = [K.global_scalar(w[a:b], np.full(b - a, eta), gamma[a:b], lam) for a, b in zip(first, last)]
        return pa.table({"feature": pa.array(feature[first], pa.int32()), "w": pa.array(found, pa.float64())})

    return run


def new_rho(state: DataFrame) -> float:
    """Features of all blocks over the sum of gamma * squared error."""
    per_block = state.groupBy("block").agg(F.count(F.lit(1)).alias("p"), F.max("gse").alias("gse"))
    r = per_block.agg(F.sum("p").alias("p"), F.sum("gse").alias("gse")).first()
    return float(r["p"] / r["gse"]) if r["gse"] else 1.0


def evaluate(blocks: Blocks, weights: DataFrame, p: LrParams) -> dict[str, float]:
    """AUC, log-likelihood and objective, in one pass over the data."""
    r = metrics.evaluation(blocks.scores(weights), weights, p.reg, Regularizer(p.regularizer).value).first()
    return {k: float("nan") if r[k] is None else r[k] for k in ("auc", "llh", "objective")}


def fit_lr(vectors: DataFrame, p: LrParams | None = None, validate: DataFrame | None = None) -> LrModel:
    """Train; metrics are taken on `validate` (default: the training data) after each outer iteration.

    Stops when the AUC changes by at most `stop_auc` or reaches `target_auc`. Features that never occur keep weight 0;
    an empty table gives an empty model and no history. A column `block` of `vectors` assigns the blocks.
    """
    p = p or LrParams()
    strategy = LrStrategy(p.strategy)
    p.resolved()
    spark = vectors.sparkSession
    blocks = Blocks.of(vectors, p.blocks, p.seed)
    test = blocks if validate is None else Blocks.of(validate, p.blocks, p.seed)
    history: list[tuple[int, str, float]] = []
    none = spark.createDataFrame([], "feature int, w double")
    try:
        run = _exact(blocks, p) if strategy is LrStrategy.DGM else _blockwise(blocks.data, p, strategy, none)
        weights, last = none, None
        for t, weights in enumerate(run):
            found = evaluate(test, weights, p)
            history += [(t, k, float(v)) for k, v in found.items()]
            if (last is not None and abs(found["auc"] - last) <= p.stop_auc) or (p.target_auc < 1 and found["auc"] >= p.target_auc):
                break
            last = found["auc"]
    finally:
        blocks.release()
        test.release()
    return LrModel(weights, spark.createDataFrame(history, "iteration int, metric string, value double"))


def _blockwise(data: DataFrame, p: LrParams, strategy: LrStrategy, none: DataFrame) -> Iterator[DataFrame]:
    spark = data.sparkSession
    empty = spark.createDataFrame([], "block int, feature int, w double, lag double, gamma double")
    solver = LrStrategy.AVGM if strategy in (LrStrategy.SAVGM, LrStrategy.MEM) else strategy
    state, weights, rho = empty, none, p.rho
    sample = data.where(F.pmod(F.xxhash64(F.lit(p.seed + 7), "row_id"), F.lit(1_000_000)) < int(p.subsample * 1_000_000)) if strategy is LrStrategy.SAVGM else None
    for _ in range(p.outer):
        state = snapshot(block_step(data, state, weights, p, solver, rho), replaces=state)
        weights = snapshot(global_step(state, p, solver), replaces=weights)
        if solver in (LrStrategy.HMEM, LrStrategy.HECMEM):
            rho = new_rho(state)
        if sample is None:
            yield weights
            continue
        # bootstrap correction: the subsample model always starts from zero
        small = global_step(block_step(sample, empty, none, p, LrStrategy.AVGM, rho), p, LrStrategy.AVGM)
        both = weights.join(small.withColumnRenamed("w", "w2"), "feature", "left")
        yield snapshot(both.select("feature", exprs.savgm_fix(F.col("w"), F.coalesce("w2", F.col("w")), p.subsample).alias("w")))


def _exact(blocks: Blocks, p: LrParams) -> Iterator[DataFrame]:
    """Driver loop of gradient, direction, curvature and step; all vectors stay DataFrames of (feature, ...)."""
    w = snapshot(blocks.links.select("feature").distinct().select("feature", F.lit(0.0).alias("w")))
    last: DataFrame | None = None
    kept: DataFrame | None = None
    pair: DataFrame | None = None
    lam = F.when(F.col("feature") == 0, F.lit(0.0)).otherwise(F.lit(p.reg))
    for t in range(p.outer):
        g = blocks.gradient(w).join(w, "feature").select("feature", "w", (F.col("g") - lam * F.col("w")).alias("g"))
        if t < 2:
            now = g.withColumn("d", F.col("g"))
        else:
            pair = g.join(last.select("feature", F.col("g").alias("g0"), F.col("d").alias("d0"), F.col("s").alias("s0")), "feature")
            dg = F.col("g") - F.col("g0")
            pair = snapshot(pair)
            r = pair.agg(
                F.sum(F.col("d0") * dg).alias("d_dg"), F.sum(F.col("g") * dg).alias("g_dg"), F.sum(F.col("s0") * dg).alias("s_dg"), F.sum(dg * dg).alias("dg_dg"), F.sum(F.col("s0") * F.col("g")).alias("s_g")
            ).first()
            if p.resolved().value == "CG":
                beta = r["g_dg"] / r["d_dg"] if r["d_dg"] else 0.0
                d = F.col("g") - F.col("d0") * F.lit(beta)
            elif r["s_dg"]:
                b = 1 + r["dg_dg"] / r["s_dg"]
                a_g = r["s_g"] / r["s_dg"]
                a_w = r["g_dg"] / r["s_dg"] - b * a_g
                d = -F.col("g") + F.lit(a_w) * F.col("s0") + F.lit(a_g) * dg
            else:
                d = F.col("g")
            now = pair.select("feature", "w", "g", d.alias("d"))
        now = snapshot(now, replaces=kept)
        release(pair)
        kept = now
        h = blocks.curvature(now).first()["h"] or 0.0
        r = now.agg(F.sum(F.col("g") * F.col("d")).alias("gd"), F.sum(lam * F.col("d") * F.col("d")).alias("reg")).first()
        den = h + (r["reg"] or 0.0)
        size = r["gd"] / den if den else 0.0
        last = now.withColumn("s", F.col("d") * F.lit(size))
        w = snapshot(last.select("feature", (F.col("w") + F.col("s")).alias("w")), replaces=w)
        yield w
