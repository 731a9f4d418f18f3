"""Three-way (tensor) factorization over a grid of blocks, with optional smoothing over time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix.models import consensus as C
from quorix.models import kernels_tf as K
from quorix.operators.partition import cube_block, even_block, hash_block, modulo_block
from quorix.schema import Regularizer, TfParams
from quorix.session import snapshot

#: Most ids of the time dimension for which the sequential sweep runs on the driver.
MOST_TIMES = 100_000


@dataclass
class TfModel:
    """factors (dim, id, f), dims 0 to 2; history (iteration, metric, value)."""

    factors: DataFrame
    history: DataFrame


def fit_tf(cells: DataFrame, p: TfParams | None = None, validate: DataFrame | None = None) -> TfModel:
    """Train on (i, j, k, value). Cells with a null part or NaN are left out.

    The first outer iteration is MAP without priors. The third dimension is frozen (at ones) unless
    `time_factors`, and during the first `frozen_outer` iterations; inner rounds shrink as
    max(inner - 2 t, 2). Precisions are learned with VB and no dual.
    """
    p = p or TfParams()
    spark = cells.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        clean = df.select(*(F.col(c).cast("int").alias(f"c{d}") for d, c in enumerate("ijk")), F.col("value").cast("double").alias("value"))
        return clean.dropna().where(~F.isnan("value"))

    n1, n2, n3 = p.blocks
    blocks = [modulo_block(f"c{d}", n) if p.block_by == "modulo" else hash_block(n, f"c{d}", seed=p.seed + d) for d, n in enumerate(p.blocks)]
    data = prepared(cells).withColumn("block", even_block(spark, n1 * n2 * n3, cube_block(blocks[0], blocks[1], blocks[2], n2, n3))).repartition(n1 * n2 * n3, "block").persist(StorageLevel.MEMORY_AND_DISK)
    test = (data.drop("block") if validate is None else prepared(validate)).persist(StorageLevel.MEMORY_AND_DISK)
    split = [n1 * n2 * n3 // n > 1 for n in p.blocks]
    sw = C.Switches(prior=p.prior, dual=p.dual, has_prior=tuple(split))
    own_only = F.lit(False)
    for d in range(3):
        own_only = own_only | ((F.col("dim") == d) & F.lit(not split[d]))
    state, factors = C.empty_state(cells), C.empty_factors(cells)
    history: list[tuple[int, str, float]] = []
    for t in range(p.outer):
        frozen = (False, False, not p.time_factors or t < p.frozen_outer)
        rounds = max(p.inner - 2 * t, 2)

        def solver(coords, values, fs, priors, precs, gammas, first, frozen=frozen, rounds=rounds):  # noqa: ANN001, ANN202
            got = K.solve_block(coords, values, fs, priors, gammas, rounds, vb=p.vb and not first, precs=precs, frozen=frozen, em_bayes=p.vb and not p.dual and not first)
            return got["factors"], got["precs"], got["gammas"], got["se"]

        run = C.block_function(solver, 3, p.rank, sw, t == 0, p.gamma, p.seed)
        state = snapshot(C.block_step(data, state, factors, run, p.rank), replaces=state)
        merged = C.global_step(state, lam=p.reg, regularizer=Regularizer(p.regularizer).value, dual=p.dual, weighted=False, plain=False, own_only=own_only)
        if p.markov is not None:
            merged = merged.where("dim <> 2").unionByName(smooth_times(state, factors, p.markov, p.dual, p.rank))
        if frozen[2]:
            merged = merged.where("dim <> 2").unionByName(state.where("dim = 2").select("dim", "id", "f").dropDuplicates(["dim", "id"]))
        factors = snapshot(merged, replaces=factors)
        history += [(t, "local_rmse", C.local_rmse(state)), (t, "rmse", C.rmse(test, factors, 3))]
    data.unpersist()
    test.unpersist()
    return TfModel(factors, spark.createDataFrame(history, "iteration int, metric string, value double"))


def smooth_times(state: DataFrame, factors: DataFrame, lam: float, dual: bool, rank: int) -> DataFrame:
    """(dim, id, f) of the time dimension after one sweep in id order; ids must be at most MOST_TIMES."""
    value = F.col("e.f") + F.col("e.lag") if dual else F.col("e.f")
    sums = state.where("dim = 2").select("id", F.posexplode(F.arrays_zip("f", "lag", "gamma")).alias("k", "e")).groupBy("id", "k").agg(F.sum(F.col("e.gamma") * value).alias("s"), F.sum("e.gamma").alias("g"))
    rows = sums.orderBy("id", "k").limit(MOST_TIMES * rank + 1).collect()
    if len(rows) > MOST_TIMES * rank:
        raise ValueError(f"more than {MOST_TIMES} times: use a coarser bucket")
    ids = sorted({r["id"] for r in rows})
    at = {i: n for n, i in enumerate(ids)}
    s, g = np.zeros((len(ids), rank)), np.zeros((len(ids), rank))
    for r in rows:
        s[at[r["id"]], r["k"]], g[at[r["id"]], r["k"]] = r["s"], r["g"]
    start = np.zeros_like(s)
    for r in factors.where("dim = 2").collect():
        if r["id"] in at:
            start[at[r["id"]]] = r["f"]
    f = K.markov_sweep(s, g, lam, start)
    return state.sparkSession.createDataFrame([(2, int(i), [float(x) for x in f[at[i]]]) for i in ids], "dim int, id int, f array<double>")
