"""The outer loop shared by two- and three-way factorizations over a grid of blocks.

Data are rows (block, c0, c1[, c2], value). State is one row per (block, dim, id) with factor, precision,
dual and the block's gammas; it is never mutated. One outer iteration is: route the global factors to the
blocks that hold the id (an equi-join), solve every block (one cogrouped function), sum the weighted
factors per id and apply the prox (a group-by).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorix.functions import exprs
from quorix.operators import metrics
from quorix.operators.counts import keyed_vector_sums

STATE_DDL = "block int, dim int, id int, f array<double>, prec array<double>, lag array<double>, gamma array<double>, n_obs double, se double"
_LIST = pa.list_(pa.float64())
_STATE = pa.schema(
    [("block", pa.int32()), ("dim", pa.int32()), ("id", pa.int32()), ("f", _LIST), ("prec", _LIST), ("lag", _LIST), ("gamma", _LIST), ("n_obs", pa.float64()), ("se", pa.float64())]
)

#: A block solver: (coords, values, factors, priors, precs, gammas, first) -> (factors, precs, gammas, se)
Solver = Callable[..., tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], float]]


@dataclass(frozen=True)
class Switches:
    """What distinguishes the strategies: prior in the local solve, dual, and which dimensions have priors."""

    prior: bool
    dual: bool
    has_prior: tuple[bool, ...]


def _lists(x: np.ndarray) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def _matrix(column: pa.ChunkedArray, k: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, k)


def initial_factors(ids: np.ndarray, dim: int, k: int, dims: int, seed: int) -> np.ndarray:
    """Dimension 0: 0.1 (U - .5) seeded by the id itself, so every block starts alike. The other dimension
    of a matrix starts at 0; of a tensor, dimension 1 at 0 and dimension 2 at 1."""
    if dim == 2:
        return np.ones((len(ids), k))
    if dim == 1:
        return np.zeros((len(ids), k))
    x = (ids.astype(np.int64)[:, None] * 1000003 + np.arange(k)[None, :] * 7919 + seed * 104729).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # finalizer of a splittable generator
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return 0.1 * (u - 0.5)


def block_function(solver: Solver, dims: int, k: int, sw: Switches, first: bool, gamma0: tuple[float, ...], seed: int):  # noqa: ANN201
    names = [f"c{d}" for d in range(dims)]

    def run(data: pa.Table, state: pa.Table) -> pa.Table:
        if not data.num_rows:
            return pa.Table.from_batches([], _STATE)
        raw = [data[c].to_numpy() for c in names]
        values = data["value"].to_numpy().astype(np.float64)
        order = np.lexsort((values, *raw[::-1]))  # float sums then don't depend on the shuffle's order
        values = values[order]
        ids, local = zip(*(np.unique(x[order], return_inverse=True) for x in raw))
        coords = np.stack(local, 1)
        factors, precs, lags, priors, gammas = [], [], [], [], []
        dim = state["dim"].to_numpy() if state.num_rows else np.empty(0, np.int32)
        for d in range(dims):
            f = initial_factors(ids[d], d, k, dims, seed)
            prec, lag, prior = np.full(f.shape, np.inf), np.zeros(f.shape), np.zeros(f.shape)
            gamma = np.full(k, gamma0[d])
            mine = np.nonzero(dim == d)[0]
            if len(mine):
                part = state.take(pa.array(mine))
                at = np.searchsorted(ids[d], part["id"].to_numpy())
                f[at], prec[at], lag[at], prior[at] = (_matrix(part[c], k) for c in ("f", "prec", "lag", "prior"))
                gamma = np.asarray(part["gamma"][0].as_py())
            active = sw.prior and sw.has_prior[d] and not first
            if active and sw.dual:
                lag = lag + f - prior
                prior = prior - lag
            if not active:
                prior = np.zeros(f.shape)
            for out, x in zip((factors, precs, lags, priors, gammas), (f, prec, lag, prior, gamma)):
                out.append(x)
        factors, precs, gammas, se = solver(coords, values, factors, priors, precs, gammas, first)
        parts = []
        block = data["block"][0].as_py()
        for d in range(dims):
            n = len(ids[d])
            parts.append(
                pa.Table.from_arrays(
                    [
                        pa.array(np.full(n, block, np.int32)),
                        pa.array(np.full(n, d, np.int32)),
                        pa.array(ids[d].astype(np.int32)),
                        _lists(factors[d]),
                        _lists(precs[d]),
                        _lists(lags[d]),
                        _lists(np.tile(gammas[d], (n, 1))),
                        pa.array(np.bincount(coords[:, d], minlength=n).astype(np.float64)),
                        pa.array(np.full(n, se)),
                    ],
                    schema=_STATE,
                )
            )
        return pa.concat_tables(parts)

    return run


def empty_state(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], STATE_DDL)


def empty_factors(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "dim int, id int, f array<double>")


def block_step(data: DataFrame, state: DataFrame, factors: DataFrame, run: Callable, k: int) -> DataFrame:
    """Route the global factors to the blocks' states and solve all blocks once."""
    routed = state.join(factors.select("dim", "id", F.col("f").alias("prior")), ["dim", "id"], "left")
    routed = routed.select("block", "dim", "id", "f", "prec", "lag", F.coalesce("prior", F.array_repeat(F.lit(0.0), k)).alias("prior"), "gamma")
    return data.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(run, STATE_DDL)


def global_step(state: DataFrame, *, lam: float, regularizer: str, dual: bool, weighted: bool, plain: bool, own_only: Column, blocks: bool = False) -> DataFrame:
    """(dim, id, f): sums of gamma (f [+ lag]) and gamma per id and factor, then the prox.

    `plain` averages with equal weights. An id in one block gets 0, except in the dimensions for which
    `own_only` holds (the other dimensions have a single block): they take the local factors. `blocks` adds
    the sorted list of the contributing blocks.
    """
    n = F.when(F.lit(weighted), F.col("n_obs")).otherwise(F.lit(1.0))
    g = F.transform("gamma", lambda _: F.lit(1.0)) if plain else F.transform("gamma", lambda x: x * n)
    value = F.zip_with("f", "lag", lambda f, u: f + u) if dual else F.col("f")
    stats = state.select("dim", "id", "f", F.zip_with(g, value, lambda w, v: w * v).alias("num"), g.alias("den"), *(["block"] if blocks else []))
    sums = keyed_vector_sums(stats, ["dim", "id"], only="f")
    rows = sums.groupBy("dim", "id").agg(F.array_sort(F.collect_list(F.struct("k", "num", "den", "only"))).alias("v"), F.max("n_blocks").alias("n_blocks"))
    num, den = F.col("v.num"), F.col("v.den")
    if regularizer == "MAX":
        merged = exprs.max_norm(num, den, lam if lam > 0 else float("inf"))
    else:
        prox = exprs.l1_prox if regularizer == "L1" else exprs.l2_prox
        merged = F.zip_with(num, den, lambda a, b: prox(a, b, lam))
    f = F.when(own_only, F.col("v.only")).when(F.col("n_blocks") <= 1, F.transform("v", lambda _: F.lit(0.0))).otherwise(merged)
    out = rows.select("dim", "id", f.alias("f"))
    if blocks:
        # at most one entry per block
        out = out.join(state.groupBy("dim", "id").agg(F.array_sort(F.collect_set("block")).alias("blocks")), ["dim", "id"])
    return out


def mean_gamma(state: DataFrame, per_block: bool = False) -> DataFrame:
    """(dim, gamma): each dimension's precisions averaged over the blocks; `per_block`: (dim, block, gamma), the mean of each block's."""
    of_block = state.groupBy("dim", "block").agg(F.first("gamma").alias("gamma"))  # equal in all rows of a block
    if per_block:
        return of_block.select("dim", "block", (F.aggregate("gamma", F.lit(0.0), lambda s, x: s + x) / F.size("gamma")).alias("gamma"))
    means = of_block.select("dim", F.posexplode("gamma").alias("k", "g")).groupBy("dim", "k").agg(F.avg("g").alias("g"))
    return means.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("v")).select("dim", F.col("v.g").alias("gamma"))


def rmse(data: DataFrame, factors: DataFrame, dims: int, scale: float = 1.0) -> float:
    """Root mean squared error; an id without factor counts as the zero vector."""
    return float(metrics.rmse(metrics.predicted(data, factors, dims), scale).first()["rmse"] or 0.0)


def local_rmse(state: DataFrame, scale: float = 1.0) -> float:
    """From the blocks' own squared errors."""
    per = state.where(F.col("dim") == 0).groupBy("block").agg(F.max("se").alias("se"), F.sum("n_obs").alias("n"))
    r = per.agg(F.sum("se").alias("se"), F.sum("n").alias("n")).first()
    return float(np.sqrt(r["se"] / r["n"]) * scale) if r["n"] else 0.0
