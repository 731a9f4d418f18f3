"""Matrix factorization: exact distributed half-steps (dMAP, dVB) and the block strategies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix.models import consensus as C
from quorix.models import kernels_mf as K
from quorix.operators.partition import even_block, groups_for, hash_block, rating_blocks
from quorix.schema import MfParams, MfStrategy, Regularizer
from quorix.session import ship_package, snapshot

#: Ratings whose products are held at once.
PIECE = 1 << 16
#: Ratings of a block of an exact run.
BLOCK_RATINGS = 1_000_000
FACTOR_DDL = "id int, f array<double>, prec array<double>"


@dataclass
class MfModel:
    """factors (dim, id, f), dim 0 rows and 1 columns; history (iteration, metric, value).

    Block strategies also leave `state`, one row per block, dimension and id, with the blocks' gammas.
    """

    factors: DataFrame
    history: DataFrame
    state: DataFrame | None = None

    def mean_gamma(self, per_block: bool = False) -> DataFrame:
        """(dim, gamma[, block]): the precisions of each dimension, averaged over the blocks, or each block's mean."""
        return C.mean_gamma(self.state, per_block)

    def predict(self, ratings: DataFrame) -> DataFrame:
        from quorix.operators.metrics import predictions

        side = lambda d: self.factors.where(F.col("dim") == d).select("id", "f")
        return predictions(ratings, side(0), side(1))


def _prepared(ratings: DataFrame, p: MfParams) -> DataFrame:
    value = (F.col("value").cast("double") - F.lit(p.mean)) / F.lit(p.scale)
    clean = ratings.where(F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    return clean.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value.alias("value"))


def fit_mf(ratings: DataFrame, p: MfParams | None = None, validate: DataFrame | None = None) -> MfModel:
    """Train on (row, col, value). Records with a null index or value, or NaN, are left out; duplicate cells
    count as several observations; an empty table gives an empty model.
    """
    p = p or MfParams()
    method = p.resolved()
    strategy = MfStrategy(p.strategy)
    spark = ratings.sparkSession
    train = _prepared(ratings, p)
    test = (train if validate is None else _prepared(validate, p)).withColumnsRenamed({"row": "c0", "col": "c1"}).persist(StorageLevel.MEMORY_AND_DISK)
    history: list[tuple[int, str, float]] = []
    run = _exact(train, p, method.value) if strategy in (MfStrategy.DMAP, MfStrategy.DVB) else _blockwise(train, p, strategy, method.value, history)
    factors, state = C.empty_factors(ratings), None
    for t, (factors, state) in enumerate(run):
        history.append((t, "rmse", C.rmse(test, factors, 2, p.scale)))
    test.unpersist()
    return MfModel(factors, spark.createDataFrame(history, "iteration int, metric string, value double"), state)


def _blockwise(train: DataFrame, p: MfParams, strategy: MfStrategy, method: str, history: list) -> Iterator[tuple[DataFrame, DataFrame]]:
    vb = strategy in (MfStrategy.MEM, MfStrategy.HMEM, MfStrategy.HECMEM) or p.vb
    em = vb and p.em_bayes
    sw = C.Switches(
        prior=strategy in (MfStrategy.HMEM, MfStrategy.HECMEM, MfStrategy.ADMM),
        dual=strategy in (MfStrategy.HECMEM, MfStrategy.ADMM),
        has_prior=(p.col_blocks > 1, p.row_blocks > 1),
    )
    lam = p.reg if sw.prior else 0.0

    def solver(coords, values, factors, priors, precs, gammas, first):  # noqa: ANN001, ANN202
        use_vb = vb and not first
        got = K.solve_block(
            coords[:, 0], coords[:, 1], values, factors[0], factors[1], prior_r=priors[0], prior_c=priors[1], gamma_r=gammas[0], gamma_c=gammas[1],
            rounds=p.inner, method=method, vb=use_vb, prec_r=precs[0], prec_c=precs[1], weighted=p.weighted, em_bayes=em and not first, stop=p.stop,
        )
        return [got["fr"], got["fc"]], [got["prec_r"], got["prec_c"]], [got["gamma_r"], got["gamma_c"]], float(got["se"][0])

    grid = rating_blocks(train, p.row_blocks, p.col_blocks, by=p.block_by, seed=p.seed)
    n = p.row_blocks * p.col_blocks
    data = grid.select(even_block(train.sparkSession, n, F.col("block")).alias("block"), F.col("row").alias("c0"), F.col("col").alias("c1"), "value").repartition(n, "block").persist(StorageLevel.MEMORY_AND_DISK)
    state, factors = C.empty_state(train), C.empty_factors(train)
    own_only = ((F.col("dim") == 0) & F.lit(p.col_blocks == 1)) | ((F.col("dim") == 1) & F.lit(p.row_blocks == 1))
    for t in range(p.outer):
        run = C.block_function(solver, 2, p.rank, sw, t == 0, (p.gamma, p.gamma if p.gamma_cols is None else p.gamma_cols), p.seed)
        state = snapshot(C.block_step(data, state, factors, run, p.rank), replaces=state)
        merged = C.global_step(state, lam=lam, regularizer=Regularizer(p.regularizer).value, dual=sw.dual, weighted=p.weighted, plain=strategy is MfStrategy.AVGM, own_only=own_only)
        factors = snapshot(merged, replaces=factors)
        history.append((t, "local_rmse", C.local_rmse(state, p.scale)))
        yield factors, state
    data.unpersist()


# --- exact half-steps -------------------------------------------------------------------------------


def triangle(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each element of the packed upper triangle of a k x k matrix."""
    return np.triu_indices(k)


def _packed_width(k: int) -> int:
    return k * (k + 1) // 2 + 2 * k


def _pack(k: int):  # noqa: ANN202
    """Per id of a block: number of ratings, upper triangle of X'X, X'y and the sum of 1/prec, as one flat array."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.float64()), ("packed", pa.list_(pa.float64()))])
    a, b = triangle(k)

    def run(data: pa.Table, factors: pa.Table) -> pa.Table:
        if not data.num_rows or not factors.num_rows:
            return pa.Table.from_batches([], schema)
        known = factors["other"].to_numpy()
        order = np.argsort(known)
        known, f, inv = known[order], C._matrix(factors["f"], k)[order], 1 / C._matrix(factors["prec"], k)[order]
        ids, other, y = (data[c].to_numpy() for c in ("id", "other", "value"))
        at = np.minimum(np.searchsorted(known, other), len(known) - 1)
        met = known[at] == other
        ids, at, y = ids[met], at[met], y[met]
        order = np.lexsort((y, at, ids))  # float sums then don't depend on the shuffle's order
        ids, at, y = ids[order], at[order], y[order]
        out_ids, out_n, out = [], [], []
        # pieces bound the memory of the products; an id in two pieces gives two rows
        for i in range(0, len(ids), PIECE):
            piece, x = ids[i : i + PIECE], f[at[i : i + PIECE]]
            first = np.nonzero(np.diff(piece, prepend=piece[0] - 1))[0]
            terms = np.concatenate([x[:, a] * x[:, b], x * y[i : i + PIECE, None], inv[at[i : i + PIECE]]], 1)
            out_ids.append(piece[first])
            out_n.append(np.diff(np.append(first, len(piece))).astype(np.float64))
            out.append(np.add.reduceat(terms, first, axis=0))
        if not out:
            return pa.Table.from_batches([], schema)
        return pa.Table.from_arrays([pa.array(np.concatenate(out_ids), pa.int32()), pa.array(np.concatenate(out_n)), C._lists(np.concatenate(out))], schema=schema)

    return run


def _solve(k: int, method: str, vb: bool, lam: float, weighted: bool):  # noqa: ANN202
    """Merge the packed sums of each id of a bucket and solve: ridge system, or one coordinate sweep from the old factor."""
    schema = pa.schema([("id", pa.int32()), ("f", pa.list_(pa.float64())), ("prec", pa.list_(pa.float64()))])
    up, down = triangle(k)
    t = len(up)

    def run(group: pa.Table, old: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.Table.from_batches([], schema)
        packed, n, ids = C._matrix(group["packed"], _packed_width(k)), group["n"].to_numpy(), group["id"].to_numpy()
        order = np.lexsort((packed[:, 0], ids))
        packed, n, ids = packed[order], n[order], ids[order]
        first = np.nonzero(np.diff(ids, prepend=ids[0] - 1))[0]
        packed, n, ids = np.add.reduceat(packed, first, axis=0), np.add.reduceat(n, first), ids[first]
        a = np.zeros((len(ids), k, k))
        a[:, up, down] = a[:, down, up] = packed[:, :t]
        b, inv = packed[:, t : t + k], packed[:, t + k :]
        ridge = lam * (n if weighted else np.ones(len(n)))
        prec = np.full((len(ids), k), np.inf)
        if method == "ALS":
            f = np.linalg.solve(a + (ridge[:, None, None] + 1e-12) * np.eye(k), b[:, :, None])[:, :, 0]
        else:
            f = np.zeros((len(ids), k))
            if old.num_rows:
                at = np.searchsorted(ids, old["id"].to_numpy())
                ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == old["id"].to_numpy())
                f[at[ok]] = C._matrix(old["f"], k)[ok]
            for j in range(k):
                den = a[:, j, j] + (inv[:, j] if vb else 0.0) + ridge
                rest = b[:, j] - np.einsum("nk,nk->n", a[:, j, :], f) + a[:, j, j] * f[:, j]
                f[:, j] = np.divide(rest, den, out=np.zeros(len(ids)), where=den > 0)
                if vb:
                    prec[:, j] = np.maximum(den, 1e-12)
        return pa.Table.from_arrays([pa.array(ids.astype(np.int32)), C._lists(f), C._lists(prec)], schema=schema)

    return run


@dataclass
class Links:
    """Ratings blocked by one side's id, (id, other, value, block), and the blocks that need each factor of the
    other side, (other, block).

    The ratings are shuffled once; in each half-step a factor travels once to each block that holds one of
    its ratings, however many there are. An id with more than a quarter of a block's share of the ratings is hot
    and spread over all blocks by the other id; there are at most four hot ids per block.
    """

    data: DataFrame
    out: DataFrame
    blocks: int

    @staticmethod
    def of(ratings: DataFrame, own_col: str, other_col: str, blocks: int, seed: int = 0) -> Links:
        rows = ratings.select(F.col(own_col).cast("int").alias("id"), F.col(other_col).cast("int").alias("other"), F.col("value").cast("double").alias("value"))
        counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        whole = counts.agg((F.sum("n") / (4 * blocks)).alias("most"))  # one row
        hot = counts.crossJoin(F.broadcast(whole)).where("n > most").select("id", F.lit(True).alias("hot"))
        spread = F.when(F.coalesce("hot", F.lit(False)), F.col("other")).otherwise(F.lit(0))
        marked = rows.join(F.broadcast(hot), "id", "left").select("id", "other", "value", even_block(ratings.sparkSession, blocks, hash_block(blocks, "id", spread, seed=seed)).alias("block"))
        data = marked.repartition(blocks, "block").persist(StorageLevel.MEMORY_AND_DISK)
        return Links(data, data.select("other", "block").distinct().persist(StorageLevel.MEMORY_AND_DISK), blocks)

    def release(self) -> None:
        self.data.unpersist()
        self.out.unpersist()

    def normal_equations(self, other: DataFrame, k: int) -> DataFrame:
        """(id, n, packed), one row or a few per id: the sums of an ALS half-step given the other side's (id, f, prec)."""
        ship_package(self.data.sparkSession)
        routed = self.out.join(other.select(F.col("id").alias("other"), "f", "prec"), "other").toDF("other", "block", "f", "prec")
        return self.data.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(_pack(k), "id int, n double, packed array<double>")

    def half_step(self, other: DataFrame, old: DataFrame, p: MfParams, method: str, vb: bool, gamma: float) -> DataFrame:
        """(id, f, prec) of this side given the other side's (id, f, prec) and the old factors (id, f)."""
        packed = self.normal_equations(other, p.rank)
        buckets = self.blocks * 4
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
        solved = packed.withColumn("bucket", bucket).groupBy("bucket").cogroup(old.select("id", "f", bucket).groupBy("bucket"))
        return solved.applyInArrow(_solve(p.rank, method, vb, gamma, p.weighted), FACTOR_DDL)


def _exact(train: DataFrame, p: MfParams, method: str) -> Iterator[tuple[DataFrame, None]]:
    vb = MfStrategy(p.strategy) is MfStrategy.DVB
    k, seed = p.rank, p.seed
    spark = train.sparkSession
    train = train.persist(StorageLevel.MEMORY_AND_DISK)  # read five times to build the links
    blocks = max(p.row_blocks * p.col_blocks, groups_for(spark, train.count(), BLOCK_RATINGS))
    by_row, by_col = Links.of(train, "row", "col", blocks, p.seed), Links.of(train, "col", "row", blocks, p.seed)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            n = b.column(1).to_numpy()
            f = 0.05 + C.initial_factors(ids, 0, k, 2, seed)  # uniform in [0, 0.1)
            prec = np.tile((p.gamma * (n if p.weighted or vb else np.ones(len(n))))[:, None], (1, k)) if vb else np.full(f.shape, np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids), C._lists(f), C._lists(prec)], names=["id", "f", "prec"])

    rows = snapshot(by_row.data.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("n")).mapInArrow(start, FACTOR_DDL))
    cols = spark.createDataFrame([], FACTOR_DDL)
    gamma_cols = p.gamma if p.gamma_cols is None else p.gamma_cols
    try:
        for _ in range(p.outer):
            cols = snapshot(by_col.half_step(rows, cols, p, method, vb, gamma_cols), replaces=cols)
            rows = snapshot(by_row.half_step(cols, rows, p, method, vb, p.gamma), replaces=rows)
            yield rows.select(F.lit(0).alias("dim"), "id", "f").unionByName(cols.select(F.lit(1).alias("dim"), "id", "f")), None
    finally:
        by_row.release()
        by_col.release()
        train.unpersist()
