"""Synthetic factor matrices and tensors with known ground truth, generated in parallel.

Every id's factor and every row's cells come from a generator seeded by the id, so results don't depend
on partitioning and a retried task gives the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.session import ship_package


def factor(ids: np.ndarray, side: int, rank: int, sigma: float, seed: int) -> np.ndarray:
    return np.stack([np.random.default_rng([seed, side, int(i)]).normal(0.0, sigma, rank) for i in ids]) if len(ids) else np.empty((0, rank))


def synth_matrix(spark: SparkSession, rows: int, cols: int, rank: int = 10, density: float = 0.1, noise_precision: float = 100.0, train: float = 0.9, seed: int = 0, row_blocks: int = 4) -> DataFrame:
    """(row, col, value, is_train, rb): factors N(0, rank^-1/2); a row's number of cells is a normal
    approximation to a binomial; distinct columns; training cells get noise of deviation precision^-1/2."""
    ship_package(spark)
    sigma = rank**-0.25
    ddl = "row int, col int, value double, is_train boolean, rb int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fc = factor(np.arange(cols), 1, rank, sigma, seed)
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i in b.column(0).to_numpy():
                g = np.random.default_rng([seed, 2, int(i)])
                n = int(np.clip(round(g.normal(cols * density, np.sqrt(cols * density * (1 - density)))), 0, cols))
                j = np.sort(g.choice(cols, n, replace=False))
                fr = factor(np.array([i]), 0, rank, sigma, seed)[0]
                known = g.random(n) < train
                value = fc[j] @ fr + np.where(known, g.normal(0, noise_precision**-0.5, n), 0.0)
                for c, x in zip(out, (np.full(n, i, np.int32), j.astype(np.int32), value, known, np.full(n, i * row_blocks // max(rows, 1), np.int32))):
                    c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["row", "col", "value", "is_train", "rb"])

    return spark.range(0, rows, 1, row_blocks).select(F.col("id")).mapInArrow(run, ddl)


def synth_tensor(spark: SparkSession, sizes: tuple[int, int, int], rank: int = 5, density: float = 0.1, noise_precision: float = 100.0, gamma: float = 1.0, train: float = 0.9, seed: int = 0, blocks: int = 4) -> DataFrame:
    """(i, j, k, value, is_train): factors N(0, 1 / gamma); each cell exists with probability `density`."""
    ship_package(spark)
    n1, n2, n3 = sizes
    sigma = gamma**-0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b2, b3 = factor(np.arange(n2), 1, rank, sigma, seed), factor(np.arange(n3), 2, rank, sigma, seed)
        for b in batches:
            for i in b.column(0).to_numpy():
                g = np.random.default_rng([seed, 3, int(i)])
                cells = np.nonzero(g.random(n2 * n3) < density)[0]
                j, k = cells // n3, cells % n3
                known = g.random(len(cells)) < train
                a = factor(np.array([i]), 0, rank, sigma, seed)[0]
                value = (b2[j] * b3[k]) @ a + np.where(known, g.normal(0, noise_precision**-0.5, len(cells)), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i, np.int32)), pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(value), pa.array(known)], names=["i", "j", "k", "value", "is_train"])

    return spark.range(0, n1, 1, blocks).select("id").mapInArrow(run, "i int, j int, k int, value double, is_train boolean")


def moments(df: DataFrame) -> DataFrame:
    """One row: numbers of training and test cells, first and second moment of the values."""
    v = F.col("value")
    return df.agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"), F.avg(v).alias("m1"), F.avg(v * v).alias("m2"))
