"""Evaluation metrics as DataFrames. Training and queries use the same ones.

Scored rows are (label, score); predicted rows have value and pred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorix.functions import exprs

THRESHOLDS = 500


def margins(scored: DataFrame) -> DataFrame:
    return scored.select(*(c for c in scored.columns if c != "score"), (F.col("label") * F.col("score")).alias("margin"))


def score_histogram(scored: DataFrame, thresholds: int = THRESHOLDS) -> DataFrame:
    """(b, pos, neg, llh): rows by the number of thresholds (i - 1) / 500 they exceed, with their log-likelihood.

    At most 501 rows carry all metrics, so the data pass is one partial aggregation.
    """
    passed = F.least(F.ceil(exprs.sigmoid(F.col("score")) * F.lit(thresholds)) + 1, F.lit(thresholds + 1))
    return scored.groupBy(passed.alias("b")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"), F.sum(exprs.log_likelihood(F.col("label") * F.col("score"))).alias("llh")
    )


def auc_from_histogram(hist: DataFrame) -> DataFrame:
    """One row (auc, llh) of a score histogram; equal buckets form one trapezoid. auc is null where one class is missing."""
    w = Window.orderBy(F.desc("b"))  # at most 501 rows
    up, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = hist.select("b", "llh", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(whole).alias("n_pos"), F.sum("neg").over(whole).alias("n_neg"))
    prev = rows.withColumns({"tp0": F.lag("tp", 1, 0).over(w), "fp0": F.lag("fp", 1, 0).over(w)})
    area = (F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2.0
    both = F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), F.max("n_pos") * F.max("n_neg"))
    return prev.agg((F.sum(area) / both).alias("auc"), F.coalesce(F.sum("llh"), F.lit(0.0)).alias("llh"))


def auc500(scored: DataFrame) -> DataFrame:
    """One row, auc: trapezoid over the 500 thresholds."""
    return auc_from_histogram(score_histogram(scored)).select("auc")


def weight_norms(weights: DataFrame) -> DataFrame:
    """One row (l1, l2): sum of absolute weights and of their squares."""
    return weights.agg(F.coalesce(F.sum(F.abs("w")), F.lit(0.0)).alias("l1"), F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("l2"))


def evaluation(scored: DataFrame, weights: DataFrame, lam: float, regularizer: str = "L2") -> DataFrame:
    """One row (auc, llh, objective); the objective is the negative log-likelihood plus lam |w| or lam/2 |w|^2."""
    penalty = F.col("l1") * lam if regularizer == "L1" else F.col("l2") * (lam / 2)
    found = auc_from_histogram(score_histogram(scored)).crossJoin(F.broadcast(weight_norms(weights)))  # one row each
    return found.select("auc", "llh", (penalty - F.col("llh")).alias("objective"))


def predicted(data: DataFrame, factors: DataFrame, dims: int) -> DataFrame:
    """`data` (c0, c1[, c2], value) with `pred`, the product of the ids' factors (dim, id, f); an id without factor is the zero vector."""
    joined = data
    for d in range(dims):
        joined = joined.join(factors.where(F.col("dim") == d).select(F.col("id").alias(f"c{d}"), F.col("f").alias(f"f{d}")), f"c{d}", "left")
    p = F.transform("f0", lambda x: x.cast("double"))
    for d in range(1, dims):
        p = F.zip_with(p, F.col(f"f{d}"), lambda x, y: x * y.cast("double"))
    dot = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn("pred", F.coalesce(dot, F.lit(0.0))).drop(*(f"f{d}" for d in range(dims)))


def predictions(ratings: DataFrame, row_factors: DataFrame, col_factors: DataFrame) -> DataFrame:
    """ratings (row, col, ...) with `pred`."""
    both = row_factors.select(F.lit(0).alias("dim"), "id", "f").unionByName(col_factors.select(F.lit(1).alias("dim"), "id", "f"))
    return predicted(ratings.withColumnsRenamed({"row": "c0", "col": "c1"}), both, 2).withColumnsRenamed({"c0": "row", "c1": "col"})


def squared_error(predicted: DataFrame) -> DataFrame:
    """One row (se, n)."""
    d = F.col("pred") - F.col("value")
    return predicted.agg(F.sum(d * d).alias("se"), F.count(F.lit(1)).alias("n"))


def rmse(predicted: DataFrame, scale: float = 1.0) -> DataFrame:
    return squared_error(predicted).select((F.sqrt(F.col("se") / F.col("n")) * F.lit(scale)).alias("rmse"))


def factor_penalty(factors: DataFrame, lam: float, max_norm: float = 1.0) -> DataFrame:
    """One row (l2, l1, over): lam/2 |f|^2 and lam |f| over all factors, and how many exceed the squared norm `max_norm`."""
    sq = F.aggregate("f", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = F.aggregate("f", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return factors.agg((F.sum(sq) * (lam / 2)).alias("l2"), (F.sum(size) * lam).alias("l1"), F.count_if(sq > max_norm).alias("over"))
