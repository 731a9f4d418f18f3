"""Scalar functions and proximal steps as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function, clamped to 4.5398e-05 below -10 and to 1 - 1e-05 above 10. Null stays null."""
    return F.when(x < -10, F.lit(4.5398e-05)).when(x > 10, F.lit(1 - 1e-05)).otherwise(1 / (1 + F.exp(-x)))


def clamped_exp(x: Column) -> Column:
    return F.when(x < -10, F.lit(4.54e-5)).when(x > 10, F.lit(22026.0)).otherwise(F.exp(x))


def log_likelihood(margin: Column) -> Column:
    """-log(1 + e^-m), and m itself for m <= -10."""
    return F.when(margin > -10, -F.log1p(F.exp(-margin))).otherwise(margin)


def bucketize(x: Column, bin_size: Column | float, dim: int) -> Column:
    """min(int(x / bin_size), dim - 1); bin size 0 puts everything in bin 0."""
    size = bin_size if isinstance(bin_size, Column) else F.lit(float(bin_size))
    return F.when(size == 0, 0).otherwise(F.least(F.floor(x / size), F.lit(dim - 1))).cast("int")


def smoothed_rate(clicks: Column, impressions: Column, prior: float = 0.05, weight: float = 75.0) -> Column:
    """(clicks + prior * weight) / (impressions + weight)."""
    return (clicks + F.lit(prior * weight)) / (impressions + F.lit(weight))


def day_number(date: Column, interval: int = 1) -> Column:
    """Bucket of a yyyy-mm-dd string in a calendar of 30-day months and 365-day years from 1999."""
    p = F.split(date, "-")
    days = (p[0].cast("int") - 1999) * 365 + (p[1].cast("int") - 1) * 30 + p[2].cast("int")
    return F.floor(days / F.lit(interval)).cast("int")


def time_bucket(seconds: Column, interval: int) -> Column:
    """Bucket of an epoch or day number."""
    return F.floor(seconds / F.lit(interval)).cast("int")


def log_count(n: Column) -> Column:
    """log(n + 1) with two decimals."""
    return F.round(F.log1p(n), 2)


def l1_prox(num: Column, den: Column, lam: float) -> Column:
    """Soft-threshold the numerator, then divide. A denominator of 0 (feature never seen) gives 0."""
    soft = F.when(num > lam, num - lam).when(num < -lam, num + lam).otherwise(F.lit(0.0))
    return F.when(den == 0, F.lit(0.0)).otherwise(soft / den)


def l2_prox(num: Column, den: Column, lam: float) -> Column:
    """num / (den + lam); 0 where both are 0."""
    return F.when(den + lam == 0, F.lit(0.0)).otherwise(num / (den + lam))


def savgm_fix(w1: Column, w2: Column, r: float) -> Column:
    """Bootstrap bias correction (w1 - r w2) / (1 - r)."""
    return (w1 - F.lit(r) * w2) / F.lit(1 - r)


def max_norm(num: Column, den: Column, lam: float) -> Column:
    """v = num / den elementwise (arrays), scaled to squared norm lam where it exceeds lam."""
    v = F.zip_with(num, den, lambda n, d: F.when(d == 0, F.lit(0.0)).otherwise(n / d))
    sq = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.transform(v, lambda x: F.when(sq > lam, x * F.sqrt(F.lit(lam) / sq)).otherwise(x))
