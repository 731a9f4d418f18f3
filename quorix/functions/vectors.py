"""Vector algebra on array columns (dense) and on index/value arrays (sparse).

Dense vectors of different length give null, as does a null vector; null elements make the touched
result null. Sparse vectors are `idx` (distinct, any order) with `val`, where a null `val` is all ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def _both(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: f(_d(x), _d(y))))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x))


def add(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """True division; a zero divisor gives null."""
    return _both(a, b, lambda x, y: F.when(y != 0, x / y))


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def plus_dot(a: Column, plus: Column, b: Column) -> Column:
    """(a + plus) . b"""
    return dot(add(a, plus), b)


def scale(a: Column, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(a, lambda x: _d(x) * s)


def shift(a: Column, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(a, lambda x: _d(x) + s)


def scale_down(a: Column, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(a, lambda x: F.when(s != 0, _d(x) / s))


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -_d(x))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def variance(a: Column) -> Column:
    """Population variance."""
    m = mean(a)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + (_d(x) - m) * (_d(x) - m)) / F.size(a))


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x) * _d(x))


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def l1_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(_d(x)))


def squared_distance(a: Column, b: Column) -> Column:
    return squared_norm(subtract(a, b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def filled(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def indicator(n: int, at: Column) -> Column:
    """The unit vector of length n with a one at the 0-based position `at`."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def vector_sum(df: DataFrame, keys: list[str], vector: str, into: str = "vector_sum") -> DataFrame:
    """Elementwise sum per key: exploded, partially aggregated before the shuffle, put together again."""
    parts = df.select(*keys, F.posexplode(vector).alias("__pos", "__x")).groupBy(*keys, "__pos").agg(F.sum(_d(F.col("__x"))).alias("__s"))
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__s"))).alias("__v"))
    return rows.select(*keys, F.transform("__v", lambda e: e["__s"]).alias(into))


# --- sparse -----------------------------------------------------------------------------------------


def values_or_ones(idx: Column, val: Column) -> Column:
    return F.coalesce(val, F.transform(idx, lambda _: F.lit(1.0)))


def sparse_map(idx: Column, val: Column) -> Column:
    return F.map_from_arrays(idx, values_or_ones(idx, val))


def sparse_contains(idx: Column, i: Column) -> Column:
    return F.coalesce(F.array_contains(idx, i), F.lit(False))


def sparse_get(idx: Column, val: Column, i: Column) -> Column:
    """The value at index i, 0 where there is none."""
    return F.coalesce(F.try_element_at(sparse_map(idx, val), i), F.lit(0.0))


def densify(idx: Column, val: Column, n: int) -> Column:
    m = sparse_map(idx, val)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def gather(idx: Column, dense: Column) -> Column:
    """The elements of a dense vector at 0-based indices; 0 out of range."""
    return F.transform(idx, lambda i: F.coalesce(F.get(dense, i), F.lit(0.0)))


def sparse_dot_dense(idx: Column, val: Column, dense: Column) -> Column:
    return total(F.zip_with(gather(idx, dense), values_or_ones(idx, val), lambda x, y: _d(x) * _d(y)))


def sparse_squared_norm(idx: Column, val: Column) -> Column:
    """Binary vectors: the number of indices."""
    return squared_norm(values_or_ones(idx, val))


def sparse_l1_norm(idx: Column, val: Column) -> Column:
    return l1_norm(values_or_ones(idx, val))


def _exploded(df: DataFrame, key: str, idx: str, val: str, out: str) -> DataFrame:
    both = F.arrays_zip(F.col(idx).alias("i"), values_or_ones(F.col(idx), F.col(val)).alias("v"))
    return df.select(F.col(key).alias("key"), F.explode(both).alias("e")).select("key", F.col("e.i").alias("idx"), F.col("e.v").cast("double").alias(out))


def sparse_combine(a: DataFrame, b: DataFrame, key: str, f: Callable[[Column, Column], Column], idx: str = "idx", val: str = "val") -> DataFrame:
    """(key, idx, value): f of both sparse vectors of each key, over the union of their indices.

    One full join on (key, idx), so no vector is ever collected.
    """
    left, right = _exploded(a, key, idx, val, "x"), _exploded(b, key, idx, val, "y")
    zero = F.lit(0.0)
    joined = left.join(right, ["key", "idx"], "full")
    return joined.select(F.col("key").alias(key), "idx", f(F.coalesce("x", zero), F.coalesce("y", zero)).alias("value"))


def sparse_distances(a: DataFrame, b: DataFrame, key: str, idx: str = "idx", val: str = "val") -> DataFrame:
    """(key, squared_distance, l1_distance) of both sparse vectors of each key, tails included."""
    diff = sparse_combine(a, b, key, lambda x, y: x - y, idx, val)
    return diff.groupBy(key).agg(F.sum(F.col("value") * F.col("value")).alias("squared_distance"), F.sum(F.abs("value")).alias("l1_distance"))


def sparse_dot(a: DataFrame, b: DataFrame, key: str, idx: str = "idx", val: str = "val") -> DataFrame:
    """(key, dot): only common indices meet, by an inner join."""
    left, right = _exploded(a, key, idx, val, "x"), _exploded(b, key, idx, val, "y")
    return left.join(right, ["key", "idx"]).groupBy(F.col("key").alias(key)).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def int_vector(a: Column) -> Column:
    """The vector as whole numbers, rounded toward zero."""
    return F.transform(a, lambda x: x.cast("bigint"))


def int_divide(a: Column, s: Column | int) -> Column:
    """Whole-number division by a scalar, toward zero; by 0 null elements."""
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(a, lambda x: F.when(s != 0, (x.cast("bigint") - x.cast("bigint") % s) / s).cast("bigint"))


def sorted_sparse(idx: Column, val: Column) -> Column:
    """struct (idx, val) with rising indices; a null `val` stays null."""
    e = F.array_sort(F.arrays_zip(idx.alias("i"), values_or_ones(idx, val).alias("v")))
    return F.struct(F.transform(e, lambda x: x["i"]).alias("idx"), F.when(val.isNotNull(), F.transform(e, lambda x: x["v"])).alias("val"))


def sparse_scale(val: Column, idx: Column, s: Column | float) -> Column:
    """The values times a scalar; a binary vector becomes a constant one."""
    return scale(values_or_ones(idx, val), s)


def put(a: Column, at: Column, x: Column) -> Column:
    """The vector with `x` at the 0-based position `at`; unchanged out of range."""
    return F.transform(a, lambda v, i: F.when(i == at, _d(x)).otherwise(_d(v)))
