"""Per-key results for tables in which a few keys hold most records.

Records are first grouped by key AND value. That group-by has partial aggregation and its keys are
spread even within one hot key. All further results come from the weighted values: counts, sums, distinct
counts and modes by partial aggregation, quantiles by ranges of values, so no task sees a whole hot key,
however many distinct values it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorix.session import kept


def compress(df: DataFrame, sides: dict[str, str], value: str) -> DataFrame:
    """(side, key_id, value, n): how often each value occurs under each key of each side.

    `sides` names the key column of each side. Null keys and null values form groups of their own; all
    NaN are one value and -0.0 counts as 0.0. An empty table gives an empty result.
    """
    picked = [F.struct(F.lit(s).alias("side"), F.col(k).alias("key_id"), F.col(value).alias("value")) for s, k in sides.items()]
    return df.select(F.inline(F.array(*picked))).groupBy("side", "key_id", "value").agg(F.count(F.lit(1)).alias("n"))


def value_range(v: Column) -> Column:
    """The range of a number, rising with it: 256 ranges per power of two. A float's range holds at most about 23,000
    distinct values, and there are at most about 142,000 ranges."""
    size = F.floor(F.log2(F.abs(v)) * 256) + 1_000_000
    return F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * 2_000_000).otherwise(F.signum(v) * size).cast("int")


def _usable(value: str = "value") -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def key_stats(compressed: DataFrame) -> DataFrame:
    """Count, sum, mean, distinct values, mode and median of every non-null key.

    n: all records; n_values: those whose value is a number, from which sum, mean, n_distinct, mode
    (smallest of the most frequent) and median (lower one) are taken; these are null (n_distinct: 0)
    where a key has no such record. NaN and null values count in n only.
    """
    compressed = kept(compressed)  # read for the sums and twice for the median
    v = F.when(_usable(), F.col("value").cast("double"))
    weight = F.when(_usable(), F.col("n")).otherwise(F.lit(0))
    keyed = compressed.where(F.col("key_id").isNotNull()).select("side", "key_id", "n", v.alias("v"), weight.alias("w"))
    sums = keyed.groupBy("side", "key_id").agg(
        F.sum("n").alias("n"),
        F.sum("w").alias("n_values"),
        F.sum(F.col("v") * F.col("w")).alias("value_sum"),
        (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value_mean"),
        F.count("v").alias("n_distinct"),
        F.max_by("v", F.when(F.col("v").isNotNull(), F.struct(F.col("w"), -F.col("v")))).alias("value_mode"),
    )
    median = weighted_quantiles(compressed, [0.5]).withColumnRenamed("q0", "value_median")
    return sums.join(median, ["side", "key_id"], "left")


def heavy_keys(compressed: DataFrame, share: float) -> DataFrame:
    """(side, key_id, n): non-null keys that hold at least `share` of all rows, null keys included."""
    counts = kept(compressed.groupBy("side", "key_id").agg(F.sum("n").alias("n")))  # read twice below
    whole = counts.groupBy("side").agg(F.sum("n").alias("whole"))  # one row per side: safe to broadcast
    return (
        counts.join(F.broadcast(whole), "side")
        .where(F.col("key_id").isNotNull() & (F.col("n") >= F.lit(share) * F.col("whole")))
        .select("side", "key_id", "n")
    )


def weighted_quantiles(compressed: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Exact lower quantiles q0, q1, ... per (side, key_id) from the weighted values.

    A quantile is the first value at which its share of the key's weight is reached. No task holds a whole
    key: the weights of its value ranges are summed first, and only the values of the range in which a
    quantile lies are sorted. Keys without a number give no row.
    """
    rows = kept(compressed).where(F.col("key_id").isNotNull() & _usable()).select("side", "key_id", F.col("value").cast("double").alias("value"), "n")
    rows = rows.withColumn("range", value_range(F.col("value")))
    by = Window.partitionBy("side", "key_id")  # at most one row per value range
    ranges = rows.groupBy("side", "key_id", "range").agg(F.sum("n").alias("w")).withColumns(
        {"upto": F.sum("w").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("w").over(by)}
    )
    # the same arithmetic in both steps: a quantile lies in exactly one range
    targets = F.array(*(F.struct(F.lit(i).alias("q"), (F.col("whole") * F.lit(float(p))).alias("target")) for i, p in enumerate(probabilities)))
    before = F.col("upto") - F.col("w")
    here = F.filter(targets, lambda t: (t["target"] <= F.col("upto")) & ((t["target"] > before) | (before == 0)))
    wanted = ranges.select("side", "key_id", "range", before.alias("before"), F.explode(here).alias("t")).select("side", "key_id", "range", "before", "t.q", "t.target")
    inside = Window.partitionBy("side", "key_id", "range", "q").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(wanted, ["side", "key_id", "range"]).withColumn("upto", F.col("before") + F.sum("n").over(inside)).where("upto >= target")
    firsts = (F.min(F.when(F.col("q") == i, F.col("value"))).alias(f"q{i}") for i in range(len(probabilities)))
    return found.groupBy("side", "key_id").agg(*firsts)
