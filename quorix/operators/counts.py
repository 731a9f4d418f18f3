"""Counting and grouping operators. All of them aggregate partially before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, n); null tokens are not counted."""
    return tokens.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def count_histogram(counts: DataFrame) -> DataFrame:
    """(n, tokens): how many tokens occur n times."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))


def top_tokens(counts: DataFrame, most: int) -> DataFrame:
    """(token, n, index): the most frequent tokens, ties by token, numbered from 0. `most` bounds the result."""
    top = counts.orderBy(F.desc("n"), "token").limit(most)
    return top.select("token", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).alias("index"))


def vocabulary(counts: DataFrame, above: int) -> DataFrame:
    """(token, n) of tokens that occur more than `above` times."""
    return counts.where(F.col("n") > above)


def weighted_document_frequency(exploded: DataFrame, threshold: int, exact: bool = True) -> DataFrame:
    """(feature, weight) of the features that reach `threshold`: a negative row adds 1, a positive one threshold // 2.

    With `exact` false, a positive row adds threshold / 2, so that a threshold of 1 doesn't lose positives.
    """
    positive = F.lit(threshold // 2) if exact else F.lit(threshold / 2)
    w = F.sum(F.when(F.col("label") == 1, positive).otherwise(F.lit(1)))
    return exploded.groupBy("feature").agg(w.alias("weight")).where(F.col("weight") >= threshold)


def clicks_by(df: DataFrame, keys: list[str], clicks: str = "clicks", impressions: str = "impressions") -> DataFrame:
    """(entity, id, clicks, impressions) of all key columns at once, by one GROUPING SETS aggregation."""
    view = f"quorix_clicks_{id(df)}"
    df.createOrReplaceTempView(view)
    sets = ", ".join(f"({k})" for k in keys)
    which = " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys)
    value = " ".join(f"WHEN grouping({k}) = 0 THEN {k}" for k in keys)
    out = df.sparkSession.sql(
        f"SELECT CASE {which} END AS entity, CASE {value} END AS id, sum({clicks}) AS clicks, sum({impressions}) AS impressions FROM {view} GROUP BY GROUPING SETS ({sets})"
    )
    df.sparkSession.catalog.dropTempView(view)  # the plan is analysed already
    return out


def rating_summary(ratings: DataFrame) -> DataFrame:
    """One row: largest row and column, number, sum and mean of the values."""
    return ratings.agg(
        F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"), F.avg("value").alias("value_mean")
    )


def bucket_counts(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def keyed_vector_sums(stats: DataFrame, keys: list[str], num: str = "num", den: str = "den", only: str | None = None) -> DataFrame:
    """(keys, k, num, den, n_blocks[, only]): elementwise sums of numerators and precisions per key.

    `only` names a third vector, of which the largest element is kept: a key in one block has that block's.
    """
    parts = [F.col(num).alias("n"), F.col(den).alias("d"), *([F.col(only).alias("o")] if only else [])]
    exploded = stats.select(*keys, F.posexplode(F.arrays_zip(*parts)).alias("k", "e"))
    kept = [F.max("e.o").alias("only")] if only else []
    return exploded.groupBy(*keys, "k").agg(F.sum("e.n").alias("num"), F.sum("e.d").alias("den"), F.count(F.lit(1)).alias("n_blocks"), *kept)


def block_membership(ratings: DataFrame, key: str, block: str) -> DataFrame:
    """(key, blocks): sorted distinct blocks that hold the key; at most one entry per block."""
    return ratings.groupBy(key).agg(F.array_sort(F.collect_set(block)).alias("blocks"))


def multi_block(membership: DataFrame) -> DataFrame:
    return membership.where(F.size("blocks") > 1)


def block_stats(ratings: DataFrame) -> DataFrame:
    """(block, n_rows, n_cols, nnz). Distinct ids come from distinct pairs, which spread over all tasks."""
    rows = ratings.select("block", "row").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))
    cols = ratings.select("block", "col").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n_cols"))
    return ratings.groupBy("block").agg(F.count(F.lit(1)).alias("nnz")).join(rows, "block").join(cols, "block").select("block", "n_rows", "n_cols", "nnz")


def mean_factor_norm(factors: DataFrame, f: str = "f") -> DataFrame:
    return factors.agg(F.avg(F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).alias("mean_norm"))


def expand_impressions(df: DataFrame) -> DataFrame:
    """One row per impression: the first `clicks` are positive. Rows without impressions give none."""
    return df.where(F.col("impressions") > 0).select("*", F.explode(F.sequence(F.lit(1), F.col("impressions").cast("int"))).alias("nth")).withColumn("label", F.when(F.col("nth") <= F.col("clicks"), 1).otherwise(-1))


def equal_mass_frames(buckets: list[tuple[int, int]], slice_size: float) -> list[tuple[int, int]]:
    """(bucket, frame) over sorted (bucket, count): a new frame begins with the bucket at which
    slice - accumulated < slice / 5; the accumulator restarts there at 0.

    The recurrence resets on its own result, so it runs over the small bucket table on the driver.
    """
    frame, acc, out = 0, 0, []
    for bucket, n in sorted(buckets):
        acc += n
        if slice_size - acc < slice_size / 5:
            frame, acc = frame + 1, 0
        out.append((bucket, frame))
    return out


def with_time_frames(df: DataFrame, bucket: Column, frames: int, most_buckets: int = 1_000_000) -> DataFrame:
    """`df` with `frame`: time frames of about equal mass. The bucket table is checked to be small first."""
    counts = bucket_counts(df, bucket)
    rows = counts.limit(most_buckets + 1).collect()
    if len(rows) > most_buckets:
        raise ValueError(f"more than {most_buckets} time buckets: use a larger interval")
    pairs = [(r["bucket"], r["n"]) for r in rows if r["bucket"] is not None]
    total = sum(n for _, n in pairs)
    table = df.sparkSession.createDataFrame(equal_mass_frames(pairs, total / frames) or [(0, 0)], "bucket bigint, frame int")
    return df.withColumn("bucket", bucket.cast("bigint")).join(F.broadcast(table), "bucket", "left")


def top_words(topics: DataFrame, n: int) -> DataFrame:
    """(topic, word, p, rank): the n words of largest normalised weight per topic, ties by word."""
    p = F.col("eta") / F.sum("eta").over(Window.partitionBy("topic"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p"), "word"))
    return topics.withColumn("p", p).withColumn("rank", rank).where(F.col("rank") <= n).select("topic", "word", "p", "rank")
