"""Block assignment: deterministic expressions of the keys, so a recomputed task gives the same blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_block(n: int, *keys: Column | str, seed: int = 0) -> Column:
    """Pseudo-random block of the keys: xxhash64 modulo n."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("int")


def groups_for(spark: SparkSession, size: int, per_group: int) -> int:
    """Number of groups for grouped functions: all cores busy, and no group larger than about `per_group`."""
    return max(spark.sparkContext.defaultParallelism, -(-size // per_group))


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n blocks so that repartition(n, number) puts each block into a partition of its own.

    Hash partitioning puts the plain numbers 0 to n - 1 into about two thirds of n partitions, some of which then take
    three times as long as the mean.
    """
    known = spark.__dict__.setdefault("_quorix_labels", {})
    if n not in known:
        found: dict[int, int] = {}
        size = 16 * n
        while len(found) < n:
            at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")
            found = {r["at"]: r["id"] for r in spark.range(size).groupBy(at).agg(F.min("id").alias("id")).collect()}  # n rows
            size *= 2
        known[n] = [int(found[i]) for i in range(n)]
    return known[n]


def even_block(spark: SparkSession, n: int, block: Column) -> Column:
    """The label of a block from 0 to n - 1, see even_labels."""
    return F.element_at(F.array(*(F.lit(x) for x in even_labels(spark, n))), block + 1).cast("int")


def modulo_block(key: Column | str, n: int) -> Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(n)).cast("int")


def range_block(key: Column | str, size: int, n: int) -> Column:
    """Consecutive ranges of `size` keys; the last block takes the rest."""
    k = F.col(key) if isinstance(key, str) else key
    return F.least(F.floor(k / F.lit(size)), F.lit(n - 1)).cast("int")


def grid_block(rb: Column, cb: Column, cols: int) -> Column:
    return (rb * cols + cb).cast("int")


def cube_block(b1: Column, b2: Column, b3: Column, n2: int, n3: int) -> Column:
    return (b1 * (n2 * n3) + b2 * n3 + b3).cast("int")


def replicated_blocks(df: DataFrame, key: str, n: int, ratio: float, seed: int = 0) -> DataFrame:
    """One row per (row, block): each key lies in every block with probability ratio / n, and in its own always."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.struct(b.alias("b"), (F.pmod(F.xxhash64(F.lit(seed), F.col(key), b), F.lit(1_000_000)) / 1e6).alias("u")))
    own = hash_block(n, key, seed=seed)
    chosen = F.filter(blocks, lambda e: (e["u"] < ratio / n) | (e["b"] == own))
    return df.withColumn("block", F.explode(F.transform(chosen, lambda e: e["b"])))


def mix32(x: Column) -> Column:
    """A bit-mixing hash of an int, for seeds."""
    x = x.cast("long")
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 20)).bitwiseXOR(F.shiftrightunsigned(x, 12))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 7)).bitwiseXOR(F.shiftrightunsigned(x, 4)).cast("int")


def rating_blocks(ratings: DataFrame, rows: int, cols: int, by: str = "hash", seed: int = 0) -> DataFrame:
    """Ratings with rb, cb and block on a rows x cols grid; `by` is hash or modulo."""
    if by == "modulo":
        rb, cb = modulo_block("row", rows), modulo_block("col", cols)
    else:
        rb, cb = hash_block(rows, "row", seed=seed), hash_block(cols, "col", seed=seed + 1)
    return ratings.withColumns({"rb": rb, "cb": cb}).withColumn("block", grid_block(F.col("rb"), F.col("cb"), cols))


def hash_split(df: DataFrame, key: str, train: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, validate) by a hash of the key: the same in every run and partitioning."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / F.lit(1e6)
    return df.where(u < train), df.where(u >= train)


def bernoulli(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """A Bernoulli sample by a hash of the key: the same in every run and partitioning."""
    return hash_split(df, key, fraction, seed)[0]


def dense_index(df: DataFrame, key: str, into: str = "index") -> DataFrame:
    """(key, index): distinct keys numbered 0.. in key order without a single-task window.

    Range partitions are counted, their offsets summed on the driver (one number per partition), and rows
    numbered inside their partition.
    """
    from quorix.session import cut

    ordered = cut(df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
    sizes = {r["__p"]: r["n"] for r in ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    spark = df.sparkSession
    at = spark.createDataFrame(offsets or [(0, 0)], "__p int, __o bigint")
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__o")
    return ordered.join(F.broadcast(at), "__p").select(key, place.cast("long").alias(into))
